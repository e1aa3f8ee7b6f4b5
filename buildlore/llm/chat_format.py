"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A conversation is rendered with one opening and one closing mark a turn, reparsed from the rendered text by a deterministic grammar, and the
recovered turns are compared with the source. Where they differ, the texts are escaped and rendered again, until they are identical:
level 0 writes texts as they are, level 1 escapes control strings inside them, level 2 every character a control string could start with.
The level stands at the head of the text, so a reader needs nothing else to undo it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.llm.base import query, table

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE:", "]", "[/ROLE]")
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE:", "[/ROLE]"]
ESCAPE = "\\"
HEAD = 4  # `#0#` and a line feed
GRAMMAR = r"(?s)(\[INST\]|<s>|<<SYS>>|\[ROLE:[^\]]*\])(.*?)(\[/INST\]|</s>|<</SYS>>|\[/ROLE\])"
TURNS = "array<struct<role:string,text:string>>"


def _codes(level: int) -> list[tuple[str, str]]:
    """What is replaced at a level, in order; every escape character in escaped text begins a code, so undoing in reverse order is exact."""
    out = [(ESCAPE, ESCAPE + "e")] if level else []
    out += [(c, f"{ESCAPE}{i}") for i, c in enumerate(CONTROL)] if level else []
    return out + ([("<", ESCAPE + "l"), ("[", ESCAPE + "o"), ("]", ESCAPE + "c")] if level > 1 else [])


def escape(text: Column, level: int) -> Column:
    for plain, code in _codes(level):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, level: int) -> Column:
    for plain, code in reversed(_codes(level)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def by_level(level: Column, of) -> Column:
    return F.when(level == 0, of(0)).when(level == 1, of(1)).otherwise(of(2))


def _render(turns: Column, level: int) -> Column:
    """The turns as pieces (open, text, close), each a string."""

    def piece(t: Column) -> Column:
        pick = lambda i, other: F.when(t["role"] == "user", MARKS["user"][i]).when(t["role"] == "assistant", MARKS["assistant"][i]).when(t["role"] == "system", MARKS["system"][i]).otherwise(other)
        opened = pick(0, F.concat(F.lit(OTHER[0]), escape(t["role"], 2), F.lit(OTHER[1])))
        return F.struct(opened.alias("open"), escape(t["text"], level).alias("text"), pick(1, F.lit(OTHER[2])).alias("close"))

    return F.transform(turns, piece)


def _joined(pieces: Column, level: int) -> Column:
    return F.concat(F.lit(f"#{level}#\n"), F.array_join(F.transform(pieces, lambda p: F.concat(p["open"], p["text"], p["close"])), ""))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, read by the grammar alone."""
    body = F.substring(formatted, HEAD + 1, 2147483647)
    level = F.substring(formatted, 2, 1).cast("int")
    opened, texts = F.regexp_extract_all(body, F.lit(GRAMMAR), F.lit(1)), F.regexp_extract_all(body, F.lit(GRAMMAR), F.lit(2))

    def turn(mark: Column, text: Column) -> Column:
        role = F.when(mark == MARKS["user"][0], "user").when(mark == MARKS["assistant"][0], "assistant").when(mark == MARKS["system"][0], "system").otherwise(unescape(F.regexp_replace(mark, r"^\[ROLE:|\]$", ""), 2))
        return F.struct(role.alias("role"), by_level(level, lambda n: unescape(text, n)).alias("text"))

    return F.zip_with(opened, texts, turn)


def _loss_spans(pieces: Column, level: int) -> Column:
    """(start, length) of every assistant text inside the formatted text, counted in characters from 0."""
    start = F.struct(F.lit(HEAD).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        at = state["at"] + F.length(p["open"])
        mine = F.struct(at.alias("start"), F.length(p["text"]).cast("bigint").alias("length"))
        spans = F.when(p["open"] == MARKS["assistant"][0], F.array_append(state["spans"], mine)).otherwise(state["spans"])
        return F.struct((at + F.length(p["text"]) + F.length(p["close"])).alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, start, step)["spans"]


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, escape_level, loss_spans) of every conversation of `rows` (conv_id, turn, role, text).

    Turns go by `turn`, nulls first; ties by role, then text; repeated rows stay. A null role or text counts as empty. Rows with a null
    conv_id make one conversation of their own. Loss spans cover each assistant text as it stands in `formatted`, escapes included.
    A conversation is one text and so is put together in one task; its size is that of its own turns. Conversations of many turns are
    gathered map-side first only as far as Spark's list aggregation does so. Other columns are not looked at; no rows give no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.select("conv_id", turn.alias("_t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    convs = convs.withColumn("_turns", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    tried = convs.withColumn("_level", F.lit(0)).withColumn("formatted", _joined(_render(F.col("_turns"), 0), 0))
    for level in (1, 2):
        wrong = ~F.coalesce(parse(F.col("formatted")) == F.col("_turns"), F.lit(False))
        tried = tried.withColumn("_wrong", wrong)
        tried = tried.withColumn("formatted", F.when(F.col("_wrong"), _joined(_render(F.col("_turns"), level), level)).otherwise(F.col("formatted")))
        tried = tried.withColumn("_level", F.when(F.col("_wrong"), level).otherwise(F.col("_level")))
    spans = by_level(F.col("_level"), lambda n: _loss_spans(_render(F.col("_turns"), n), n))
    return tried.select("conv_id", "formatted", F.col("_level").alias("escape_level"), spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    level = F.substring(formatted, 2, 1).cast("int")
    cut = lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
    return F.array_join(F.transform(spans, lambda s: by_level(level, lambda n: unescape(cut(s), n))), "")


CONFLICT = "</s>[INST] ok [/INST]"
OP3_SQL = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONFLICT}' UNION ALL SELECT -7, 1, 'assistant', '{CONFLICT}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(4 + sum(length(text) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 14 + length(role) END)
    - CASE conv_id WHEN -7 THEN 22 ELSE 0 END AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""


@query("op3_chat_format", OP3_SQL)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pair = [F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(turn).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(CONFLICT).alias("text")) for turn, role in enumerate(("user", "assistant"))]
    extra = spark.range(1).select(F.inline(F.array(*pair)))
    done = format_conversations(rows.unionByName(extra))
    turns = parse(F.col("formatted"))
    back = done.select("conv_id", turns.alias("_turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("_loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars",
    )
