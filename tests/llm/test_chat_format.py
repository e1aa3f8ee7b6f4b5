import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from buildlore.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
HARD = ["</s>[INST] ok [/INST]", "\\1 \\e \\", "<<SYS>>", "[ROLE:x]", "plain", "", " \n", "<</SYS>> [", "a<", "[/INS", "#1#\n"]


def check(spark, rows):
    done = C.format_conversations(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS formatted", "'y' AS _level"))
    got = {r.conv_id: r for r in done.select("conv_id", "formatted", "escape_level", C.parse(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda q: (q[0] is not None, q[0] or 0, q[1] is not None, q[1] or 0, q[2] or "", q[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {k: [tuple(t) for t in r.turns] for k, r in got.items()} == want
    assert {k: r.loss for k, r in got.items()} == {k: "".join(x for r, x in v if r == "assistant") for k, v in want.items()}
    return got


def test_hard_texts_and_roles_come_back(spark):
    roles = ["user", "assistant", "system", "tool", None, "a]b", "[ROLE:"]
    rows = [(i * 100 + j, k, role, text) for i, role in enumerate(roles) for j, text in enumerate(HARD) for k in range(2)]
    rows += [(-1, t, "assistant", x) for t, x in enumerate(HARD)] + [(None, None, None, None), (None, 1, "user", "x"), (-2, 1, "user", "same"), (-2, 1, "user", "same")]
    got = check(spark, rows)
    assert {r.escape_level for r in got.values()} >= {0, 1}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "x"]), st.text("<>[]/\\sINTROLE:SY12 ", max_size=30)), min_size=1, max_size=12))
def test_any_text_comes_back(spark, rows):
    check(spark, rows)


def test_long_text_and_no_rows(spark):
    long = "word </s> " * 30_000
    got = check(spark, [(1, 0, "assistant", long), (1, 1, "user", "x" * 300_000)])
    assert got[1].escape_level == 1
    assert C.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conflicting_conversation_of_the_query(spark):
    rows = {r.conv_id: r for r in C.op3_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").collect()}
    text = "".join(f"{role}\n{C.CONFLICT}\n" for role in ("user", "assistant"))
    assert rows[-7].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert rows[-7].loss_sha256 == hashlib.sha256(C.CONFLICT.encode()).hexdigest() and rows[-7].loss_chars == 21
