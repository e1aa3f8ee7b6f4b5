"""URL rules by a cascade of Bloom filters, in DataFrame functions alone.

Level 1 encodes the listed keys; level 2 the keys of the corpus that level 1 lets through wrongly; level 3 the listed keys that level 2 lets
through; and so on until a level lets nothing through wrongly. For every key of the corpus the first level that says no then tells exactly
whether it is listed, so pages are judged inside the scan, without a join. Level 1 is made so selective that its errors number about as many
as the listed keys; all levels together then take some tens of bits a listed key, whatever the corpus's size, and the whole is checked against
a limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.llm.base import query, table

FILTER_BYTES = 16 << 20
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
METHOD_VERDICT = "allow"


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits)) for i in range(hashes)]


def _passes(key: Column, level: Level) -> Column:
    """Whether every bit of the key is set. The filter's words are one constant of the plan."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    bits = [F.bit_get(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in _positions(key, level.bits, level.hashes, level.seed)]
    out = bits[0]
    for b in bits[1:]:
        out = out & b
    return out


def _fill(keys: DataFrame, n: int, error: float, seed: int, room: int) -> Level:
    """One level over the `n` keys of `keys`; only its words, a size known beforehand and checked, come to the driver."""
    hashes = max(1, round(-math.log2(error)))
    bits = max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)
    if bits // 8 > room:
        raise ValueError(f"level {seed} takes {bits // 8} bytes, but {room} are left of the filter's {FILTER_BYTES}")
    at = F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("at")
    words = keys.select(at).groupBy(F.expr("cast(shiftright(at, 6) as int) AS word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int))) AS bits"))
    found = dict(words.collect())
    return Level(tuple(found.get(i, 0) for i in range(bits // 64)), bits, hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """The levels for the column `key` of `listed` and of `universe`, which may repeat keys and hold listed ones; null keys are skipped.

    Exact for every key of either. An empty list needs no level, and nothing is then listed.
    """
    listed = listed.select("key").filter("key is not null").distinct()
    universe = universe.select("key").filter("key is not null")
    counts = listed.agg(F.count(F.lit(1))).collect()[0][0]
    if not counts:
        return []
    others = max(1, universe.agg(F.approx_count_distinct("key")).collect()[0][0])
    levels, inside, n, room = [], True, counts, FILTER_BYTES
    error = min(0.5, math.sqrt(0.5) * counts / others)
    while n:
        mine = listed if inside else universe.join(listed, "key", "left_anti").distinct()
        for level in levels:
            mine = mine.filter(_passes(F.col("key"), level))
        level = _fill(mine, n, error, len(levels) + 1, room)
        levels.append(level)
        room -= level.bits // 8
        inside, error = not inside, 0.5
        left = universe if not inside else listed
        for level in levels:
            left = left.filter(_passes(F.col("key"), level))
        if not inside:
            left = left.join(listed, "key", "left_anti").distinct()
        n = left.count()
    return levels


def contains(key: Column, levels: list[Level]) -> Column:
    """Exact membership of a key that belongs to the list or to the universe the cascade was built over; false for null."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(_passes(key, levels[i]), out).otherwise(F.lit(i % 2 == 1))
    return F.coalesce(key.isNotNull() & out, F.lit(False))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; empty for a null or a text without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key a rule for this host and path could have: each suffix of whole labels, followed by each path prefix of a length rules have."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: DataFrame, default: str = METHOD_VERDICT, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) of every row of `pages`, in whose `url` rules (host, path, verdict) are looked up.

    A rule fits its host and all subdomains where the page's path starts with the rule's. The longest rule wins, of equally long ones the
    smallest, and where the same rule both allows and blocks, block wins. Without a fitting rule the verdict is `default`, as the key is in no
    list. A null url, or one without `://`, has an empty host and path, which no rule fits. Rules with a null or empty host, or an unknown
    verdict, fit nothing; an empty rule list or table is fine. Rows repeat as they come and other columns are not looked at.
    """
    # the rules are kept as keys; how many characters their paths have is a short list, however many rules there are
    rules = rules.filter("host is not null and host <> '' and verdict in ('allow', 'block')").select(F.concat("host", F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("n"), "verdict")
    lengths = sorted(r[0] for r in rules.select("n").distinct().collect())
    parts = pages.select(F.col(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return parts.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = parts.withColumn("_keys", rule_keys(F.col("host"), F.col("path"), lengths))
    universe = parts.select(F.explode("_keys").alias("key"))
    block = build_cascade(rules.filter("verdict = 'block'"), universe)
    allow = build_cascade(rules.filter("verdict = 'allow'"), universe)
    order = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    hits = F.filter("_keys", lambda k: contains(k, block) | contains(k, allow))
    parts = parts.withColumn("rule", F.get(F.array_sort(hits, order), 0))
    verdict = F.when(F.col("rule").isNull(), default).when(contains(F.col("rule"), block), "block").otherwise("allow")
    return parts.select(key, "host", "path", "rule", verdict.alias("verdict"))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP2_SQL = f"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES {_VALUES}),
best AS (
  SELECT n, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM parts JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, '{METHOD_VERDICT}') AS verdict FROM parts LEFT JOIN best USING (n)"""


@query("op2_url_filter", OP2_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])))
    return judge(table(spark, sf_dir, "pages"), rules)
