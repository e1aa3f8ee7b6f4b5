"""N-gram Jaccard join: documents whose sets of five-word shingles are similar at 0.8 or more, by recursive splitting on sampled tokens.

Documents with equal sets form a class, and classes are joined. A class's set is embedded as MinHash values, of which two sets agree on as
large a share as their similarity. Each run starts with all sets in one bucket and splits it on two sampled positions; buckets that stay large
are split again on two positions their own path samples; buckets that are small, or that splitting no longer takes apart because their sets
agree nearly everywhere, are compared by brute force; such alike buckets overlap much, and are made one where they do. A pair at the threshold
stays together along some path of a run with a probability known beforehand, and runs are repeated until the target recall is met. Splitting
moves (path, class) pairs only; token sets are read for those classes alone that share a bucket with another one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.llm import groups as G
from buildlore.llm import texts as T
from buildlore.llm.base import query, table
from buildlore.session import drop_table

WORDS = 5
SIMILARITY = Fraction(4, 5)
RECALL = 0.9999  # if every run sampled positions of its own; over the shared `POSITIONS` it is 0.9998
POSITIONS = 64
SAMPLED = 2
SMALL = 256  # sets of a bucket that is compared by brute force at once
TOGETHER = 0.7  # share of a bucket that stays in a part for splitting to be given up
TINY = 8  # sets of a bucket that is not looked at more closely before it is compared
DEPTH = 8


def lost_in_a_run(similarity: float = float(SIMILARITY), sampled: int = SAMPLED) -> float:
    """How likely a pair of this similarity is to share no path of any depth: the extinction of the branching of its common paths."""
    q = 0.0
    for _ in range(10_000):
        q = (1 - similarity + similarity * q) ** sampled
    return q


def runs_for(recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost_in_a_run())))


def _shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, shingle hashes, their texts) of a column in slices."""
    for a, b in T.slices(texts):
        data, at = T.utf8(pc.utf8_lower(texts[a:b]))
        h, doc, _, _ = T.words(data, at)
        yield a, b, *T.shingles(h, doc, WORDS)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [s for a, b, h, doc in _shingles(texts) for s in T.sets(h, doc, b - a)]


def signatures(docs: DataFrame) -> DataFrame:
    """(id, mark, n, a, b, signature): the size of each text's set of shingles, a 128-bit name of the set, and its MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, texts = T.columns_of(batch, "id", "mark", "text")
            for a, b, h, doc in _shingles(texts):
                sig = T.minhash(h, doc, b - a, POSITIONS).view(np.int32)
                own = T.sets(h, doc, b - a)
                name = [(len(s), int(T.mix(s).sum().view(np.int64)), int(T.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64))) for s in own]
                n, x, y = (pa.array([t[k] for t in name], pa.int64()) for k in range(3))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * POSITIONS), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([ids[a:b], marks[a:b], n, x, y, flat], ["id", "mark", "n", "a", "b", "signature"])

    return docs.mapInArrow(run, "id bigint, mark bigint, n bigint, a bigint, b bigint, signature array<int>")


def buckets(classes: DataFrame, made: list[str], recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(group, id) of the buckets that brute force looks at, for `classes` (id, signature): those of sets that are alike throughout, and others.

    A bucket is alike if on a further sampled position most of its sets agree, so that splitting it would not take it apart.
    """
    runs = runs_for(recall)
    rng = np.random.default_rng(3)
    start = [F.xxhash64(F.lit(r), F.lit(int(c)), F.element_at("signature", int(c) + 1)) for r in range(runs) for c in rng.choice(POSITIONS, SAMPLED, False)]
    rows = classes.select(F.explode(F.array_distinct(F.array(*start))).alias("group"), "id").withColumn("parent", F.lit(None).cast("bigint")).withColumn("parent_n", F.lit(None).cast("bigint"))
    alike, other = [rows.filter("false").select("group", "id")], []
    for depth in range(1, DEPTH + 1):
        sizes = G.scratch(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), made)
        # most buckets hold one set alone: those rows do not move
        named = rows.select(F.col("group").alias("id"), F.col("id").alias("member"), "parent", "parent_n")
        near = G.likely_members(named, sizes.select(F.col("group").alias("id"))).select(F.col("id").alias("group"), F.col("member").alias("id"), "parent", "parent_n")
        sized = G.scratch(near.join(sizes, "group"), made)
        together = F.coalesce(F.col("n") >= TOGETHER * F.col("parent_n"), F.lit(False))
        if depth > 1:
            # small buckets were split only to see whether they are alike
            seen = sized.filter(F.col("parent_n") <= SMALL).groupBy("parent").agg(F.max(together.cast("int")).alias("alike"))
            small = small.join(seen, small["group"] == seen["parent"], "left")
            alike.append(small.filter("alike = 1").select("group", "id"))
            other.append(small.filter("coalesce(alike, 0) = 0").select("group", "id"))
            sized = sized.filter(F.col("parent_n") > SMALL)
            alike.append(sized.filter(together).select("group", "id"))
            sized = sized.filter(~together)
        if depth == DEPTH or sized.isEmpty():
            other.append(sized.select("group", "id"))
            break
        other.append(sized.filter(F.col("n") < TINY).select("group", "id"))
        left = sized.filter(F.col("n") >= TINY).select("group", "id", "n")
        small = left.filter(F.col("n") <= SMALL)
        sampled = [F.pmod(F.xxhash64("path", F.lit(k)), F.lit(POSITIONS)).cast("int") for k in range(SAMPLED)]
        child = [F.xxhash64("path", c, F.element_at("signature", c + 1)) for c in sampled]
        parents = left.withColumnRenamed("group", "path").join(classes.select("id", "signature"), "id")
        rows = parents.select(F.explode(F.array_distinct(F.array(*child))).alias("group"), "id", F.col("path").alias("parent"), F.col("n").alias("parent_n"))
    return _union(alike), _union(other)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def candidates(classes: DataFrame, made: list[str], recall: float = RECALL) -> DataFrame:
    """(group, id, n): buckets of sets that are alike, where they overlap made one; and the others that none of those covers."""
    alike, other = buckets(classes, made, recall)
    merged = G.scratch(G.merged(alike, made), made)
    other = G.scratch(G.distinct_groups(other), made)
    within = other.join(merged.select("id", F.col("group").alias("held")), "id", "left")
    covered = within.groupBy("group").agg(F.count("held").alias("k"), F.min("held").alias("low"), F.max("held").alias("high"), F.max("n").alias("n")).filter("k = n and low = high").select("group")
    return merged.unionByName(other.join(covered, "group", "left_anti").select("group", "id", "n"))


def _compared(slim: DataFrame, recall: float, count: bool, made: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of `slim` (id, text, mark): (id, class) of every set of every id; the classes of equal sets (class, weight, least id); and what `verify` finds."""
    sets = signatures(slim).withColumn("class", F.xxhash64("n", "a", "b")).groupBy("id", "class").agg(F.max("n").alias("n"), F.min("mark").alias("mark"), F.first("signature").alias("signature"))
    sets = G.scratch(sets, made)
    whole = sets.filter("n > 0")
    classes = whole.groupBy("class").agg(F.min(F.struct("id", "mark")).alias("_r"), F.count(F.lit(1)).alias("weight"), F.first("signature").alias("signature"))
    classes = G.scratch(classes.select("class", F.col("_r.id").alias("rep"), F.col("_r.mark").alias("mark"), "weight", "signature"), made)
    members = G.scratch(candidates(classes.select(F.col("class").alias("id"), "signature"), made, recall), made)
    # the texts are read again, and only those of classes with a candidate move
    own = members.select(F.col("id").alias("class")).distinct().join(classes.select("class", "rep", "mark", "weight"), "class")
    own = G.scratch(own.select(F.col("rep").alias("id"), "mark", "class", "weight"), made)
    chosen = G.likely_members(slim.select("mark", "text", F.col("id").alias("_own")).withColumnRenamed("mark", "id"), own.select(F.col("mark").alias("id")).distinct())
    chosen = chosen.select(F.col("_own").alias("id"), F.col("id").alias("mark"), "text")
    texts = chosen.join(own, ["id", "mark"]).select(F.col("class").alias("id"), "text", "weight").dropDuplicates(["id"])
    found = G.scratch(G.verify(members, texts, members.count(), SIMILARITY, shingle_sets, count), made)
    return sets.select("id", "class", "n"), classes.select("class", "rep", "weight"), found


def _components(sets: DataFrame, found: DataFrame) -> DataFrame:
    """(class, component): classes that links, or an id that has sets of both, connect; those connected with none are left out."""
    several = sets.filter("n > 0").groupBy("id").agg(F.min("class").alias("mate"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("id", "mate")
    shared = sets.join(several, "id").filter("n > 0 and class <> mate").select(F.col("class").alias("id"), "mate")
    edges = found.filter("mate is not null").select("id", "mate").unionByName(shared)
    return G.components(edges).withColumnRenamed("id", "class")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """(key, class_id, n_links) of every distinct key: the smallest key it is connected with by links, and how many other keys it links with.

    Words are runs of characters other than ASCII white space, in lower case; a text of one to four words is one shingle. A text without
    words, null ones included, links with nothing and is its own class. Rows with a null key are left out; a key that repeats counts once,
    and if its texts differ, it connects what they link with and takes the largest count. Other columns are not looked at. Equal sets always meet; a pair
    at the threshold is found with probability `recall` at least (see `RECALL`), more similar ones more surely.
    """
    made: list[str] = []
    spark = docs.sparkSession
    sets, classes, found = _compared(_slim(docs, key, text), recall, True, made)
    links = found.filter("mate is null").groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("links"))
    told = classes.join(links, "class", "left").join(_components(sets, found), "class", "left")
    told = G.scratch(told.select("class", F.coalesce("component", "class").alias("component"), "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), made)
    least = told.groupBy("component").agg(F.min("rep").alias("class_id"))
    told = told.join(least, "component").select("class", "class_id", "n_links")
    out = sets.join(told, "class", "left").groupBy("id").agg(F.min(F.coalesce("class_id", "id")).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"))
    out = G.scratch(out, []).select(F.col("id").alias(key), "class_id", "n_links")
    for place in made:
        drop_table(spark, place)
    return out


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).withColumn("mark", F.xxhash64("text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` without the documents that link, directly or through others, with one of a smaller key; rows with a null key stay.

    Spanning links are enough for that, so links are not counted.
    """
    made: list[str] = []
    sets, classes, found = _compared(_slim(docs, "doc_id", "text"), RECALL, False, made)
    told = _components(sets, found)
    least = classes.join(told, "class").groupBy("component").agg(F.min("rep").alias("least"))
    kept = classes.join(told, "class", "left").join(least, "component", "left").filter("least is not null or weight > 1").select("class", F.coalesce("least", "rep").alias("least"))
    gone = G.scratch(sets.join(kept, "class").filter("least < id").select(F.col("id").alias("doc_id")).distinct(), [])
    for place in made:
        drop_table(docs.sparkSession, place)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 5 * c >= 4 * (p.n + q.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, coalesce((SELECT min(least(a, b)) FROM reach WHERE a = doc_id), doc_id) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) AS d"""


@query("op1_ngram_join", OP1_SQL)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
