from pyspark.sql import Window
from pyspark.sql import functions as F

from buildlore.catalog.base import query
from buildlore.catalog.graph import tiers_query
from buildlore.catalog.sqlviews import WORD_BREAK, lines_sql, with_views
from buildlore.operators import chunking as K
from buildlore.operators import extraction as X
from buildlore.operators import retrieval as R
from buildlore.operators.scale import first_rows, spread
from buildlore.plans import build_order as B
from buildlore.plans import views as V
from buildlore.session import staged


def chunks(spark, sf):
    return staged(spark, "chunks", sf, lambda: K.window_chunks(V.files(spark, sf)))


CHUNKS_SQL = f"""cl AS (SELECT repo_id, path, {lines_sql('content')} AS ls FROM files WHERE regexp_replace(content, '\\s+', '', 'g') <> ''),
 cw AS (SELECT repo_id, path, ls, len(ls) AS n, unnest(range(0, greatest(len(ls), 1), 32)) AS s FROM cl),
 chunks AS (SELECT repo_id, path, s + 1 AS start_line, least(s + 40, n) AS end_line, array_to_string(ls[s + 1:least(s + 40, n)], chr(10)) AS content,
   substr(sha256(path || ':' || (s + 1) || '-' || least(s + 40, n) || ':'), 1, 16) AS chunk_id FROM cw WHERE s = 0 OR s + 8 < n)"""


def vectors_sql(source: str, key: str, text: str, name: str) -> str:
    """CTEs ending in `name(key..., bucket, w)` and `name_norm(key..., norm)`: sparse hashed n-gram weights."""
    return rf"""{name}_t AS (SELECT {key}, list_filter(regexp_split_to_array(lower({text}), '[\s\x{{85}}\x{{A0}}\x{{1C}}-\x{{1F}}\x{{2028}}\x{{2029}}\x0B]+'), lambda x: x <> '') AS ws FROM {source}),
 {name}_g AS (SELECT {key}, unnest(ws) AS g, 1.0 AS x FROM {name}_t UNION ALL SELECT {key}, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || '_' || ws[i + 1])), 1.5 FROM {name}_t),
 {name} AS (SELECT {key}, CAST('0x' || substr(md5(g), 31, 2) AS INT) % 128 AS bucket, CAST(sum(x) AS DOUBLE) AS w FROM {name}_g GROUP BY ALL UNION ALL SELECT {key}, 0, 1.0 FROM {name}_t WHERE len(ws) = 0),
 {name}_norm AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {name} GROUP BY ALL)"""


@query("s1_line_windows", "repo_id string, path string, start_line int, end_line int, digest string",
       with_views("files", f"WITH {CHUNKS_SQL} SELECT repo_id, path, start_line, end_line, md5(content) AS digest FROM chunks"))
def s1(spark, sf):
    return K.window_chunks(V.files(spark, sf)).withColumn("digest", F.md5("content"))


# rows only: spans follow heuristics; the unit tests compare both with a plain Python version
def code_chunks(spark, sf):
    code = V.code(spark, sf).filter(F.col("path").endswith(".py"))
    facts = X.python_facts(code).filter(F.col("error").isNull()).select("repo_id", "path", F.concat("functions", "classes").alias("symbols"))
    return K.symbol_spans(code.join(facts, ["repo_id", "path"]))


@query("s2_symbol_spans", "repo_id string, path string, symbol string, start_line int, end_line int")
def s2(spark, sf):
    # an inner explode of a column would test its size below the join of code and facts, where every mention of a line splits its file again
    opened = code_chunks(spark, sf).select("repo_id", "path", F.explode_outer("spans").alias("s")).filter(F.col("s").isNotNull())
    return opened.select("repo_id", "path", "s.symbol", F.col("s.start").alias("start_line"), F.col("s.end").alias("end_line"))


@query("s3_assembled_chunks", "repo_id string, path string, symbol string, start_line int, end_line int, chunk_id string")
def s3(spark, sf):
    return K.assemble_chunks(code_chunks(spark, sf))


@query("s4_chunk_ids", "repo_id string, path string, chunk_id string",
       with_views("files", f"WITH {CHUNKS_SQL} SELECT repo_id, path, chunk_id FROM chunks"))
def s4(spark, sf):
    return K.window_chunks(V.files(spark, sf))


@query("s5_hashed_embedding", "doc_id bigint, bucket int, value double",
       f"WITH {vectors_sql('documents', 'doc_id', 'text', 'vec')} SELECT doc_id, bucket, w / norm AS value FROM vec JOIN vec_norm USING (doc_id)")
def s5(spark, sf):
    docs = R.with_weights(spread(V.table(spark, sf, "documents").select("doc_id", "text")), "text").drop("text")
    unit = R.normalized(F.col("weights"))
    return docs.select("doc_id", F.posexplode(unit).alias("bucket", "value")).filter("value <> 0")


# questions: every benchmark text, asked of one repository; every third mentions a file of it
QUERIES_SQL = """asked AS (SELECT 'src' || (item_id % 20) AS repo_id, item_id AS query_id, text || CASE WHEN item_id % 3 = 0 THEN coalesce(' see ' || f.name || '!', '') ELSE '' END AS text
  FROM benchmark LEFT JOIN (SELECT repo_id AS fr, n AS fn, regexp_extract(path, '([^/]*)$', 1) AS name FROM files) f ON f.fr = 'src' || (item_id % 20) AND f.fn = item_id % 11)"""


def questions(spark, sf):
    q = V.table(spark, sf, "benchmark").select(F.concat(F.lit("src"), V.text_of(F.col("item_id") % 20)).alias("repo_id"), F.col("item_id").alias("query_id"), "text", (F.col("item_id") % 11).alias("n"))
    names = B.file_table(spark, sf).select("repo_id", "n", F.element_at(F.split("path", "/"), -1).alias("name"))
    said = F.coalesce(F.when(F.col("query_id") % 3 == 0, F.concat(F.lit(" see "), "name", F.lit("!"))), F.lit(""))
    return q.join(names, ["repo_id", "n"], "left").select("repo_id", "query_id", F.concat("text", said).alias("text"))


# one query per label: the mean of its vectors, against every vector
@query("w7_vector_topk", "query_id int, item_id bigint, score double, rank int",
       """WITH v AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), n AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS norm FROM v GROUP BY vec_id),
       c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM v GROUP BY ALL), cn AS (SELECT label, sqrt(sum(x * x)) AS norm FROM c GROUP BY label),
       s AS (SELECT c.label AS query_id, v.vec_id AS item_id, round(sum(c.x * v.x) / any_value(cn.norm) / any_value(n.norm), 6) AS score FROM v JOIN c USING (i) JOIN n USING (vec_id) JOIN cn ON cn.label = c.label GROUP BY ALL)
       SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 5""")
def w7(spark, sf):
    e = V.table(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(
        F.lit("all").alias("repo_id"), F.col("label").alias("query_id"), F.transform("v", lambda s: s["x"]).alias("vector"))
    return R.vector_topk(centres, e.select(F.lit("all").alias("repo_id"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 5)


@query("j6_neighbours", "repo_id string, path string, other string",
       with_views("edges", "SELECT repo_id, source AS path, target AS other FROM edges WHERE source <> target UNION SELECT repo_id, target, source FROM edges WHERE source <> target"))
def j6(spark, sf):
    return R.neighbours(V.edges(spark, sf))


FOCUS_SQL = "focus AS (SELECT a.repo_id, query_id, min(path) AS path FROM asked a JOIN files f ON f.repo_id = a.repo_id AND (contains(text, path) OR contains(text, regexp_extract(path, '([^/]*)$', 1))) GROUP BY ALL)"


@query("w10_focus_detection", "repo_id string, query_id bigint, path string",
       with_views("files", f"WITH {QUERIES_SQL}, {FOCUS_SQL} SELECT * FROM focus"))
def w10(spark, sf):
    return R.detect_focus(questions(spark, sf), B.file_table(spark, sf))


def focused(spark, sf):
    q = questions(spark, sf)
    return q.join(R.detect_focus(q, B.file_table(spark, sf)), ["repo_id", "query_id"], "left")


# questions with a known focus file are ranked by it; a question's text never stands whole inside a chunk here
GRAPH_SQL = """near AS (SELECT repo_id, source AS path, target AS other FROM edges WHERE source <> target UNION SELECT repo_id, target, source FROM edges WHERE source <> target),
 gset AS (SELECT q.repo_id, q.query_id, lower(q.text) AS t, f.path AS path, true AS is_target FROM focus f JOIN asked q USING (repo_id, query_id) UNION ALL SELECT q.repo_id, q.query_id, lower(q.text), other, false FROM focus f JOIN asked q USING (repo_id, query_id) JOIN near n ON n.repo_id = f.repo_id AND n.path = f.path),
 gall AS (SELECT g.*, c.chunk_id, c.start_line, c.end_line, contains(lower(c.content), t) AS is_match FROM gset g JOIN chunks c USING (repo_id, path)),
 graph_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, query_id ORDER BY is_target DESC, is_match DESC, path, start_line, end_line) AS place FROM gall) WHERE place <= 5)"""


@query("w8_graph_hop", "repo_id string, query_id bigint, chunk_id string, path string, is_target boolean, place int",
       with_views("files edges", f"WITH {CHUNKS_SQL}, {QUERIES_SQL}, {FOCUS_SQL}, {GRAPH_SQL} SELECT repo_id, query_id, chunk_id, path, is_target, place FROM graph_hits"))
def w8(spark, sf):
    f = focused(spark, sf).filter(F.col("path").isNotNull())
    return R.graph_chunks(f, R.neighbours(B.edge_table(spark, sf)), chunks(spark, sf))


VECTOR_SQL = f"""{vectors_sql('chunks', 'repo_id, chunk_id', 'content', 'cv')}, {vectors_sql('asked', 'repo_id, query_id', 'text', 'qv')},
 vs AS (SELECT q.repo_id, q.query_id, c.chunk_id, sum(q.w * c.w) AS dot FROM qv q JOIN cv c USING (repo_id, bucket) GROUP BY ALL),
 va AS (SELECT q.repo_id, q.query_id, c.chunk_id, round(coalesce(dot, 0) / q.norm / c.norm, 6) AS score FROM qv_norm q JOIN cv_norm c USING (repo_id) LEFT JOIN vs USING (repo_id, query_id, chunk_id)),
 vector_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, query_id ORDER BY score DESC, chunk_id) AS rank FROM va) WHERE rank <= 5)"""
FUSED_SQL = """fa AS (SELECT repo_id, query_id, chunk_id, coalesce(v.score, 0.5) AS score, v.chunk_id IS NOT NULL AS v, g.chunk_id IS NOT NULL AS g FROM vector_hits v FULL JOIN graph_hits g USING (repo_id, query_id, chunk_id)),
 fused AS (SELECT repo_id, query_id, chunk_id, score, CASE WHEN v AND g THEN 'graph,vector' WHEN g THEN 'graph' ELSE 'vector' END AS sources, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, query_id ORDER BY v AND g DESC, score DESC, chunk_id) AS rank FROM fa) WHERE rank <= 10)"""


def fused(spark, sf):
    return R.retrieve(focused(spark, sf), chunks(spark, sf), B.edge_table(spark, sf))


@query("w9_hybrid_fusion", "repo_id string, query_id bigint, chunk_id string, score double, sources string, rank int",
       with_views("files edges", f"WITH {CHUNKS_SQL}, {QUERIES_SQL}, {FOCUS_SQL}, {GRAPH_SQL}, {VECTOR_SQL}, {FUSED_SQL} SELECT * FROM fused"))
def w9(spark, sf):
    return fused(spark, sf)


@query("s6_context_blocks", "repo_id string, query_id bigint, chars bigint, digest string",
       with_views("files edges", f"""WITH {CHUNKS_SQL}, {QUERIES_SQL}, {FOCUS_SQL}, {GRAPH_SQL}, {VECTOR_SQL}, {FUSED_SQL},
       b AS (SELECT f.repo_id, query_id, string_agg('[Source: ' || path || ':L' || start_line || '-L' || end_line || ' | Retrieved via: ' || replace(sources, ',', ', ') || ']' || chr(10) || content || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM fused f JOIN chunks USING (repo_id, chunk_id) GROUP BY ALL)
       SELECT repo_id, query_id, length(context) AS chars, md5(context) AS digest FROM b""".replace("chr(10) || '---' || chr(10) ORDER", "'\n---\n' ORDER")))
def s6(spark, sf):
    out = R.context_blocks(fused(spark, sf), chunks(spark, sf))
    return out.withColumn("chars", F.length("context")).withColumn("digest", F.md5("context"))


SAMPLES_SQL = """samples AS (SELECT repo_id, tier_index, path, p AS sample FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, tier_index ORDER BY path) AS p FROM tiers) WHERE p <= 3),
 asked AS (SELECT repo_id, tier_index * 10 + sample AS query_id, 'What is the primary role and exported interface of ' || path || '?' AS text, path FROM samples), focus AS (SELECT repo_id, query_id, path FROM asked)"""


@query("w11_milestone_citations", "repo_id string, tier_index int, line_range string, place int",
       tiers_query("files edges", f"""WITH {CHUNKS_SQL}, {SAMPLES_SQL}, {GRAPH_SQL}, {VECTOR_SQL}, {FUSED_SQL},
       ci AS (SELECT f.repo_id, query_id // 10 AS tier_index, c.path || ':L' || start_line || '-L' || end_line AS line_range, min((query_id % 10, rank)) AS place_at FROM fused f JOIN chunks c USING (repo_id, chunk_id) JOIN tiers t ON t.repo_id = f.repo_id AND t.tier_index = query_id // 10 AND t.path = c.path GROUP BY ALL)
       SELECT repo_id, tier_index, line_range, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, tier_index ORDER BY place_at) AS place FROM ci) WHERE place <= 8"""))
def w11(spark, sf):
    tiers = B.tiers(spark, sf)
    sample = first_rows(tiers.select("repo_id", "tier_index", "path"), ["repo_id", "tier_index"], ["path"], 3, "sample")
    text = F.concat(F.lit("What is the primary role and exported interface of "), "path", F.lit("?"))
    q = sample.select("repo_id", (F.col("tier_index") * 10 + F.col("sample")).alias("query_id"), text.alias("text"), "path")
    ranked = R.retrieve(q, chunks(spark, sf), B.edge_table(spark, sf)).select(
        "repo_id", F.floor(F.col("query_id") / 10).cast("int").alias("tier_index"), (F.col("query_id") % 10).alias("sample"), "chunk_id", "rank")
    return R.citations(ranked, chunks(spark, sf), tiers)


@query("w12_edge_union", "repo_id string, source string, target string",
       with_views("numbered_edges", "SELECT repo_id, source, target FROM numbered_edges WHERE n % 2 = 0 UNION SELECT repo_id, source, target FROM numbered_edges WHERE n % 2 = 1 OR n % 3 = 0"))
def w12(spark, sf):
    e = V.numbered_edges(spark, sf)
    listed, parsed = e.filter("n % 2 = 0"), e.filter("n % 2 = 1 OR n % 3 = 0")
    return listed.unionByName(parsed).select("repo_id", "source", "target").distinct()


@query("w13_set_operations", "kind string, repo_id string, path string",
       with_views("files edges", """WITH linked AS (SELECT repo_id, source AS path FROM edges UNION SELECT repo_id, target FROM edges), odd AS (SELECT repo_id, path FROM files WHERE path LIKE 'zzz/%')
       SELECT 'outside' AS kind, * FROM (SELECT repo_id, path FROM files EXCEPT SELECT * FROM linked) UNION ALL SELECT 'both', * FROM (SELECT * FROM odd INTERSECT SELECT * FROM linked)"""))
def w13(spark, sf):
    fs = V.files(spark, sf).select("repo_id", "path")
    e = V.edges(spark, sf)
    linked = e.select("repo_id", F.col("source").alias("path")).union(e.select("repo_id", "target"))
    outside = fs.join(linked, ["repo_id", "path"], "left_anti").withColumn("kind", F.lit("outside"))
    return outside.unionByName(fs.filter(F.col("path").startswith("zzz/")).intersect(linked).withColumn("kind", F.lit("both")))


@query("w14_chunks_of_files", "repo_id string, path string, place int, start_line int, chunk_id string",
       with_views("files", f"WITH {CHUNKS_SQL} SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id, path ORDER BY start_line, end_line) AS place, start_line, chunk_id FROM chunks"))
def w14(spark, sf):
    # a file holds a bounded number of chunks, so a window per file is small
    order = Window.partitionBy("repo_id", "path").orderBy("start_line", "end_line")
    return chunks(spark, sf).withColumn("place", F.row_number().over(order))


@query("j15_hint_leaks", "hint_id string, name string",
       with_views("files symbols", f"""WITH h AS (SELECT f.repo_id || ':' || f.path AS hint_id, g.content AS text FROM files f JOIN files g ON g.repo_id = f.repo_id AND g.n = f.n + 1), x AS (SELECT repo_id || ':' || path AS hint_id, symbol AS name FROM symbols),
       w AS (SELECT hint_id, unnest(list_distinct(regexp_split_to_array(lower(text), '{WORD_BREAK}'))) AS word FROM h) SELECT DISTINCT hint_id, name FROM x JOIN w USING (hint_id) WHERE lower(name) = word AND length(name) >= 3"""))
def j15(spark, sf):
    fs = B.file_table(spark, sf)
    following = fs.select("repo_id", (F.col("n") - 1).alias("n"), F.col("doc_id").alias("next_id"))
    hints = fs.join(following, ["repo_id", "n"]).select(F.concat("repo_id", F.lit(":"), "path").alias("hint_id"), "doc_id", "next_id")
    said = V.table(spark, sf, "documents").select(F.col("doc_id").alias("next_id"), R.said_words("text").alias("said"))
    names = V.symbol_lists(spark, sf).withColumnRenamed("symbols", "names")
    return R.leaked_symbols(hints.join(said, "next_id").join(names, "doc_id").select("hint_id", "said", "names"))
