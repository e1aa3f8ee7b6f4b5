from pyspark.sql import Window
from pyspark.sql import functions as F

from buildlore.catalog.base import query
from buildlore.catalog.graph import tiers_query
from buildlore.catalog.sqlviews import with_views
from buildlore.functions.paths import repository_key
from buildlore.operators import verification as C
from buildlore.operators.scale import dealt_by
from buildlore.plans import build_order as B
from buildlore.plans import views as V

# ---------------------------------------------------------------- snapshots
_JOBS9 = "jobs9 AS (SELECT id, github_url, CASE WHEN id % 4 <> 0 THEN 'c' || (id % 5) END AS commit_hash, CASE id % 3 WHEN 0 THEN '/packages/api/' WHEN 1 THEN ' ' END AS subpath FROM repos)"


@query("j9_snapshot_match", "id bigint, snapshot_id bigint, exact boolean",
       with_views("repos", rf"""WITH {_JOBS9}, j AS (SELECT *, CASE WHEN trim(coalesce(subpath, '')) <> '' THEN trim(replace(subpath, '\', '/'), '/') ELSE '' END AS sub FROM jobs9),
       h AS (SELECT id AS r, github_url, commit_hash, coalesce(subpath, '') AS sub FROM repos), a AS (SELECT github_url, commit_hash, sub, max(r) AS r FROM h GROUP BY ALL), b AS (SELECT github_url, sub, max(r) AS r FROM h GROUP BY ALL),
       c AS (SELECT github_url, commit_hash, max(r) AS r FROM h GROUP BY ALL), d AS (SELECT github_url, max(r) AS r FROM h GROUP BY ALL),
       x AS (SELECT j.id, CASE WHEN j.commit_hash IS NOT NULL THEN a.r ELSE b.r END AS exact, c.r AS cr, d.r AS dr FROM j LEFT JOIN a ON a.github_url = j.github_url AND a.commit_hash = j.commit_hash AND a.sub = j.sub LEFT JOIN b ON b.github_url = j.github_url AND b.sub = j.sub
         LEFT JOIN c ON c.github_url = j.github_url AND c.commit_hash = j.commit_hash LEFT JOIN d ON d.github_url = j.github_url)
       SELECT id, coalesce(exact, cr, dr) AS snapshot_id, exact IS NOT NULL AS exact FROM x"""))
def j9(spark, sf):
    k = F.col("id")
    jobs = V.repos(spark, sf).select("id", "github_url", F.when(k % 4 != 0, F.concat(F.lit("c"), V.text_of(k % 5))).alias("commit_hash"),
                                     F.when(k % 3 == 0, F.lit("/packages/api/")).when(k % 3 == 1, F.lit(" ")).alias("subpath"))
    return C.match_snapshots(jobs, V.repos(spark, sf))


# ---------------------------------------------------------------- symbols
@query("j12_expected_symbols", "repo_id string, tier_index int, name string, kind string, source_file string",
       tiers_query("files edges symbols", r"SELECT repo_id, tier_index, symbol AS name, CASE WHEN regexp_matches(symbol, '^\p{Lu}') AND NOT contains(symbol, '_') THEN 'class' ELSE 'function' END AS kind, min(path) AS source_file FROM symbols JOIN tiers USING (repo_id, path) GROUP BY ALL"))
def j12(spark, sf):
    return C.expected_symbols(C.exports_of(V.symbol_lists(spark, sf), B.placed_files(spark, sf), "doc_id"))


# an attempt per file: its symbols are expected; a changed copy of them was submitted
_EXPECTED = r"""ex AS (SELECT repo_id || ':' || path AS attempt, symbol AS name, CASE WHEN regexp_matches(symbol, '^[A-Z]') THEN 'class' ELSE 'function' END AS kind, CASE WHEN length(symbol) % 3 <> 0 THEN length(symbol) % 4 END AS arg_count, pos FROM symbols),
 su0 AS (SELECT *, length(name) AS len FROM ex),
 su AS (SELECT attempt, pos * 3 AS idx, name, CASE WHEN kind = 'class' THEN 'class' ELSE 'method' END AS kind, CASE WHEN kind = 'class' THEN NULL ELSE len % 4 + 1 END AS arg_count, CASE WHEN len % 2 = 0 THEN ['self'] ELSE ['x'] END AS args, len % 5 = 0 AS is_stub FROM su0 WHERE len % 7 <> 0
   UNION ALL SELECT attempt, pos * 3 + 1, name, 'function', len % 4, ['y'], len % 4 = 0 FROM su0 WHERE len % 3 = 1 UNION ALL SELECT attempt, pos * 3 + 2, name || '_extra', 'function', 0, ['z'], false FROM su0 WHERE len % 4 = 1),
 hits AS (SELECT e.attempt, e.name, min(s.idx) FILTER (NOT is_stub) AS m, min(s.idx) FILTER (is_stub) AS st FROM ex e JOIN su s ON s.attempt = e.attempt AND s.name = e.name
   AND ((e.kind = 'class' AND s.kind = 'class') OR (e.kind <> 'class' AND s.kind <> 'class')) AND (e.arg_count IS NULL OR s.arg_count IS NULL OR e.arg_count = s.arg_count OR (list_contains(s.args, 'self') AND s.arg_count - 1 = e.arg_count)) GROUP BY ALL),
 cmp AS (SELECT e.attempt, e.name, CASE WHEN m IS NOT NULL THEN 'present' ELSE 'missing' END AS status, coalesce(st IS NOT NULL AND (m IS NULL OR st < m), false) AS stub_seen, m AS match_idx FROM ex e LEFT JOIN hits h USING (attempt, name))"""


_UPPER = "^[A-Z]"


def attempts(spark, sf):
    """(attempt, symbols, words): the symbols of a file as one list, and with their place, length and case as another; one row an attempt.

    Files are dealt and ranked by attempt while they are short texts, so that both sides of a comparison read one shuffle and neither is sorted with its lists.
    """
    files = V.symbol_texts(spark, sf).select(F.concat("repo_id", F.lit(":"), "path").alias("attempt"), "words")
    own = Window.partitionBy("attempt").orderBy("attempt")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    texts = dealt_by(files, "attempt", V.table(spark, sf, "documents")).select("attempt", F.collect_list("words").over(whole).alias("texts"), F.row_number().over(own).alias("_no")).filter("_no = 1")
    split = lambda t: F.when(t != "", F.split(t, " ")).otherwise(F.array().cast("array<string>"))
    word = lambda w, i: F.struct(i.alias("pos"), w.alias("symbol"), F.length(w).alias("n"), w.rlike(_UPPER).alias("upper"))
    return texts.select("attempt", F.flatten(F.transform("texts", split)).alias("symbols"), F.flatten(F.transform("texts", lambda t: F.transform(split(t), word))).alias("words"))


def _listed(words, fields):
    """What `fields` makes of every word, as one list."""
    return F.transform(words, lambda w: F.struct(*[c.alias(n) for n, c in fields(w).items()]))


def comparison(spark, sf):
    files, n = attempts(spark, sf), F.length
    one = lambda w: F.array(F.lit(w))
    none = F.array().cast("array<string>")
    # a symbol is its own place: what is spelled alike is one expectation
    ex = files.select("attempt", _listed("symbols", lambda w: dict(name=w, kind=F.when(w.rlike(_UPPER), "class").otherwise("function"), arg_count=F.when(n(w) % 3 != 0, n(w) % 4), args=none)).alias("symbols"))
    su = files.select("attempt", F.concat(
        _listed(F.filter("words", lambda w: w["n"] % 7 != 0), lambda w: dict(
            idx=w["pos"] * 3, name=w["symbol"], kind=F.when(w["upper"], "class").otherwise("method"), arg_count=F.when(~w["upper"], w["n"] % 4 + 1),
            args=F.when(w["n"] % 2 == 0, one("self")).otherwise(one("x")), is_stub=w["n"] % 5 == 0)),
        _listed(F.filter("words", lambda w: w["n"] % 3 == 1), lambda w: dict(
            idx=w["pos"] * 3 + 1, name=w["symbol"], kind=F.lit("function"), arg_count=w["n"] % 4, args=one("y"), is_stub=w["n"] % 4 == 0)),
        _listed(F.filter("words", lambda w: w["n"] % 4 == 1), lambda w: dict(
            idx=w["pos"] * 3 + 2, name=F.concat(w["symbol"], F.lit("_extra")), kind=F.lit("function"), arg_count=F.lit(0), args=one("z"), is_stub=F.lit(False)))).alias("symbols"))
    return ex, su


@query("j11_symbol_comparison", "attempt string, name string, status string, stub_seen boolean, match_idx int",
       with_views("symbols", f"WITH {_EXPECTED} SELECT * FROM cmp"))
def j11(spark, sf):
    return C.compare_symbols(*comparison(spark, sf))[0]


@query("j11_extra_symbols", "attempt string, idx int, name string, kind string",
       with_views("symbols", f"WITH {_EXPECTED} SELECT s.attempt, s.idx, s.name, s.kind FROM su s WHERE NOT EXISTS (SELECT 1 FROM cmp c WHERE c.attempt = s.attempt AND c.match_idx = s.idx)"))
def j11_extra(spark, sf):
    return C.compare_symbols(*comparison(spark, sf))[1]


@query("j11_verdicts", "attempt string, present bigint, missing bigint, stubs bigint, verified boolean",
       with_views("symbols", f"""WITH {_EXPECTED} SELECT attempt, count(*) FILTER (status = 'present') AS present, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (stub_seen) AS stubs,
       count(*) FILTER (status = 'missing') = 0 AND count(*) FILTER (stub_seen) = 0 AS verified FROM cmp GROUP BY attempt"""))
def j11_verdicts(spark, sf):
    return C.verdicts(C.compare_symbols(*comparison(spark, sf))[0])


_BLANKS = """bx AS (SELECT repo_id || ':' || path AS attempt, CASE WHEN length(symbol) % 2 = 0 THEN 'C.' || symbol ELSE symbol END AS full_name, symbol AS name, length(symbol) % 6 = 0 AS is_trivial FROM symbols),
 bs AS (SELECT repo_id || ':' || path AS attempt, pos * 2 AS idx, CASE WHEN length(symbol) % 4 = 0 THEN 'C.' || symbol WHEN length(symbol) % 4 = 1 THEN 'D.' || symbol ELSE symbol END AS full_name, symbol AS name, length(symbol) % 3 = 0 AS is_trivial FROM symbols WHERE length(symbol) % 5 <> 0
   UNION ALL SELECT repo_id || ':' || path, pos * 2 + 1, symbol, symbol, true FROM symbols WHERE length(symbol) % 4 = 1),
 bf AS (SELECT attempt, full_name AS k, arg_max(is_trivial, idx) AS t FROM bs GROUP BY ALL), bn AS (SELECT attempt, name AS k, arg_min(is_trivial, idx) AS t FROM bs GROUP BY ALL),
 bg AS (SELECT x.attempt, x.full_name, coalesce(a.t, b.t, c.t, d.t) AS t, x.is_trivial FROM bx x LEFT JOIN bf a ON a.attempt = x.attempt AND a.k = x.full_name LEFT JOIN bn b ON b.attempt = x.attempt AND b.k = x.full_name LEFT JOIN bf c ON c.attempt = x.attempt AND c.k = x.name LEFT JOIN bn d ON d.attempt = x.attempt AND d.k = x.name),
 graded AS (SELECT attempt, full_name, CASE WHEN t IS NULL THEN 'missing' WHEN NOT t OR is_trivial THEN 'implemented' ELSE 'unimplemented_stub' END AS status FROM bg)"""


def blanks(spark, sf):
    files, n = attempts(spark, sf), F.length
    owned = lambda s, o: F.concat(F.lit(o + "."), s)
    bx = files.select("attempt", _listed("symbols", lambda w: dict(full_name=F.when(n(w) % 2 == 0, owned(w, "C")).otherwise(w), name=w, is_trivial=n(w) % 6 == 0)).alias("symbols"))
    bs = files.select("attempt", F.concat(
        _listed(F.filter("words", lambda w: w["n"] % 5 != 0), lambda w: dict(
            idx=w["pos"] * 2, full_name=F.when(w["n"] % 4 == 0, owned(w["symbol"], "C")).when(w["n"] % 4 == 1, owned(w["symbol"], "D")).otherwise(w["symbol"]), name=w["symbol"], is_trivial=w["n"] % 3 == 0)),
        _listed(F.filter("words", lambda w: w["n"] % 4 == 1), lambda w: dict(idx=w["pos"] * 2 + 1, full_name=w["symbol"], name=w["symbol"], is_trivial=F.lit(True)))).alias("symbols"))
    return C.grade_blanks(bx, bs)


@query("j13_blank_grading", "attempt string, full_name string, status string", with_views("symbols", f"WITH {_BLANKS} SELECT * FROM graded"))
def j13(spark, sf):
    return blanks(spark, sf)


@query("j13_blank_verdicts", "attempt string, total bigint, implemented bigint, passed boolean",
       with_views("symbols", f"WITH {_BLANKS} SELECT attempt, count(*) AS total, count(*) FILTER (status = 'implemented') AS implemented, bool_and(status = 'implemented') AS passed FROM graded GROUP BY attempt"))
def j13_verdicts(spark, sf):
    return C.blank_verdicts(blanks(spark, sf))


# ---------------------------------------------------------------- curated expectations
_NAMES = ["Pallets/flask", "someone/requests", "https://github.com/tiangolo/fastapi.git", "acme/x", "demo-repo", "reverse/demo-repo", ""]
_CURATED_SQL = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {t}, '{e}')" for i, (k, t, e) in enumerate(C.CURATED)) + ") AS r(place, repo_key, tier, expected))"
_MILES_SQL = f"""ms0 AS (SELECT p_partkey AS id, {_NAMES}[p_partkey % {len(_NAMES)} + 1] AS nm, CAST(p_partkey % 3 AS INT) AS tier, CASE WHEN p_size % 10 = 0 THEN 'out ' || p_name ELSE '' END AS me, CASE WHEN p_size % 7 = 0 THEN 'graph ' || p_type END AS ge FROM part),
 ms1 AS (SELECT *, lower(trim(regexp_replace(regexp_replace(nm, '^https?://github\\.com/', ''), '\\.git$', ''))) AS bare FROM ms0),
 ms AS (SELECT *, CASE WHEN contains(bare, '/') THEN string_split(bare, '/')[-2] || '/' || string_split(bare, '/')[-1] WHEN bare <> '' THEN bare END AS repo_key FROM ms1),
 mc AS (SELECT m.*, r.expected AS k, (SELECT arg_min(expected, place) FROM reg WHERE contains(m.repo_key, '/') AND ends_with(reg.repo_key, '/' || string_split(m.repo_key, '/')[-1]) AND reg.tier = m.tier) AS b FROM ms m LEFT JOIN reg r ON r.repo_key = m.repo_key AND r.tier = m.tier)"""


def milestones(spark, sf):
    p, k, size = V.table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    return p.select(k.alias("id"), repository_key(V.pick(_NAMES, k % len(_NAMES)), F.lit(None).cast("string")).alias("repo_key"), (k % 3).cast("int").alias("tier"),
                    F.when(size % 10 == 0, F.concat(F.lit("out "), "p_name")).otherwise("").alias("milestone_expected"), F.when(size % 7 == 0, F.concat(F.lit("graph "), "p_type")).alias("graph_expected"), "p_name")


@query("j14_curated_expectations", "id bigint, tier int, expected string, source string",
       f"WITH {_CURATED_SQL}, {_MILES_SQL} SELECT id, tier, coalesce(nullif(me, ''), ge, k, b) AS expected, CASE WHEN me <> '' THEN 'milestone' WHEN ge IS NOT NULL THEN 'graph' WHEN k IS NOT NULL THEN 'registry' WHEN b IS NOT NULL THEN 'basename' END AS source FROM mc")
def j14(spark, sf):
    return C.curated_output(milestones(spark, sf), C.curated_registry(spark))


@query("c16_grading_method", "id bigint, method string",
       f"""WITH {_CURATED_SQL}, {_MILES_SQL} SELECT id, CASE WHEN id % 8 = 0 OR id % 13 = 0 THEN 'real_tests' WHEN coalesce(nullif(me, ''), ge, k, b) IS NOT NULL THEN 'expected_output' ELSE 'structural_only' END AS method FROM mc""")
def c16(spark, sf):
    ms = milestones(spark, sf)
    k = F.col("id")
    node = F.when(k % 13 == 0, F.lit("pkg/test_core.py")).when(k % 8 == 0, F.lit("core_test.go")).otherwise(F.lit("pkg/latest.py"))
    tests = ms.select("id", C.is_test_node(node).alias("has_tests"))
    return C.curated_output(ms, C.curated_registry(spark)).join(tests, "id").select("id", C.grading_method(F.col("has_tests"), F.col("expected")).alias("method"))


# ---------------------------------------------------------------- texts; rows only, because SQL engines without look-behind cannot split them
def narratives(spark, sf):
    """A conversation is a milestone about one file, of all repositories' files in turn; some turns mention files, their own or another's."""
    c = V.table(spark, sf, "conversations").filter("text <> ''")
    own = B.file_table(spark, sf)
    sizes = own.groupBy("repo_id").agg(F.count(F.lit(1)).alias("size"))
    repo = F.concat(F.lit("src"), V.text_of(F.col("conv_id") % 20)).alias("repo_id")
    t = c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), V.text_of(F.col("conv_id")).alias("milestone"), "turn", "text", "conv_id", repo)
    t = t.join(sizes, "repo_id", "left").withColumn("n", F.floor(F.col("conv_id") / 20) % F.col("size"))
    joined = t.join(own.select("repo_id", "n", "path"), ["repo_id", "n"], "left")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" See `"), F.coalesce("path", F.lit("a.py")), F.lit("` first. Moreover, it runs. "))).when(
        F.col("turn") % 3 == 1, F.lit(" Then other/gone.py fails. Furthermore, nothing else does. ")).otherwise(F.lit(""))
    return joined.select("id", "milestone", F.concat("text", said, F.lit("Done.")).alias("text"), F.coalesce("path", F.lit("a.py")).alias("path"))


def narrative_members(spark, sf):
    return narratives(spark, sf).select("milestone", "path").distinct()


@query("s13_clean_sentences", "id string, removed int, use_fallback boolean, cleaned string")
def s13(spark, sf):
    return C.clean_texts(narratives(spark, sf).drop("path"), narrative_members(spark, sf))


@query("j16_foreign_mentions", "id string, pos int, mention string")
def j16(spark, sf):
    return C.foreign_mentions(narratives(spark, sf), narrative_members(spark, sf))


# ---------------------------------------------------------------- stores
@query("j17_store_reconciliation", "c_custkey bigint, field string, left_value string, right_value string, status string",
       """WITH r AS (SELECT c_custkey + CASE WHEN c_custkey % 50 = 0 THEN 10000000 ELSE 0 END AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 13 <> 0),
       f AS (SELECT coalesce(l.c_custkey, r.c_custkey) AS c_custkey, l.c_custkey IS NULL AS nl, r.c_custkey IS NULL AS nr, l.c_name AS a1, r.c_name AS b1, CAST(l.c_nationkey AS VARCHAR) AS a2, CAST(r.c_nationkey AS VARCHAR) AS b2, l.c_mktsegment AS a3, r.c_mktsegment AS b3 FROM customer l FULL JOIN r ON r.c_custkey = l.c_custkey),
       u AS (SELECT c_custkey, nl, nr, 'c_name' AS field, a1 AS left_value, b1 AS right_value FROM f UNION ALL SELECT c_custkey, nl, nr, 'c_nationkey', a2, b2 FROM f UNION ALL SELECT c_custkey, nl, nr, 'c_mktsegment', a3, b3 FROM f)
       SELECT c_custkey, field, left_value, right_value, CASE WHEN nl THEN 'only_right' WHEN nr THEN 'only_left' ELSE 'differs' END AS status FROM u WHERE left_value IS DISTINCT FROM right_value""")
def j17(spark, sf):
    a = V.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    b = a.filter(k % 13 != 0).select((k + F.when(k % 50 == 0, 10000000).otherwise(0)).alias("c_custkey"), F.when(k % 7 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"),
                                     "c_nationkey", F.when(k % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return C.reconcile(a, b, "c_custkey")


def _reference(spark, sf):
    members = B.tiers(spark, sf).select("repo_id", "tier_index", F.concat(F.lit("checkout/"), "path").alias("path"))
    contents = V.files(spark, sf).filter("n % 4 <> 1").select("repo_id", "path", "content")
    return members, C.reference_pieces(members, contents)


# every 4th file's source is missing; a suffix or, failing that, an equal file name finds a stand-in
_REFERENCE_SQL = r"""have AS (SELECT * FROM files WHERE n % 4 <> 1), mem AS (SELECT repo_id, tier_index, path, 'checkout/' || path AS p FROM tiers),
 cand AS (SELECT m.repo_id, m.tier_index, m.p, h.path, CASE WHEN h.path = m.path THEN 2 ELSE 3 END AS rank FROM mem m JOIN have h ON h.repo_id = m.repo_id AND (ends_with(m.p, '/' || h.path) OR regexp_extract(h.path, '([^/]*)$', 1) = regexp_extract(m.p, '([^/]*)$', 1))),
 hit AS (SELECT repo_id, tier_index, p, min((rank, path)) AS b, arg_min(path, (rank, path)) AS match FROM cand GROUP BY ALL),
 pc AS (SELECT h.repo_id, h.tier_index, h.p AS path, f.content, count(*) OVER (PARTITION BY h.repo_id, h.tier_index) AS pieces FROM hit h JOIN files f ON f.repo_id = h.repo_id AND f.path = h.match WHERE f.content <> '')"""


@query("j19_reference_pieces", "repo_id string, tier_index int, path string, pieces bigint, digest string",
       tiers_query("files edges", f"""WITH {_REFERENCE_SQL} SELECT repo_id, tier_index, path, pieces, md5(CASE WHEN pieces > 1 THEN '# ' || repeat('=', 68) || chr(10) || '# File: ' || path || chr(10) || '# ' || repeat('=', 68) || chr(10) || content ELSE content END) AS digest FROM pc"""))
def j19(spark, sf):
    return _reference(spark, sf)[1].withColumn("digest", F.md5("piece"))


@query("j19_source_availability", "repo_id string, tier_index int, files bigint, found bigint, has_real_source boolean",
       tiers_query("files edges", f"""WITH {_REFERENCE_SQL} SELECT m.repo_id, m.tier_index, count(*) AS files, count(pc.path) AS found, count(pc.path) > 0 AS has_real_source FROM mem m LEFT JOIN pc ON pc.repo_id = m.repo_id AND pc.tier_index = m.tier_index AND pc.path = m.p GROUP BY ALL"""))
def j19_available(spark, sf):
    return C.source_availability(*_reference(spark, sf))


@query("s17_submission_symbols", "attempt string, idx int, name string, full_name string, kind string, arg_count int, is_stub boolean, failed boolean",
       with_views("code", """WITH p AS (SELECT repo_id || ':' || path AS attempt, n FROM code WHERE path LIKE '%.py')
       SELECT attempt, 0 AS idx, 'C' || n AS name, 'C' || n AS full_name, 'class' AS kind, NULL AS arg_count, false AS is_stub, false AS failed FROM p WHERE n % 56 <> 48 UNION ALL SELECT attempt, 1, 'run', 'C' || n || '.run', 'method', 1, false, false FROM p WHERE n % 56 <> 48
       UNION ALL SELECT attempt, 2, 'main', 'main', 'function', 0, true, false FROM p WHERE n % 56 <> 48 UNION ALL SELECT attempt, 0, NULL, NULL, NULL, NULL, false, true FROM p WHERE n % 56 = 48"""))
def s17(spark, sf):
    code = V.code(spark, sf).filter(F.col("path").endswith(".py"))
    out = C.submitted_symbols(code.select(F.concat("repo_id", F.lit(":"), "path").alias("attempt"), F.col("content").alias("code")))
    return out.withColumn("failed", F.col("error").isNotNull())
