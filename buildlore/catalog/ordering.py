from pyspark.sql import functions as F

from buildlore.catalog.base import query
from buildlore.catalog.graph import _vote_sql, members, tiers_query
from buildlore.catalog.sqlviews import text_list, text_set, with_views
from buildlore.functions import rules as R
from buildlore.operators import graph as G
from buildlore.operators import history as H
from buildlore.operators import ordering as O
from buildlore.operators.scale import ordered_positions
from buildlore.plans import build_order as B
from buildlore.plans import views as V

# ---------------------------------------------------------------- conventions
_EXT = r"regexp_extract(name, '^\.*[^.].*?(\.[^.]*)$', 1)"


def _under(folders):
    return f"len(list_intersect(above, {text_list(folders)})) > 0"


def classify_sql(source: str, keep: str, language: str | None = None) -> str:
    """CTEs ending in `classified(keep..., domain, confidence)`."""
    known = f"coalesce({language} IN {text_set(R.CODE_LANGUAGES)}, false)" if language else "false"
    core_dir = f"(len(ps) > 1 AND ps[1] IN {text_set(R.CORE_FOLDERS)} AND {known})"
    return rf"""cp AS (SELECT {keep}, string_split(lower(trim(replace(path, '\', '/'), '/')), '/') AS ps {', ' + language if language else ''} FROM {source}),
 cn AS (SELECT *, ps[-1] AS name, ps[1:len(ps)-1] AS above FROM cp), ce AS (SELECT *, {_EXT} AS ext FROM cn), cs AS (SELECT *, substr(name, 1, length(name) - length(ext)) AS stem, ext IN {text_set(R.CODE_EXTENSIONS)} AS code FROM ce),
 cd AS (SELECT *, CASE WHEN {_under(R.TEST_FOLDERS)} OR regexp_matches(name, '^test_|[._](test|spec)\.') THEN 'tests'
   WHEN name IN {text_set(R.CONFIG_FILES)} OR {_under(R.CONFIG_FOLDERS)} OR regexp_matches(name, '^(\.env|dockerfile|\.eslint|\.prettier)') OR ext IN {text_set(R.CONFIG_EXTENSIONS)} THEN 'config'
   WHEN {_under(R.DOC_FOLDERS)} OR regexp_matches(stem, '^({"|".join(R.DOC_FILES)})') OR ext IN {text_set(R.DOC_EXTENSIONS)} THEN 'docs'
   WHEN {_under(R.DATABASE_FOLDERS)} OR ext IN {text_set(R.DATABASE_EXTENSIONS)} THEN 'database' WHEN {_under(R.EXAMPLE_FOLDERS)} THEN 'examples'
   WHEN {_under(R.FRONTEND_FOLDERS)} OR ext IN {text_set(R.FRONTEND_EXTENSIONS)} THEN 'frontend'
   WHEN {_under(R.BACKEND_FOLDERS)} OR name IN {text_set(R.BACKEND_FILES)} OR regexp_matches(stem, '{"|".join(R.BACKEND_WORDS)}') THEN 'backend'
   WHEN code OR {core_dir} THEN 'core' ELSE 'uncategorized' END AS domain FROM cs),
 classified AS (SELECT {keep}, domain, CASE WHEN domain = 'uncategorized' THEN 'low' WHEN domain = 'core' AND NOT (({_under(R.CORE_FOLDERS)} AND code) OR {core_dir} OR (code AND len(ps) = 1)) THEN 'medium' ELSE 'high' END AS confidence FROM cd)"""


CLASSIFIED = classify_sql("files", "repo_id, path")
_ODD = ["Test_x.py", "a.spec.ts", "Dockerfile.dev", "CHANGELOG", "core/routes.py", "user_controller.rb", "zzz/x.py", "src/blob.xyz", "x.py", "conf/app.ini", "readme_first.xyz", "man/page.1", "lib/.env.local"]


@query("c1_domain_rules", "repo_id string, path string, domain string, confidence string",
       with_views("files", f"WITH src AS (SELECT repo_id, path, lang FROM (SELECT repo_id, path, NULL AS lang FROM files UNION ALL SELECT repo_id, 'p' || n || '/' || {text_list(_ODD)}[n % {len(_ODD)} + 1], NULL FROM files UNION ALL SELECT repo_id, 'src/p' || n || '.bin2', CASE WHEN n % 2 = 0 THEN 'go' END FROM files)), {classify_sql('src', 'repo_id, path', 'lang')} SELECT * FROM classified"))
def c1(spark, sf):
    fs, n = V.files(spark, sf), F.col("n")
    none = F.lit(None).cast("string").alias("language")
    odd = F.concat(F.lit("p"), V.text_of(n), F.lit("/"), V.pick(_ODD, n % len(_ODD)))
    known = F.concat(F.lit("src/p"), V.text_of(n), F.lit(".bin2"))
    src = fs.select("repo_id", "path", none).unionByName(fs.select("repo_id", odd.alias("path"), none)).unionByName(
        fs.select("repo_id", known.alias("path"), F.when(n % 2 == 0, F.lit("go")).alias("language")))
    return O.convention_domains(src)


_SEGMENT_SQL = f"""{CLASSIFIED}, {_vote_sql('classified')}, segmented AS (SELECT c.repo_id, c.path, CASE WHEN c.domain <> 'uncategorized' THEN c.domain ELSE v.domain END AS domain,
  CASE WHEN c.domain <> 'uncategorized' THEN 'convention' WHEN v.domain <> 'uncategorized' THEN 'graph' ELSE 'uncategorized' END AS method,
  CASE WHEN c.domain <> 'uncategorized' THEN c.confidence WHEN v.domain <> 'uncategorized' THEN 'medium' ELSE 'low' END AS confidence FROM classified c LEFT JOIN voted v USING (repo_id, path))"""


@query("g10_community_vote", "repo_id string, path string, domain string",
       with_views("files edges", f"WITH {CLASSIFIED}, {_vote_sql('classified')} SELECT repo_id, path, domain FROM voted", recursive=True))
def g10(spark, sf):
    return G.community_vote(members(spark, sf))


def segmented(spark, sf):
    return O.segment(V.files(spark, sf), members(spark, sf).select("repo_id", "path", "community"))


@query("c2_segment_repository", "repo_id string, path string, domain string, method string, confidence string",
       with_views("files edges", f"WITH {_SEGMENT_SQL} SELECT * FROM segmented", recursive=True))
def c2(spark, sf):
    return segmented(spark, sf)


@query("c3_domain_method_counts", "repo_id string, kind string, value string, files bigint",
       with_views("files edges", f"WITH {_SEGMENT_SQL} SELECT repo_id, 'domain' AS kind, domain AS value, count(*) AS files FROM segmented GROUP BY ALL UNION ALL SELECT repo_id, 'method', method, count(*) FROM segmented GROUP BY ALL", recursive=True))
def c3(spark, sf):
    return O.value_counts(segmented(spark, sf), "domain", "method")


# ---------------------------------------------------------------- history
def log(spark, sf):
    return V.changes(spark, sf).select(F.lit("all").alias("repo_id"), F.col("commit_no").alias("commit"), "ts", "line_no", "path", "old_path")


SEEN_SQL = """ch AS (SELECT commit_no AS c, ts, line_no AS l, path, old_path, coalesce(old_path, '') AS o FROM changes),
 oldest AS (SELECT path, arg_min({'c': c, 'ts': ts, 'old': old_path}, (ts, c, -l, o)) AS f, max((ts, c, -l)) AS entered, min((ts, c, -l, o)) AS born FROM ch GROUP BY path),
 seen AS (SELECT path, f.c AS commit, f.ts AS ts, f.old IS NOT NULL AS was_rename, f.old AS original_path, entered, f.ts AS bts, f.c AS bc FROM oldest)"""
RENAMED_SQL = f"""{SEEN_SQL}, ln AS (SELECT s.*, o.commit AS oc, o.ts AS ot, s.was_rename AND o.path IS NOT NULL AS linked, s.was_rename AND o.path IS NOT NULL AND (o.entered > s.entered OR (o.entered = s.entered AND o.path > s.path)) AS earlier FROM seen s LEFT JOIN seen o ON o.path = s.original_path),
 nd AS (SELECT path, was_rename, original_path, CASE WHEN earlier THEN original_path END AS ptr, CASE WHEN linked AND NOT earlier THEN oc ELSE commit END AS commit, CASE WHEN linked AND NOT earlier THEN ot ELSE ts END AS ts FROM ln),
 go(path, cur) AS (SELECT path, path FROM nd UNION ALL SELECT g.path, n.ptr FROM go g JOIN nd n ON n.path = g.cur WHERE n.ptr IS NOT NULL),
 dated AS (SELECT g.path, e.commit, e.ts, n.was_rename, n.original_path FROM go g JOIN nd e ON e.path = g.cur AND e.ptr IS NULL JOIN nd n ON n.path = g.path)"""
FIXED_SQL = f"""{RENAMED_SQL}, shared AS (SELECT ts FROM dated GROUP BY ts HAVING count(*) >= 2),
 nd2 AS (SELECT s.path, s.commit, s.ts, CASE WHEN s.was_rename AND (o.bts < s.bts OR (o.bts = s.bts AND o.bc < s.bc)) THEN o.path END AS ptr FROM seen s LEFT JOIN seen o ON o.path = s.original_path),
 go2(path, cur) AS (SELECT path, path FROM nd2 UNION ALL SELECT g.path, n.ptr FROM go2 g JOIN nd2 n ON n.path = g.cur WHERE n.ptr IS NOT NULL),
 fixed AS (SELECT d.path, CASE WHEN d.ts IN (FROM shared) AND e.ts <> d.ts THEN e.commit ELSE d.commit END AS commit, CASE WHEN d.ts IN (FROM shared) AND e.ts <> d.ts THEN e.ts ELSE d.ts END AS ts, d.ts IN (FROM shared) AND e.ts <> d.ts AS corrected
   FROM dated d JOIN go2 g ON g.path = d.path JOIN nd2 e ON e.path = g.cur AND e.ptr IS NULL)"""


@query("c4_first_appearance", "path string, commit bigint, ts timestamp, was_rename boolean, original_path string",
       with_views("changes", f"WITH {SEEN_SQL} SELECT path, commit, ts, was_rename, original_path FROM seen"))
def c4(spark, sf):
    return H.first_seen(log(spark, sf))


@query("c5_rename_propagation", "path string, commit bigint, ts timestamp, was_rename boolean, original_path string",
       with_views("changes", f"WITH {RENAMED_SQL} SELECT path, commit, ts, was_rename, original_path FROM dated", recursive=True))
def c5(spark, sf):
    return H.propagate_renames(H.first_seen(log(spark, sf)))


@query("c6_restructure_correction", "path string, commit bigint, ts timestamp, corrected boolean",
       with_views("changes", f"WITH {FIXED_SQL} SELECT path, commit, ts, corrected FROM fixed", recursive=True))
def c6(spark, sf):
    seen = H.first_seen(log(spark, sf))
    return H.correct_restructures(H.propagate_renames(seen), seen)


@query("c7_history_confidence", "o_custkey bigint, total bigint, unique_paths bigint, confidence string",
       """SELECT o_custkey, total, unique_paths, CASE WHEN o_custkey % 7 = 0 THEN 'reduced' WHEN total > 0 AND (CASE WHEN o_custkey % 11 = 0 THEN total - 1 ELSE total END) < total THEN 'reduced' WHEN total < 3 AND unique_paths > 10 THEN 'reduced' WHEN total = 1 AND unique_paths > 3 THEN 'reduced' ELSE 'high' END AS confidence
       FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS total, count(DISTINCT l_partkey) AS unique_paths FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)""")
def c7(spark, sf):
    both = V.table(spark, sf, "orders").join(V.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    # distinct pairs first: a customer's orders and parts then are counted from rows, not held in one aggregation buffer
    orders = both.select("o_custkey", "o_orderkey").distinct().groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"))
    paths = both.select("o_custkey", "l_partkey").distinct().groupBy("o_custkey").agg(F.count(F.lit(1)).alias("unique_paths"))
    done = F.when(F.col("o_custkey") % 11 == 0, F.col("total") - 1).otherwise(F.col("total"))
    return orders.join(paths, "o_custkey").withColumn("confidence", H.history_confidence(F.col("total"), done, F.col("unique_paths"), F.col("o_custkey") % 7 == 0))


# ---------------------------------------------------------------- tie-breaks and confidence
# first-seen dates: file number decides; every 5th repository has reduced history, every 6th misses dates
def dated_files(spark, sf):
    n, r = F.col("n"), F.substring("repo_id", 4, 9).cast("int")
    fs = B.file_table(spark, sf).filter(~((r % 6 == 0) & (n % 13 == 0)))
    return fs.select("repo_id", "path", F.timestamp_add("DAY", F.floor(n / 3).cast("int"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"))


def histories(spark, sf):
    r = F.substring("repo_id", 4, 9).cast("int")
    return B.file_table(spark, sf).select("repo_id").distinct().select(
        "repo_id", (r % 4 != 0).alias("available"), F.when(r % 5 == 0, "reduced").otherwise("high").alias("confidence"))


def groups(spark, sf):
    tiers = B.tiers(spark, sf).select("repo_id", "tier_index", "is_cyclic", "path")
    domains = B.domain_table(spark, sf).select("repo_id", "path", "domain")
    return O.tie_groups(tiers.join(domains, ["repo_id", "path"], "left"), dated_files(spark, sf), histories(spark, sf))


def proposals(spark, sf):
    """Orders proposed for the groups nothing else decides: reversed; every third repository's last file is misnamed."""
    left = O.break_ties(groups(spark, sf)).filter("method = 'unresolved'").select("repo_id", "tier_index", "group_key", "path", "group_size")
    placed = ordered_positions(left, ["repo_id", "tier_index", "group_key"], ["path"], "p")
    r = F.substring("repo_id", 4, 9).cast("int")
    last = F.col("p") == F.col("group_size")
    return placed.select("repo_id", "tier_index", "group_key", (F.col("group_size") - F.col("p")).alias("pos"),
                         F.when(last & (r % 3 == 0), F.lit("elsewhere.py")).otherwise(F.col("path")).alias("path"))


_PRIO = "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.DOMAIN_PRIORITY.items()) + " ELSE 8 END"
GROUPS_SQL = f"""{CLASSIFIED}, rn AS (SELECT repo_id, path, n, CAST(substr(repo_id, 4) AS INT) AS r FROM files),
 tf AS (SELECT t.repo_id, t.tier_index, t.is_cyclic, t.path, c.domain, {_PRIO} AS prio, CASE WHEN r % 6 = 0 AND n % 13 = 0 THEN NULL ELSE n // 3 END AS day, r % 4 <> 0 AND r % 5 <> 0 AS usable, r FROM tiers t JOIN rn USING (repo_id, path) JOIN classified c USING (repo_id, path)),
 tw AS (SELECT *, count(*) OVER w AS tier_size, usable AND count(day) OVER w = count(*) OVER w AND min(day) OVER w <> max(day) OVER w AS by_history FROM tf WINDOW w AS (PARTITION BY repo_id, tier_index)),
 tg AS (SELECT *, CASE WHEN by_history THEN day ELSE -1 END AS gkey FROM tw),
 grouped AS (SELECT *, count(*) OVER g AS group_size, min(prio) OVER g <> max(prio) OVER g AS mixed FROM tg WINDOW g AS (PARTITION BY repo_id, tier_index, gkey)),
 refined AS (SELECT *, CASE WHEN tier_size = 1 THEN 'none' WHEN by_history AND group_size = 1 THEN 'history' WHEN mixed THEN 'heuristic' ELSE 'unresolved' END AS method FROM grouped)"""
SCORED_SQL = f"""{GROUPS_SQL}, scored AS (SELECT repo_id, path, tier_index, is_cyclic, domain, method, (gkey, CASE WHEN method = 'heuristic' THEN prio ELSE 0 END, path) AS place,
  CASE WHEN is_cyclic OR (r % 4 <> 0 AND r % 5 = 0) OR method = 'unresolved' THEN 'low' WHEN method IN ('none', 'history') THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN is_cyclic THEN 'cyclic cluster (circular dependency)' WHEN r % 4 <> 0 AND r % 5 = 0 THEN 'reduced history confidence (squashed or rebased commits)' WHEN method = 'unresolved' THEN 'unresolved tie within tier'
   WHEN method = 'none' THEN 'topology (hard dependency fact)' WHEN method = 'history' THEN 'topology + verified history' ELSE 'topology + domain heuristic tie-break' END AS reason FROM refined
  UNION ALL SELECT f.repo_id, f.path, -1, false, c.domain, 'none', (-1, 0, f.path), 'low', 'isolated, no internal dependency signal' FROM files f JOIN classified c USING (repo_id, path) WHERE NOT EXISTS (SELECT 1 FROM tiers t WHERE t.repo_id = f.repo_id AND t.path = f.path))"""


def scored(spark, sf):
    """Every file with tier, domain, method, confidence and reason."""
    refined = O.break_ties(groups(spark, sf))
    ranked = O.score(refined, histories(spark, sf)).select("repo_id", "path", "tier_index", "is_cyclic", "domain", "method", "confidence", "reason", "group_key", "rank")
    alone = O.score_isolated(G.isolated(B.file_table(spark, sf), B.edge_table(spark, sf)))
    domains = B.domain_table(spark, sf).select("repo_id", "path", "domain")
    alone = alone.join(domains, ["repo_id", "path"]).withColumns({"is_cyclic": F.lit(False), "group_key": F.lit(-1).cast("bigint"), "rank": F.lit(0)})
    return ranked.unionByName(alone.select(*ranked.columns))


def scored_table(spark, sf):
    from buildlore.session import staged

    return staged(spark, "scored", sf, lambda: scored(spark, sf))


@query("j7_first_seen_join", "repo_id string, path string, ts timestamp",
       with_views("files", "SELECT repo_id, path, CASE WHEN CAST(substr(repo_id, 4) AS INT) % 6 = 0 AND n % 13 = 0 THEN NULL ELSE TIMESTAMP '2020-01-01' + to_days(CAST(n // 3 AS INT)) END AS ts FROM files"))
def j7(spark, sf):
    return B.file_table(spark, sf).select("repo_id", "path").join(dated_files(spark, sf), ["repo_id", "path"], "left")


@query("c8_history_tie_break", "repo_id string, tier_index int, path string, by_history boolean, group_size bigint, method string",
       tiers_query("files edges", f"WITH {GROUPS_SQL} SELECT repo_id, tier_index, path, by_history, group_size, method FROM refined"))
def c8(spark, sf):
    return O.break_ties(groups(spark, sf))


@query("c9_refined_order", "repo_id string, tier_index int, path string, method string, pos bigint",
       tiers_query("files edges", f"WITH {GROUPS_SQL} SELECT repo_id, tier_index, path, method, row_number() OVER (PARTITION BY repo_id, tier_index ORDER BY gkey, CASE WHEN method = 'heuristic' THEN prio ELSE 0 END, path) AS pos FROM refined"))
def c9(spark, sf):
    keep = O.break_ties(groups(spark, sf)).select("repo_id", "tier_index", "group_key", "rank", "path", "method")
    return ordered_positions(keep, ["repo_id", "tier_index"], ["group_key", "rank", "path"], "pos")


@query("c10_proposed_orders", "repo_id string, tier_index int, path string, method string, rank bigint",
       tiers_query("files edges", f"""WITH {GROUPS_SQL} SELECT repo_id, tier_index, path, CASE WHEN method = 'unresolved' AND r % 3 <> 0 THEN 'llm' ELSE method END AS method,
       CASE WHEN method = 'heuristic' THEN prio WHEN method = 'unresolved' AND r % 3 <> 0 THEN group_size - row_number() OVER (PARTITION BY repo_id, tier_index, gkey ORDER BY path) ELSE 0 END AS rank FROM refined"""))
def c10(spark, sf):
    return O.break_ties(groups(spark, sf), proposals(spark, sf))


@query("c11_file_confidence", "repo_id string, path string, tier_index int, method string, confidence string, reason string",
       tiers_query("files edges", f"WITH {SCORED_SQL} SELECT repo_id, path, tier_index, method, confidence, reason FROM scored"))
def c11(spark, sf):
    return scored(spark, sf)


SUMMARY_SQL = "SELECT repo_id, round_even(count(*) FILTER (confidence = 'high') / count(*) * 100.0, 2) AS high_pct, round_even(count(*) FILTER (confidence = 'medium') / count(*) * 100.0, 2) AS medium_pct, round_even(count(*) FILTER (confidence = 'low') / count(*) * 100.0, 2) AS low_pct FROM scored GROUP BY repo_id"


@query("c12_confidence_summary", "repo_id string, high_pct double, medium_pct double, low_pct double",
       tiers_query("files edges", f"WITH {SCORED_SQL} {SUMMARY_SQL}"))
def c12(spark, sf):
    return O.confidence_summary(scored_table(spark, sf), B.file_table(spark, sf))


@query("build_order_report", "repo_id string, path string, tier_index int, domain string, method string, confidence string, reason string, high_pct double",
       tiers_query("files edges", f"WITH {SCORED_SQL}, s AS ({SUMMARY_SQL}) SELECT repo_id, path, tier_index, domain, method, confidence, reason, high_pct FROM scored JOIN s USING (repo_id)"))
def build_order_report(spark, sf):
    """The flagship question: in what order were the files built, and how sure are we."""
    files = scored_table(spark, sf)
    return files.join(O.confidence_summary(files, files), "repo_id")
