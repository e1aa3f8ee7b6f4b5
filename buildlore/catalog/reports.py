from pyspark.sql import functions as F

from buildlore.catalog.base import query
from buildlore.catalog.corpus import _RECORDED_SQL, recorded
from buildlore.catalog.graph import tiers_query
from buildlore.catalog.milestones import FACTS_SQL, described, fallback_sql
from buildlore.catalog.sqlviews import NOW_SQL, lines_sql, with_views
from buildlore.functions import paths as P
from buildlore.functions import text as X
from buildlore.operators import corpus as C
from buildlore.operators import reports as R
from buildlore.plans import build_order as B
from buildlore.plans import views as V
from buildlore.session import shared_folder
from buildlore.sources import sinks as S

_DOC = "d AS (SELECT *, CASE WHEN json_valid(graph_json) THEN graph_json ELSE '{}' END AS g FROM jobs)"


@query("a5_stored_documents", "id bigint, path string, tier int, domain string, exports int",
       with_views("jobs", f"""WITH {_DOC}, n AS (SELECT id, unnest(CASE WHEN json_array_length(g, '$.nodes') > 0 THEN json_extract(g, '$.nodes[*]') ELSE [NULL] END) AS node FROM d)
       SELECT id, json_extract_string(node, '$.id') AS path, CAST(json_extract(node, '$.tier') AS INT) AS tier, json_extract_string(node, '$.domain') AS domain, coalesce(json_array_length(node, '$.exports'), 0) AS exports FROM n"""))
def a5(spark, sf):
    return R.document_nodes(V.jobs(spark, sf))


@query("a6_event_sink", "event_type string, stored bigint, users bigint",
       "SELECT event_type, 2 * count(*) AS stored, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a6(spark, sf):
    import uuid

    place = f"{shared_folder(spark)}/buildlore-log-{uuid.uuid4().hex}"
    e = V.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    for _ in range(2):
        S.append_events(e, place, "event_type")
    log = spark.read.parquet(place)
    users = log.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("stored")).join(users, "event_type")


@query("a7_snapshot_upsert", "github_url string, commit_hash string, id bigint, status string",
       with_views("repos", "SELECT github_url, commit_hash, max(id) AS id, arg_max(status, id) AS status FROM repos GROUP BY ALL"))
def a7(spark, sf):
    import uuid

    place = f"{shared_folder(spark)}/buildlore-snapshots-{uuid.uuid4().hex}"
    r = V.repos(spark, sf).select("github_url", "commit_hash", "id", "status")
    # the first half arrives, then everything again: later versions win, earlier ones change nothing
    for part in (r.filter("created_at < TIMESTAMP_NTZ '1998-01-01'"), r):
        S.upsert_snapshots(part, place, ["github_url", "commit_hash"], "id", 8)
    return spark.read.parquet(place)


@query("a8_graph_export", "repo_id string, kind string, payload string",
       tiers_query("files edges symbols", f"""WITH {FACTS_SQL}, xp AS (SELECT repo_id, path, list_sort(list(symbol)) AS exports FROM symbols GROUP BY ALL),
       nd AS (SELECT t.repo_id, t.path, t.tier_index, CASE WHEN f.dominant_domain = 'mixed' THEN {fallback_sql('graph', 'lower(t.path)')} ELSE f.dominant_domain END AS domain, f.dominant_confidence, f.is_cyclic, coalesce(x.exports, []) AS exports FROM tiers t JOIN facts f ON f.repo_id = t.repo_id AND f.tier_index = t.tier_index LEFT JOIN xp x ON x.repo_id = t.repo_id AND x.path = t.path)
       SELECT repo_id, 'node' AS kind, to_json({{'id': path, 'label': string_split(path, '/')[-1], 'path': path, 'tier': tier_index, 'domain': domain, 'color': CASE domain {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.DOMAIN_COLOURS.items())} ELSE '{R.OTHER_COLOUR}' END, 'confidence': dominant_confidence, 'is_cyclic': is_cyclic, 'is_isolated': false, 'exports': exports}}) AS payload FROM nd
       UNION ALL SELECT repo_id, 'edge', to_json({{'source': source, 'target': target, 'type': 'import'}}) FROM valid UNION ALL SELECT repo_id, 'tier', to_json({{'tier': tier_index, 'path': path}}) FROM tiers
       UNION ALL SELECT f.repo_id, 'overview', to_json({{'repo_name': f.repo_id, 'total_nodes': (SELECT count(*) FROM tiers t WHERE t.repo_id = f.repo_id), 'total_files': count(*)}}) FROM files f GROUP BY f.repo_id"""))
def a8(spark, sf):
    members = B.tiers(spark, sf)
    return (
        R.graph_nodes(members, described(spark, sf), V.symbols(spark, sf)).unionByName(R.graph_edges(B.edge_table(spark, sf)))
        .unionByName(R.graph_tiers(members)).unionByName(R.graph_overview(members, B.file_table(spark, sf))))


@query("h15_learning_progress", "id bigint, verified bigint, milestones bigint, pct int",
       with_views("jobs attempts", f"""WITH {_DOC}, v AS (SELECT job_id, count(*) AS verified FROM attempts WHERE status = 'structurally_verified' GROUP BY job_id),
       t AS (SELECT id, coalesce(verified, 0) AS verified, CASE WHEN json_array_length(g, '$.nodes') > 0 THEN len(list_distinct(json_extract(g, '$.nodes[*].tier'))) ELSE 0 END AS tiers, len(regexp_extract_all(coalesce(markdown, ''), '###\\s+Milestone\\s+\\d+:')) AS told FROM d LEFT JOIN v ON v.job_id = d.id WHERE status = 'completed'),
       m AS (SELECT id, verified, greatest(1, CASE WHEN tiers > 0 THEN tiers WHEN told > 0 THEN told ELSE verified END) AS milestones FROM t)
       SELECT id, verified, milestones, CAST(trunc(CAST(verified AS DOUBLE) / milestones * 100) AS INT) AS pct FROM m"""))
def h15(spark, sf):
    return R.learning_progress(V.jobs(spark, sf), V.attempts(spark, sf))


@query("h19_run_summary", "total bigint, clean bigint, needing_update bigint, errors bigint",
       with_views("files", f"""WITH {_RECORDED_SQL}, r AS (SELECT repo_id, max(total) AS total, max(per_file IS NULL) AS lacks, CAST(substr(repo_id, 4) AS INT) % 7 <> 0 AS ok FROM rec GROUP BY repo_id)
       SELECT count(*) AS total, count(*) FILTER (ok AND NOT (total > 0 OR lacks)) AS clean, count(*) FILTER (ok AND (total > 0 OR lacks)) AS needing_update, count(*) FILTER (NOT ok) AS errors FROM r"""))
def h19(spark, sf):
    found = C.needs_backfill(recorded(spark, sf)).withColumn("readable", F.substring("repo_id", 4, 9).cast("int") % 7 != 0)
    return R.run_summary(found)


@query("h20_repository_complexity", "id bigint, files bigint, loc bigint",
       with_views("jobs", f"""WITH {_DOC}, x AS (SELECT id, CAST(json_extract(g, '$.architecture_overview.total_files') AS BIGINT) AS of, CAST(json_extract(g, '$.architecture_overview.total_loc') AS BIGINT) AS ol, CAST(json_extract(g, '$.total_files') AS BIGINT) AS f, coalesce(CAST(json_extract(g, '$.total_loc') AS BIGINT), 0) AS l,
         coalesce(json_array_length(g, '$.nodes'), 0) AS nn, regexp_extract(coalesce(markdown, ''), 'Total Analyzed Files\\*\\*:\\s*`?(\\d+)`?', 1) AS told, 3 * (id % 100) AS est FROM d),
       y AS (SELECT *, coalesce(of > 0 AND ol > 0, false) AS use_ov, CASE WHEN f > 0 THEN f ELSE nn END AS counted FROM x)
       SELECT id, CASE WHEN use_ov THEN of WHEN counted = 0 AND l = 0 AND told <> '' THEN CAST(told AS BIGINT) ELSE counted END AS files, CASE WHEN use_ov THEN ol WHEN l > 0 THEN l WHEN nn > 0 THEN est ELSE 0 END AS loc FROM y"""))
def h20(spark, sf):
    return R.complexity(V.jobs(spark, sf))


# ---------------------------------------------------------------- scalar functions
@query("s7_escape_html", "page_id bigint, chars bigint, digest string",
       """SELECT page_id, length(e) AS chars, md5(e) AS digest FROM (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS e FROM pages)""")
def s7(spark, sf):
    e = X.escape_html(F.col("html"))
    return V.table(spark, sf, "pages").select("page_id", F.length(e).alias("chars"), F.md5(e).alias("digest"))


_STRIP = r"regexp_replace(regexp_replace(text, '^[\s\x{85}\x{A0}\x{2028}\x{2029}\x0B]+', ''), '[\s\x{85}\x{A0}\x{2028}\x{2029}\x0B]+$', '')"


@query("s8_truncate_words", "doc_id bigint, short string",
       rf"""WITH c AS (SELECT doc_id, {_STRIP} AS clean FROM documents), t AS (SELECT doc_id, clean, substr(clean, 1, 85) AS cut, regexp_extract(substr(clean, 1, 85), '(?s)^(.+) [^ ]*$', 1) AS w FROM c),
       k AS (SELECT *, regexp_replace(CASE WHEN w <> '' THEN w ELSE cut END, '[ _\-,:;.!?/\t\n\r]+$', '') AS kept FROM t)
       SELECT doc_id, CASE WHEN clean = '' THEN '' WHEN length(clean) <= 85 THEN clean ELSE (CASE WHEN kept = '' THEN regexp_replace(cut, '[ _\-,:;.!?/\t\n\r]+$', '') ELSE kept END) || '…' END AS short FROM k""")
def s8(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.truncate_words(F.col("text")).alias("short"))


@query("s9_truncate_output", "doc_id bigint, chars bigint, truncated boolean, digest string",
       """SELECT doc_id, length(o) AS chars, cut AS truncated, md5(o) AS digest FROM (SELECT doc_id, length(text) > 500 AS cut, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || chr(10) || '[Output truncated: exceeded 500 characters limit]' ELSE text END AS o FROM documents)""")
def s9(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.truncate_output(F.col("text"), 500).alias("o")).select("doc_id", F.length("o.text").alias("chars"), "o.truncated", F.md5("o.text").alias("digest"))


_ALIAS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGE_ALIASES.items())
_FILE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.SOLUTION_FILES.items())
_SPOKEN = [" PY ", "golang", "C++", "sh", "node", "Haskell", "rs", "TypeScript"]


@query("s10_runtime_language", "doc_id bigint, language string, file_name string",
       f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 8 THEN NULL ELSE {_SPOKEN}[doc_id % 9 + 1] END AS l FROM documents), n AS (SELECT doc_id, CASE lower(trim(coalesce(l, 'python'))) {_ALIAS} ELSE lower(trim(l)) END AS language FROM r)
       SELECT doc_id, language, CASE language {_FILE} ELSE 'solution.' || language END AS file_name FROM n""")
def s10(spark, sf):
    k = F.col("doc_id")
    said = F.when(k % 9 != 8, V.pick(_SPOKEN, F.least(k % 9, F.lit(7))))
    return V.table(spark, sf, "documents").select("doc_id", X.runtime_language(said).alias("language"), X.solution_file(said).alias("file_name"))


@query("s11_path_parts", "page_id bigint, normal string, base string, stem string, ext string, parent string, depth int, prefixes string, tails string",
       r"""WITH p AS (SELECT page_id, trim(replace(regexp_extract(url, '^https?://([^?#]*)', 1), '\', '/'), '/') AS p FROM pages), s AS (SELECT *, string_split(p, '/') AS ps, string_split(p, '/')[-1] AS b FROM p)
       SELECT page_id, p AS normal, b AS base, substr(b, 1, length(b) - length(regexp_extract(b, '^\.*[^.].*?(\.[^.]*)$', 1))) AS stem, regexp_extract(b, '^\.*[^.].*?(\.[^.]*)$', 1) AS ext, regexp_extract(p, '^(.*)/[^/]*$', 1) AS parent, len(ps) AS depth,
        array_to_string(list_transform(range(1, len(ps)), lambda i: array_to_string(ps[1:i], '/')), '|') AS prefixes, array_to_string(list_transform(range(2, len(ps) + 1), lambda i: array_to_string(ps[i:len(ps)], '/')), '|') AS tails FROM s""")
def s11(spark, sf):
    p = V.table(spark, sf, "pages").select("page_id", P.normalize(F.regexp_extract("url", "^https?://([^?#]*)", 1)).alias("normal"))
    n = F.col("normal")
    p = p.withColumn("base", P.basename(n))
    b = F.col("base")
    return p.select("page_id", "normal", "base", P.splitext_stem(b).alias("stem"), P.splitext_ext(b).alias("ext"), P.parent_dir(n).alias("parent"), P.depth(n).alias("depth"),
                    F.array_join(P.directory_prefixes(n), "|").alias("prefixes"), F.array_join(P.tails(n), "|").alias("tails"))


@query("s12_line_counts", "doc_id bigint, line_count bigint, longest bigint",
       f"SELECT doc_id, len({lines_sql('text')}) AS line_count, coalesce(list_max(list_transform({lines_sql('text')}, lambda x: length(x))), 0) AS longest FROM documents")
def s12(spark, sf):
    ls = X.lines(F.col("text"))
    return V.table(spark, sf, "documents").select("doc_id", X.line_count(F.col("text")).alias("line_count"), F.coalesce(F.array_max(F.transform(ls, F.length)), F.lit(0)).alias("longest"))


@query("s16_relative_paths", "page_id bigint, resolved string",
       r"""SELECT page_id, CASE WHEN up = 0 THEN host || '/lib/x' || page_id || '.js' WHEN up = 1 THEN host || '/x' || page_id || '.js' WHEN up = 2 THEN 'x' || page_id || '.js' ELSE '../x' || page_id || '.js' END AS resolved
       FROM (SELECT page_id, page_id % 4 AS up, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages)""")
def s16(spark, sf):
    k = F.col("page_id")
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    up = V.pick(["./", "..//", "../.././", "../a/../../../"], k % 4)
    return V.table(spark, sf, "pages").select("page_id", P.resolve_dots(F.concat(host, F.lit("/lib/"), up, F.lit("x"), V.text_of(k), F.lit(".js"))).alias("resolved"))


@query("s18_date_cutoffs", "event_id bigint, month_start timestamp, older_than_week boolean, parsed timestamp",
       f"SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month_start, ts < {NOW_SQL} - INTERVAL 7 DAY AS older_than_week, date_trunc('second', ts) AS parsed FROM events")
def s18(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return V.table(spark, sf, "events").select("event_id", F.date_trunc("month", "ts").alias("month_start"), (F.col("ts") < F.timestamp_add("DAY", F.lit(-7), V.now())).alias("older_than_week"),
                                               F.to_timestamp_ntz(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("parsed"))
