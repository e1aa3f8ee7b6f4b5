from pyspark.sql import functions as F

from buildlore.catalog.base import query
from buildlore.catalog.extraction import PYTHON_REFS_SQL, norm_sql, python_edges
from buildlore.catalog.sqlviews import WORD_BREAK, text_list, text_set, with_views
from buildlore.operators import extraction as X
from buildlore.operators import resolution as J
from buildlore.plans import views as V

RESOLVED_SQL = f"""ex AS (SELECT unnest(range(1, {len(J.EXTENSIONS + J.INDEX_NAMES) + 1})) AS rank, unnest({text_list(J.EXTENSIONS + J.INDEX_NAMES)}) AS e),
 wants AS (SELECT DISTINCT repo_id, target AS want FROM raw_edges),
 cand AS (SELECT w.repo_id, want, 0 AS rank, path FROM wants w JOIN files f ON f.repo_id = w.repo_id AND f.path = want
   UNION ALL SELECT w.repo_id, want, rank, path FROM wants w CROSS JOIN ex JOIN files f ON f.repo_id = w.repo_id AND f.path = want || e
   UNION ALL SELECT w.repo_id, want, 50, path FROM wants w JOIN files f ON f.repo_id = w.repo_id AND starts_with(f.path, want || '/')
   UNION ALL SELECT w.repo_id, want, 51, path FROM wants w JOIN files f ON f.repo_id = w.repo_id AND ({" OR ".join(f"ends_with(f.path, '/' || want || '{e}')" for e in J.TAIL_ENDINGS)})),
 best AS (SELECT repo_id, want, min(rank) AS rank FROM cand GROUP BY ALL),
 resolved AS (SELECT DISTINCT r.repo_id, r.source, c.path AS target FROM raw_edges r JOIN best b ON b.repo_id = r.repo_id AND b.want = r.target JOIN cand c ON c.repo_id = b.repo_id AND c.want = b.want AND c.rank = b.rank WHERE c.path <> r.source)"""


@query("j1_target_resolution", "repo_id string, source string, target string",
       with_views("files raw_edges", f"WITH {RESOLVED_SQL} SELECT * FROM resolved"))
def j1(spark, sf):
    return J.resolve_targets(V.raw_edges(spark, sf), V.files(spark, sf).select("repo_id", "path"))


@query("j2_python_resolution", "repo_id string, path string, raw string, import_type string, line int, target string, is_external boolean, resolved boolean",
       with_views("code", f"WITH {PYTHON_REFS_SQL} SELECT * FROM python_edges"))
def j2(spark, sf):
    return python_edges(spark, sf)


@query("j3_javascript_resolution", "repo_id string, path string, specifier string, target string, is_external boolean, found boolean",
       with_views("code", f"""WITH s AS (SELECT repo_id, path, unnest(['./m' || (n // 16 * 8 + 5), '../pkg/m' || (n // 16 * 8 + 5) || '.ts', '../nope', 'react/jsx', '@scope/kit/sub', './m' || (n + 1) || '.go']) AS specifier, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM code WHERE path LIKE '%.ts'),
       t AS (SELECT *, CASE WHEN specifier LIKE '.%' THEN {norm_sql('d', 'specifier')} END AS near FROM s),
       h AS (SELECT t.*, coalesce(min(c.path) FILTER (c.path = near), min(c.path)) AS hit FROM t LEFT JOIN code c ON c.repo_id = t.repo_id AND c.path IN (near, near || '.ts') GROUP BY ALL)
       SELECT repo_id, path, specifier, CASE WHEN specifier LIKE '.%' THEN coalesce(hit, near) WHEN specifier LIKE '@%' THEN string_split(specifier, '/')[1] || '/' || string_split(specifier, '/')[2] ELSE string_split(specifier, '/')[1] END AS target,
       specifier NOT LIKE '.%' AS is_external, hit IS NOT NULL AS found FROM h"""))
def j3(spark, sf):
    code = V.code(spark, sf)
    k = V.text_of((F.floor(F.col("n") / 16) * 8 + 5).cast("bigint"))
    specs = F.array(F.concat(F.lit("./m"), k), F.concat(F.lit("../pkg/m"), k, F.lit(".ts")), F.lit("../nope"), F.lit("react/jsx"), F.lit("@scope/kit/sub"),
                    F.concat(F.lit("./m"), V.text_of(F.col("n") + 1), F.lit(".go")))
    refs = code.filter(F.col("path").endswith(".ts")).select("repo_id", "path", F.explode(specs).alias("specifier"))
    return J.resolve_javascript(refs, code)


_NAMES_SQL = r"""names AS (SELECT repo_id, kind, arg_min(name, (length(path), path)) AS name FROM (SELECT repo_id, path, CASE WHEN path LIKE '%go.mod' THEN 'go' ELSE 'rust' END AS kind,
  CASE WHEN path LIKE '%go.mod' THEN regexp_extract(content, '(?m)^\s*module\s+(\S+)', 1) ELSE regexp_extract(content, '\[package\]\nname = "([^"]*)"', 1) END AS name FROM manifests) GROUP BY repo_id, kind)"""


@query("j4_go_resolution", "repo_id string, path string, specifier string, target string, is_external boolean, resolved boolean",
       with_views("code manifests", f"""WITH {_NAMES_SQL}, s AS (SELECT c.repo_id, c.path, name, unnest(['fmt', 'net/http', name, name || '/lib', name || '/src/core/m14', name || '/gone', './m' || (n - 24), '../pkg', 'github.com/x/y']) AS specifier, regexp_extract(c.path, '^(.*)/[^/]*$', 1) AS d FROM code c JOIN names USING (repo_id) WHERE kind = 'go' AND c.path LIKE '%.go'),
       t AS (SELECT *, CASE WHEN NOT contains(string_split(specifier, '/')[1], '.') THEN 'std' WHEN specifier = name OR starts_with(specifier, name || '/') THEN 'own' WHEN specifier LIKE '.%' THEN 'local' ELSE 'external' END AS kase FROM s),
       w AS (SELECT *, CASE kase WHEN 'own' THEN ltrim(substr(specifier, length(name) + 1), '/') WHEN 'local' THEN {norm_sql('d', 'specifier')} END AS want FROM t),
       h AS (SELECT w.*, count(c.path) AS hits FROM w LEFT JOIN code c ON c.repo_id = w.repo_id AND want <> '' AND c.path LIKE '%.go' AND (starts_with(c.path, want || '/') OR c.path = want OR c.path = want || '.go') GROUP BY ALL)
       SELECT repo_id, path, specifier, CASE WHEN kase = 'own' AND want = '' THEN name WHEN kase IN ('own', 'local') THEN want ELSE specifier END AS target, kase = 'external' AS is_external, kase = 'std' OR hits > 0 AS resolved FROM h"""))
def j4_go(spark, sf):
    code, mods = V.code(spark, sf), X.manifest_names(V.manifests(spark, sf)).filter("kind = 'go'")
    m, n = F.col("name"), F.col("n")
    below = lambda tail: F.concat(m, F.lit(tail))
    specs = F.array(F.lit("fmt"), F.lit("net/http"), m, below("/lib"), below("/src/core/m14"), below("/gone"), F.concat(F.lit("./m"), V.text_of(n - 24)), F.lit("../pkg"), F.lit("github.com/x/y"))
    refs = code.filter(F.col("path").endswith(".go")).join(mods, "repo_id").select("repo_id", "path", F.explode(specs).alias("specifier"))
    return J.resolve_go(refs, code, mods)


@query("j4_rust_resolution", "repo_id string, path string, specifier string, is_mod boolean, target string, is_external boolean, resolved boolean",
       with_views("code manifests", f"""WITH {_NAMES_SQL}, s AS (SELECT c.repo_id, c.path, name, unnest(['std::fmt', 'crate::core::m23', 'super::pkg::m15', name || '::lib::m7', name, 'serde::de', 'self', 'm' || (n - 24), 'm1']) AS specifier, unnest([false, false, false, false, false, false, false, true, true]) AS is_mod, regexp_extract(c.path, '^(.*)/[^/]*$', 1) AS d FROM code c JOIN names USING (repo_id) WHERE kind = 'rust' AND c.path LIKE '%.rs'),
       t AS (SELECT *, string_split(specifier, '::')[1] AS first, array_to_string(string_split(specifier, '::')[2:], '/') AS rest FROM s),
       u AS (SELECT *, CASE WHEN is_mod THEN 'mod' WHEN first IN ('std', 'core', 'alloc') THEN 'std' WHEN first IN ('crate', 'super', 'self') THEN 'inner' WHEN specifier = name OR starts_with(specifier, name || '::') THEN 'own' ELSE 'external' END AS kase FROM t),
       w AS (SELECT *, CASE WHEN kase = 'mod' THEN d || '/' || specifier WHEN kase IN ('inner', 'own') THEN rest END AS want FROM u),
       h AS (SELECT w.*, min(c.path) AS hit FROM w LEFT JOIN code c ON c.repo_id = w.repo_id AND (c.path IN (want || '.rs', want || '/mod.rs') OR (kase <> 'mod' AND c.path IN ('src/' || want || '.rs', 'src/' || want || '/mod.rs'))) GROUP BY ALL)
       SELECT repo_id, path, specifier, is_mod, CASE WHEN kase = 'mod' THEN coalesce(hit, want || '.rs') WHEN kase = 'own' AND want = '' THEN name WHEN kase IN ('own', 'inner') AND want <> '' THEN want ELSE specifier END AS target,
       kase = 'external' AS is_external, kase = 'std' OR (kase <> 'external' AND (want = '' OR hit IS NOT NULL)) AS resolved FROM h"""))
def j4_rust(spark, sf):
    code, crates = V.code(spark, sf), X.manifest_names(V.manifests(spark, sf)).filter("kind = 'rust'")
    c, n = F.col("name"), F.col("n")
    use = lambda s: F.struct(s.alias("specifier"), F.lit(False).alias("is_mod"))
    mod = lambda s: F.struct(s.alias("specifier"), F.lit(True).alias("is_mod"))
    specs = F.array(*[use(F.lit(x)) for x in ("std::fmt", "crate::core::m23", "super::pkg::m15")], use(F.concat(c, F.lit("::lib::m7"))), use(c), use(F.lit("serde::de")),
                    use(F.lit("self")), mod(F.concat(F.lit("m"), V.text_of(n - 24))), mod(F.lit("m1")))
    refs = code.filter(F.col("path").endswith(".rs")).join(crates, "repo_id").select("repo_id", "path", F.explode(specs).alias("s")).select("repo_id", "path", "s.*")
    return J.resolve_rust(refs, code, crates)


LINKED_SQL = f"""go AS (SELECT repo_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, content FROM files WHERE path LIKE '%.go'),
 definers AS (SELECT repo_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, symbol AS word, max(path) AS target FROM symbols WHERE path LIKE '%.go' AND length(symbol) >= 3 AND lower(symbol) NOT IN {text_set(J.GENERIC_SYMBOLS)} GROUP BY ALL),
 mentions AS (SELECT repo_id, folder, path AS source, unnest(list_distinct(regexp_split_to_array(content, '{WORD_BREAK}'))) AS word FROM go),
 linked AS (SELECT DISTINCT m.repo_id, source, target FROM mentions m JOIN definers USING (repo_id, folder, word) WHERE source <> target)"""


@query("j5_symbol_links", "repo_id string, source string, target string",
       with_views("files symbols", f"WITH {LINKED_SQL} SELECT * FROM linked"))
def j5(spark, sf):
    return J.link_symbols(V.files(spark, sf), V.symbols(spark, sf))


@query("j8_file_lookup", "repo_id string, want string, match string, rank int",
       with_views("files raw_edges", r"""WITH w AS (SELECT DISTINCT repo_id, CASE length(target) % 4 WHEN 0 THEN target WHEN 1 THEN '\' || target || '/' WHEN 2 THEN 'checkout/' || target ELSE 'other/' || regexp_extract(target, '([^/]*)$', 1) END AS want FROM raw_edges WHERE target <> ''),
       n AS (SELECT *, trim(replace(want, '\', '/'), '/') AS nm FROM w),
       c AS (SELECT n.repo_id, want, f.path, CASE WHEN f.path = want THEN 0 WHEN f.path = nm THEN 1 WHEN ends_with(f.path, '/' || nm) OR ends_with(nm, '/' || f.path) THEN 2 WHEN regexp_extract(f.path, '([^/]*)$', 1) = regexp_extract(nm, '([^/]*)$', 1) THEN 3 END AS rank FROM n JOIN files f USING (repo_id))
       SELECT repo_id, want, m.path AS match, m.rank AS rank FROM (SELECT repo_id, want, min({'rank': rank, 'path': path}) AS m FROM c WHERE rank IS NOT NULL GROUP BY ALL)"""))
def j8(spark, sf):
    t = F.col("target")
    k = F.length(t) % 4
    want = F.when(k == 0, t).when(k == 1, F.concat(F.lit("\\"), t, F.lit("/"))).when(k == 2, F.concat(F.lit("checkout/"), t)).otherwise(F.concat(F.lit("other/"), F.regexp_extract(t, "([^/]*)$", 1)))
    wants = V.raw_edges(spark, sf).filter(t != "").select("repo_id", want.alias("want"))
    return J.find_files(wants, V.files(spark, sf).select("repo_id", "path"))
