from pyspark.sql import functions as F

from buildlore.catalog.base import query
from buildlore.catalog.sqlviews import LINE_BREAK, lines_sql, text_set, with_views
from buildlore.functions import rules as R
from buildlore.operators import extraction as X
from buildlore.operators import resolution as J
from buildlore.plans import views as V

_EXT = "CASE WHEN contains(path, '.') THEN lower('.' || string_split(path, '.')[-1]) END"
LANGUAGE_SQL = "CASE " + " ".join(f"WHEN {_EXT} IN {text_set(v)} THEN '{k}'" for k, v in R.LANGUAGE_EXTENSIONS.items()) + " END"
LINES_CTE = f"""ln AS (SELECT repo_id, path, generate_subscripts(ls, 1) AS line, trim(unnest(ls)) AS text FROM (SELECT repo_id, path, {lines_sql('content')} AS ls FROM code))"""


@query("e1_language_routing", "repo_id string, path string, language string, is_shell boolean",
       with_views("code", rf"""WITH v AS (SELECT repo_id, path, content FROM code UNION ALL SELECT repo_id, 'run/' || n || CASE WHEN n % 2 = 0 THEN '' ELSE '.txt' END, chr(10) || ' #!/usr/bin/env ' || CASE WHEN n % 3 = 0 THEN 'ZSH' ELSE 'perl' END || chr(10) || content FROM code),
       f AS (SELECT *, lower(regexp_extract(content, '^\s*([^\n\r\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]*)', 1)) AS first FROM v),
       l AS (SELECT *, {LANGUAGE_SQL} AS lang FROM f)
       SELECT repo_id, path, coalesce(lang, CASE WHEN first LIKE '#!%sh%' THEN 'shell' END) AS language, coalesce(lang = 'shell', false) OR first LIKE '#!%sh%' AS is_shell FROM l"""))
def e1(spark, sf):
    code = V.code(spark, sf)
    n = F.col("n")
    extra = code.select("repo_id", F.concat(F.lit("run/"), V.text_of(n), F.when(n % 2 == 0, F.lit("")).otherwise(F.lit(".txt"))).alias("path"),
                        F.concat(F.lit("\n #!/usr/bin/env "), F.when(n % 3 == 0, F.lit("ZSH")).otherwise(F.lit("perl")), F.lit("\n"), F.col("content")).alias("content"))
    return X.route_languages(code.select("repo_id", "path", "content").unionByName(extra))


# paths resolved by a join in Spark are found by EXISTS here; every dot segment in the generated sources is a leading ./ or ../
_NORMAL = r"CASE WHEN starts_with({r}, '../') THEN regexp_replace({d}, '/?[^/]*$', '') || CASE WHEN contains({d}, '/') THEN '/' ELSE '' END || substr({r}, 4) WHEN starts_with({r}, './') THEN {d} || '/' || substr({r}, 3) ELSE {d} || '/' || {r} END"


def norm_sql(d: str, r: str) -> str:
    return _NORMAL.format(d=d, r=r)


@query("e2_shell_edges", "repo_id string, path string, line int, raw string, target string, resolved boolean, is_external boolean, import_type string",
       with_views("code", rf"""WITH {LINES_CTE}, s AS (SELECT *, regexp_extract(text, '^(?:source|\.)\s+([^\s;#]+)', 1) AS src, regexp_extract(text, '^(?:(?:bash|sh|zsh|ksh)\s+|\./)([^\s;#]+\.sh|[^\s;#]+\.bash|[^\s;#]+)', 1) AS call FROM ln WHERE path LIKE '%.sh' AND text NOT LIKE '#%'),
       r AS (SELECT repo_id, path, line, CASE WHEN src <> '' THEN 'source' ELSE 'invocation' END AS kind, trim(CASE WHEN src <> '' THEN src ELSE call END, '"''') AS raw, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM s WHERE src <> '' OR call <> ''),
       k AS (SELECT * FROM r WHERE kind = 'source' OR (raw NOT LIKE '-%' AND (contains(raw, '/') OR raw LIKE '%.sh' OR raw LIKE '%.bash'))),
       t AS (SELECT *, regexp_matches(raw, '\$[A-Za-z0-9_]+|\$\{{[^}}]+\}}') AS dyn, {norm_sql('d', 'raw')} AS near FROM k),
       h AS (SELECT t.*, a.path AS pa, b.path AS pb FROM t LEFT JOIN code a ON NOT dyn AND a.repo_id = t.repo_id AND a.path = near LEFT JOIN code b ON NOT dyn AND b.repo_id = t.repo_id AND b.path = raw)
       SELECT repo_id, path, line, raw, CASE WHEN dyn THEN raw ELSE coalesce(pa, pb, near) END AS target, NOT dyn AND coalesce(pa, pb) IS NOT NULL AS resolved,
        NOT dyn AND coalesce(pa, pb) IS NULL AND raw NOT LIKE '.%' AS is_external, CASE WHEN dyn THEN 'dynamic' ELSE kind END AS import_type FROM h"""))
def e2(spark, sf):
    code = V.code(spark, sf)
    return J.resolve_shell(X.shell_references(code.filter(F.col("path").endswith(".sh"))), code)


@query("e3_include_edges", "repo_id string, path string, line int, raw string, target string, resolved boolean, is_external boolean",
       with_views("code", rf"""WITH {LINES_CTE}, i AS (SELECT repo_id, path, line, regexp_extract(text, '^#\s*include\s*([<"])([^>"]+)[>"]', 1) AS q, regexp_extract(text, '^#\s*include\s*([<"])([^>"]+)[>"]', 2) AS raw FROM ln WHERE path LIKE '%.c'),
       s AS (SELECT *, q = '<' OR lower(raw) IN {text_set(X.C_STANDARD)} AS sys, {norm_sql("regexp_extract(path, '^(.*)/[^/]*$', 1)", 'raw')} AS near FROM i WHERE q <> ''),
       h AS (SELECT s.*, a.path AS pa, b.path AS pb FROM s LEFT JOIN code a ON NOT sys AND a.repo_id = s.repo_id AND a.path = near LEFT JOIN code b ON NOT sys AND b.repo_id = s.repo_id AND b.path = 'src/' || raw)
       SELECT repo_id, path, line, raw, CASE WHEN sys THEN raw ELSE coalesce(pa, pb, near) END AS target, sys OR coalesce(pa, pb) IS NOT NULL AS resolved, sys OR coalesce(pa, pb) IS NULL AS is_external FROM h"""))
def e3(spark, sf):
    code = V.code(spark, sf)
    return J.resolve_includes(X.c_includes(code.filter(F.col("path").endswith(".c"))), code)


_TLA_KEYS = text_set(X.TLA_WORDS)


@query("e4_tla_modules", "repo_id string, path string, module string, name string, target string, is_external boolean, resolved boolean",
       with_views("code", rf"""WITH t AS (SELECT repo_id, path, regexp_extract(path, '/m(\d+)\.tla$', 1) AS num, {lines_sql('content')} AS ls, content FROM code WHERE path LIKE '%.tla'),
       c AS (SELECT repo_id, path, regexp_extract(content, '(?m)^[-=]{{3,}}\s*MODULE\s+([A-Za-z0-9_]+)', 1) AS module, unnest(['Naturals', regexp_extract(ls[3], '(m\d+)', 1), 'Sequences']) AS name FROM t),
       p AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || name || '.tla' AS near FROM c),
       h AS (SELECT p.*, coalesce(min(a.path) FILTER (a.path = near), min(a.path)) AS hit FROM p LEFT JOIN code a ON a.repo_id = p.repo_id AND regexp_extract(a.path, '([^/]*)$', 1) = name || '.tla' GROUP BY ALL)
       SELECT repo_id, path, module, name, coalesce(hit, name) AS target, hit IS NULL AS is_external, hit IS NOT NULL AS resolved FROM h"""))
def e4(spark, sf):
    code = V.code(spark, sf)
    mods = X.tla_modules(code.filter(F.col("path").endswith(".tla")))
    return J.resolve_tla(mods, code).join(mods.select("repo_id", "path", "module"), ["repo_id", "path"])


# every specification's model file lies beside it or, for every third, in another folder; some belong to nothing
_CONFIGS = "CASE WHEN n % 3 = 0 THEN 'models/' ELSE regexp_extract(path, '^(.*/)[^/]*$', 1) END || CASE WHEN n % 5 = 0 THEN 'other' ELSE regexp_extract(path, '([^/]*)[.]tla$', 1) END || '.cfg'"


@query("e4_linked_configs", "repo_id string, path string, config string",
       with_views("code", rf"""WITH t AS (SELECT repo_id, path, n, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, unnest(list_distinct([regexp_extract(path, '([^/]*)[.]tla$', 1), regexp_extract(content, '(?m)^[-=]{{3,}}\s*MODULE\s+([A-Za-z0-9_]+)', 1)])) AS name FROM code WHERE path LIKE '%.tla'),
       k AS (SELECT DISTINCT repo_id, {_CONFIGS} AS config FROM code WHERE path LIKE '%.tla'), c AS (SELECT *, regexp_extract(config, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(config, '([^/]+)[.]cfg$', 1) AS name FROM k),
       near AS (SELECT DISTINCT t.repo_id, path, config FROM t JOIN c ON c.repo_id = t.repo_id AND c.folder = t.folder AND c.name = t.name)
       SELECT * FROM near UNION SELECT t.repo_id, path, config FROM t JOIN c ON c.repo_id = t.repo_id AND c.name = t.name WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.repo_id = t.repo_id AND near.path = t.path)"""))
def e4_configs(spark, sf):
    code = V.code(spark, sf).filter(F.col("path").endswith(".tla"))
    folder = F.when(F.col("n") % 3 == 0, F.lit("models/")).otherwise(F.regexp_extract("path", "^(.*/)[^/]*$", 1))
    name = F.when(F.col("n") % 5 == 0, F.lit("other")).otherwise(F.regexp_extract("path", "([^/]*)[.]tla$", 1))
    configs = code.select("repo_id", F.concat(folder, name, F.lit(".cfg")).alias("path")).distinct()
    return J.linked_configs(X.tla_modules(code), configs)


@query("e5_java_edges", "repo_id string, path string, symbol string, import_type string, line int, target string, is_external boolean, resolved boolean",
       with_views("code", rf"""WITH {LINES_CTE}, i AS (SELECT repo_id, path, line, regexp_extract(text, '^import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;', 1) AS symbol,
          CASE WHEN regexp_extract(text, '^import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;', 2) <> '' THEN 'star' ELSE 'static' END AS import_type FROM ln WHERE path LIKE '%.java'),
       d AS (SELECT repo_id, path, CAST(NULL AS INT) AS line, unnest(regexp_extract_all(content, 'Class\s*\.\s*forName\s*\(\s*["'']([^"'']+)["'']\s*\)', 1)) AS symbol, 'dynamic' AS import_type FROM code WHERE path LIKE '%.java'),
       r AS (SELECT * FROM i WHERE symbol <> '' UNION ALL BY NAME SELECT * FROM d),
       h AS (SELECT r.*, min(a.path) AS hit FROM r LEFT JOIN code a ON a.repo_id = r.repo_id AND ends_with(a.path, replace(symbol, '.', '/') || '.java') GROUP BY ALL)
       SELECT repo_id, path, symbol, import_type, line, coalesce(hit, symbol) AS target, hit IS NULL AS is_external, hit IS NOT NULL AND import_type = 'static' AS resolved FROM h"""))
def e5(spark, sf):
    code = V.code(spark, sf)
    return J.resolve_java(X.java_imports(code.filter(F.col("path").endswith(".java"))), code)


@query("e6_python_facts", "repo_id string, path string, entry_point_type string, classes string, functions string, imports bigint, failed boolean",
       with_views("code", """SELECT repo_id, path, CASE WHEN n % 56 <> 48 THEN 'main_function' END AS entry_point_type, CASE WHEN n % 56 <> 48 THEN 'C' || n ELSE '' END AS classes, CASE WHEN n % 56 <> 48 THEN 'main,run' ELSE '' END AS functions,
       CASE WHEN n % 56 <> 48 THEN 7 ELSE 0 END AS imports, n % 56 = 48 AS failed FROM code WHERE path LIKE '%.py'"""))
def e6(spark, sf):
    facts = X.python_facts(V.code(spark, sf))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return facts.select("repo_id", "path", "entry_point_type", join("classes").alias("classes"), join("functions").alias("functions"),
                        F.size("imports").alias("imports"), F.col("error").isNotNull().alias("failed"))


@query("e7_manifest_names", "repo_id string, kind string, name string",
       with_views("manifests", r"""SELECT repo_id, kind, arg_min(name, (length(path), path)) AS name FROM (SELECT repo_id, path, CASE WHEN path LIKE '%go.mod' THEN 'go' ELSE 'rust' END AS kind,
       CASE WHEN path LIKE '%go.mod' THEN regexp_extract(content, '(?m)^\s*module\s+(\S+)', 1) ELSE regexp_extract(content, '\[package\]\nname = "([^"]*)"', 1) END AS name FROM manifests) GROUP BY repo_id, kind"""))
def e7(spark, sf):
    return X.manifest_names(V.manifests(spark, sf))


@query("e8_parse_quarantine", "repo_id string, path string, language string, syntax_error boolean",
       with_views("code", "SELECT repo_id, path, 'python' AS language, true AS syntax_error FROM code WHERE path LIKE '%.py' AND n % 56 = 48"))
def e8(spark, sf):
    _, bad = X.split_errors(X.python_facts(V.code(spark, sf)))
    return bad.withColumn("syntax_error", F.col("message").startswith("SyntaxError"))


PYTHON_REFS_SQL = rf"""py AS (SELECT repo_id, path, n, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, CAST(n // 16 * 8 + n % 8 AS VARCHAR) AS k FROM code WHERE path LIKE '%.py' AND n % 56 <> 48),
 refs AS (SELECT repo_id, path, folder, u.symbol AS symbol, u.import_type AS import_type, u.line AS line, u.raw AS raw FROM (SELECT *, unnest([
   {{'symbol': 'os', 'import_type': 'static', 'line': 1, 'raw': 'os'}}, {{'symbol': 'm' || k, 'import_type': 'static', 'line': 2, 'raw': 'm' || k}},
   {{'symbol': 'pkg.m' || k, 'import_type': 'static', 'line': 3, 'raw': 'from pkg.m' || k || ' import value'}}, {{'symbol': 'pkg.m' || k, 'import_type': 'static', 'line': 3, 'raw': 'from pkg.m' || k || ' import other'}},
   {{'symbol': 'lib.m' || k, 'import_type': 'star', 'line': 4, 'raw': 'from lib.m' || k || ' import *'}}, {{'symbol': 'json', 'import_type': 'conditional', 'line': 6, 'raw': 'json'}},
   {{'symbol': 'm' || k, 'import_type': 'dynamic', 'line': 9, 'raw': 'dynamic:m' || k}}]) AS u FROM py)),
 tried AS (SELECT r.*, min({{'rank': CASE WHEN c.path = folder || '/' || rel THEN 0 WHEN c.path = rel THEN 2 WHEN c.path = 'src/' || rel THEN 4 ELSE 6 END, 'path': c.path}}) AS hit
   FROM (SELECT *, replace(symbol, '.', '/') || '.py' AS rel FROM refs) r LEFT JOIN code c ON c.repo_id = r.repo_id AND (c.path = rel OR ends_with(c.path, '/' || rel)) GROUP BY ALL),
 python_edges AS (SELECT repo_id, path, symbol, raw, import_type, line, coalesce(hit.path, string_split(symbol, '.')[1]) AS target, hit.path IS NULL AS is_external,
   hit.path IS NOT NULL AND import_type NOT IN ('star', 'dynamic') AS resolved FROM tried)"""


def python_edges(spark, sf):
    code = V.code(spark, sf)
    refs = J.resolve_python(X.python_references(X.python_facts(code)), code.select("repo_id", "path"))
    return refs.withColumn("resolved", F.col("may_resolve") & ~F.col("is_external"))


@query("e9_language_rollup", "repo_id string, language string, kind string, target string",
       with_views("code", f"WITH {PYTHON_REFS_SQL} SELECT DISTINCT repo_id, 'python' AS language, 'external' AS kind, target FROM python_edges WHERE is_external UNION SELECT repo_id, 'python', 'unresolved', target FROM python_edges WHERE NOT resolved"))
def e9(spark, sf):
    return X.language_rollup(python_edges(spark, sf).withColumn("language", F.lit("python")))


__all__ = ["LINE_BREAK", "PYTHON_REFS_SQL", "python_edges"]
