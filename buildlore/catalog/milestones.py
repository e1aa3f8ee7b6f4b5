from pyspark.sql import functions as F

from buildlore.catalog.base import query
from buildlore.catalog.graph import tiers_query
from buildlore.catalog.ordering import CLASSIFIED, SCORED_SQL, scored_table
from buildlore.catalog.sqlviews import lines_sql, with_views
from buildlore.functions import rules as R
from buildlore.functions.text import line_count
from buildlore.operators import milestones as M
from buildlore.operators import ordering as O
from buildlore.operators import verification as C
from buildlore.plans import build_order as B
from buildlore.plans import views as V


def fallback_sql(variant: str, p: str = "lower(path)") -> str:
    if variant == "graph":
        return rf"""CASE WHEN regexp_matches({p}, 'test') THEN 'tests' WHEN regexp_matches({p}, 'config|\.(toml|yaml|json|ini|env)$') THEN 'config' WHEN regexp_matches({p}, 'doc|\.md$') THEN 'docs'
          WHEN regexp_matches({p}, 'front|ui|web|component') THEN 'frontend' WHEN regexp_matches({p}, 'db|model|schema|sql') THEN 'database' WHEN regexp_matches({p}, 'api|route|server|service') THEN 'backend' ELSE 'core' END"""
    extra = rf"WHEN regexp_matches({p}, '\.(toml|yaml|json)$') THEN 'config'" if variant == "narrative" else ""
    return f"CASE WHEN contains({p}, 'test') THEN 'tests' WHEN regexp_matches({p}, 'example|tutorial|demo|sample') THEN 'examples' WHEN contains({p}, 'docs') THEN 'docs' {extra} ELSE 'core' END"


@query("c13_fallback_domains", "repo_id string, path string, by_table string, by_narrative string, by_graph string",
       with_views("files", f"SELECT repo_id, path, {fallback_sql('table')} AS by_table, {fallback_sql('narrative')} AS by_narrative, {fallback_sql('graph')} AS by_graph FROM files"))
def c13(spark, sf):
    p = F.col("path")
    return V.files(spark, sf).select("repo_id", "path", *[M.fallback_domain(p, v).alias(f"by_{v}") for v in ("table", "narrative", "graph")])


FACTS_SQL = f"""{SCORED_SQL}, fd AS (SELECT *, CASE WHEN domain <> 'uncategorized' THEN domain ELSE {fallback_sql('narrative')} END AS dom FROM scored WHERE tier_index >= 0),
 dc AS (SELECT repo_id, tier_index, dom, count(*) AS n, min(place) AS p FROM fd GROUP BY ALL), cc AS (SELECT repo_id, tier_index, confidence, count(*) AS n, min(place) AS p FROM fd GROUP BY ALL),
 dt AS (SELECT repo_id, tier_index, arg_min(dom, (-n, p)) AS top, max(n) AS top_n, count(*) AS kinds, string_agg(dom || '=' || n, ',' ORDER BY dom) AS breakdown FROM dc GROUP BY ALL),
 ct AS (SELECT repo_id, tier_index, arg_min(confidence, (-n, p)) AS dominant_confidence FROM cc GROUP BY ALL),
 fb AS (SELECT repo_id, tier_index, count(*) AS files, bool_or(is_cyclic) AS is_cyclic, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM fd GROUP BY ALL),
 facts AS (SELECT fb.*, kinds, breakdown, dominant_confidence, CASE WHEN top_n / files >= 0.5 THEN top ELSE 'mixed' END AS dominant_domain, max(fb.tier_index) OVER (PARTITION BY fb.repo_id) AS last_tier FROM fb JOIN dt USING (repo_id, tier_index) JOIN ct USING (repo_id, tier_index)),
 described AS (SELECT *, CASE WHEN is_cyclic THEN 'Core Subsystem Cluster' WHEN tier_index = 0 THEN 'Foundation Primitives & Base Contracts' WHEN dominant_domain = 'tests' AND kinds > 1 THEN 'Test Verification Suites & Subsystem Fixtures' WHEN dominant_domain = 'tests' THEN 'Test Suite & Verification Layer'
   WHEN dominant_domain IN ('core', 'backend') AND kinds > 1 THEN 'Core Framework Extensions & Multi-Domain Modules' WHEN dominant_domain IN ('core', 'backend') THEN 'Core Framework Extensions & Handlers' WHEN dominant_domain = 'examples' AND kinds > 1 THEN 'Application Demos & Example Suites'
   WHEN dominant_domain = 'examples' THEN 'Application Demos & Examples' WHEN tier_index = last_tier THEN 'Top-Level Composition & Entrypoints' ELSE 'Modular Subsystems & Utilities' END || ' (Tier ' || tier_index || ')' AS title,
   CASE WHEN is_cyclic THEN 'Mutually-Coupled Core Architectural Backbone' WHEN tier_index = 0 THEN 'Foundational Primitives & Zero-Dependency Leaf Utilities' WHEN dominant_domain = 'config' THEN 'Environment Configuration & Build Infrastructure' WHEN dominant_domain IN ('core', 'backend') THEN 'Core Domain Extensions & Business Logic Handlers'
   WHEN dominant_domain = 'tests' THEN 'Test Harness & Validation Assertions' WHEN dominant_domain = 'docs' THEN 'System Documentation & Specifications' WHEN dominant_domain = 'frontend' THEN 'User Interface & Presentation Layer' WHEN dominant_domain = 'examples' THEN 'End-to-End Usage Demos & Tutorial Applications'
   ELSE 'Intermediate Integration Layer' END AS role FROM facts)"""


def facts_query(body: str) -> str:
    return tiers_query("files edges", f"WITH {FACTS_SQL} {body}")


@query("c14_milestone_facts", "repo_id string, tier_index int, files bigint, is_cyclic boolean, dominant_domain string, dominant_confidence string, high bigint, medium bigint, low bigint, breakdown string",
       facts_query("SELECT repo_id, tier_index, files, is_cyclic, dominant_domain, dominant_confidence, high, medium, low, breakdown FROM facts"))
def c14(spark, sf):
    facts = M.milestone_facts(scored_table(spark, sf))
    pairs = F.transform(F.map_entries("domain_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return facts.withColumn("breakdown", F.array_join(pairs, ","))


@query("c14_representative_files", "repo_id string, tier_index int, place int, path string",
       facts_query("""SELECT repo_id, tier_index, place, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, tier_index ORDER BY CASE WHEN p = 1 THEN 0 ELSE 1 END, n DESC, met, p) AS place FROM
         (SELECT fd.repo_id, fd.tier_index, fd.path, dc.n, dc.p AS met, row_number() OVER (PARTITION BY fd.repo_id, fd.tier_index, fd.dom ORDER BY CASE WHEN fd.path LIKE '%__init__.py' THEN 1 ELSE 0 END, len(string_split(fd.path, '/')), fd.path) AS p FROM fd JOIN dc ON dc.repo_id = fd.repo_id AND dc.tier_index = fd.tier_index AND dc.dom = fd.dom)) WHERE place <= 4"""))
def c14_representatives(spark, sf):
    return M.representatives(scored_table(spark, sf))


def described(spark, sf):
    return M.described(M.milestone_facts(scored_table(spark, sf)))


@query("c15_titles_roles", "repo_id string, tier_index int, title string, role string", facts_query("SELECT repo_id, tier_index, title, role FROM described"))
def c15(spark, sf):
    return described(spark, sf)


def parsed(spark, sf):
    return V.files(spark, sf).select("repo_id", "path", R.language_of(F.col("path")).alias("language"), (F.col("n") % 9 == 0).alias("entry_point")).filter(F.col("language").isNotNull())


_LANG = "CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.tsx') THEN 'javascript' WHEN ends_with(path, '.rs') THEN 'rust' END"


@query("h10_architecture_overview", "repo_id string, total_files bigint, total_domains bigint, primary_language string, entry_points bigint, cyclic_files bigint, isolated_files bigint, total_loc bigint",
       tiers_query("files edges", f"""WITH {SCORED_SQL}, pl AS (SELECT repo_id, {_LANG} AS lang, n % 9 = 0 AS entry FROM files), lc AS (SELECT repo_id, lang, count(*) AS k FROM pl WHERE lang IS NOT NULL GROUP BY ALL)
       SELECT s.repo_id, count(*) AS total_files, count(DISTINCT s.domain) AS total_domains, coalesce((SELECT arg_min(lang, (-k, lang)) FROM lc WHERE lc.repo_id = s.repo_id), 'unknown') AS primary_language, (SELECT count(*) FROM pl WHERE pl.repo_id = s.repo_id AND lang IS NOT NULL AND entry) AS entry_points,
        count(*) FILTER (is_cyclic) AS cyclic_files, count(*) FILTER (tier_index < 0) AS isolated_files, (SELECT sum(len({lines_sql('content')})) FROM files f WHERE f.repo_id = s.repo_id) AS total_loc FROM scored s GROUP BY s.repo_id"""))
def h10(spark, sf):
    segments = O.convention_domains(B.file_table(spark, sf))
    return M.overview(parsed(spark, sf), segments, scored_table(spark, sf), V.files(spark, sf), line_count(F.col("content")))


@query("h11_milestone_symbols", "repo_id string, tier_index int, place int, symbol string",
       tiers_query("files edges symbols", "SELECT repo_id, tier_index, place, symbol FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, tier_index ORDER BY symbol) AS place FROM (SELECT DISTINCT repo_id, tier_index, symbol FROM symbols JOIN tiers USING (repo_id, path))) WHERE place <= 10"))
def h11(spark, sf):
    junk = B.file_table(spark, sf).select("doc_id", F.array(F.concat(F.lit("0/"), "path")).alias("symbols"))
    return M.milestone_symbols(V.symbol_lists(spark, sf).unionByName(junk), B.placed_files(spark, sf), "doc_id")


@query("h12_domain_distribution", "repo_id string, domain string, files bigint, pct double",
       with_views("files", f"WITH {CLASSIFIED} SELECT repo_id, domain, count(*) AS files, round_even(count(*) / sum(count(*)) OVER (PARTITION BY repo_id) * 100, 1) AS pct FROM classified GROUP BY repo_id, domain"))
def h12(spark, sf):
    return M.domain_distribution(O.convention_domains(B.file_table(spark, sf)))


@query("h13_reconciliation", "repo_id string, row_kind string, tier_index int, high bigint, medium bigint, low bigint, files bigint, dominant string",
       tiers_query("files edges", f"""WITH {SCORED_SQL}, td AS (SELECT *, CASE WHEN domain <> 'uncategorized' THEN domain ELSE {fallback_sql('table')} END AS dom FROM scored),
       tc AS (SELECT repo_id, tier_index, dom, count(*) AS n, min(place) AS p FROM td WHERE tier_index >= 0 GROUP BY ALL), tt AS (SELECT repo_id, tier_index, arg_min(dom, (-n, p)) AS top FROM tc GROUP BY ALL),
       r AS (SELECT repo_id, CASE WHEN tier_index >= 0 THEN 'tier' ELSE 'isolated' END AS row_kind, CASE WHEN tier_index >= 0 THEN tier_index END AS tier_index, confidence FROM td UNION ALL SELECT repo_id, 'subtotal', NULL, confidence FROM td WHERE tier_index >= 0 UNION ALL SELECT repo_id, 'total', NULL, confidence FROM td)
       SELECT r.repo_id, row_kind, r.tier_index, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low, count(*) AS files,
        CASE row_kind WHEN 'tier' THEN upper(top[1]) || substr(top, 2) WHEN 'isolated' THEN 'Standalone' ELSE '-' END AS dominant FROM r LEFT JOIN tt ON tt.repo_id = r.repo_id AND tt.tier_index = r.tier_index GROUP BY ALL"""))
def h13(spark, sf):
    return M.reconciliation(scored_table(spark, sf))


@query("h16_overall_confidence", "repo_id string, label string",
       tiers_query("files edges", f"""WITH {SCORED_SQL}, s AS (SELECT repo_id, CAST(round_even(count(*) FILTER (confidence = 'high') / count(*) * 100, 0) AS INT) AS h, CAST(round_even(count(*) FILTER (confidence = 'medium') / count(*) * 100, 0) AS INT) AS m, CAST(round_even(count(*) FILTER (confidence = 'low') / count(*) * 100, 0) AS INT) AS l FROM scored GROUP BY repo_id)
       SELECT repo_id, CASE WHEN h >= 50 THEN 'HIGH (' || h || '%)' WHEN h + m >= 50 THEN 'MEDIUM (' || m || '%)' ELSE 'LOW (' || l || '%)' END AS label FROM s"""))
def h16(spark, sf):
    return M.overall_confidence(scored_table(spark, sf))


_QUIZ_SQL = r""", q0 AS (SELECT repo_id, min(tier_index) AS base FROM described GROUP BY repo_id), dd AS (SELECT repo_id, domain, count(*) AS n FROM classified GROUP BY ALL),
       dn AS (SELECT repo_id, arg_min(domain, (-n, domain)) AS dom, max(n) AS most, sum(n) AS total, list_sort(list(domain)) AS names FROM dd GROUP BY repo_id)
       SELECT d.repo_id, 'q_foundational' AS question_id, tier_index, 0 AS correct, 'Why should a developer begin reverse-engineering `' || d.repo_id || '` at Milestone ' || tier_index || ' (' || title || ')?' AS question,
        'These ' || files || ' files are leaf primitives with 0 internal dependencies. | These files contain the top-level CLI entry point. | These files contain end-to-end integration tests. | These files were the most recently edited in git history.' AS options,
        'Milestone 0 represents starting foundational files (files with no internal dependencies) that can be understood in isolation without prior knowledge of the rest of the codebase.' AS explanation FROM described d JOIN q0 ON q0.repo_id = d.repo_id AND base = tier_index
       UNION ALL SELECT repo_id, 'q_cyclic_core', min(tier_index), 1, 'Milestone ' || min(tier_index) || ' contains a mutual dependency cycle (' || arg_min(files, tier_index) || ' files). How should this cluster be approached?',
        'Read them sequentially in alphabetical order because order is strict. | Read them as a coupled system / cohesive unit, since their interfaces are co-dependent. | Skip them completely because cycles are always invalid code bugs. | Read only the largest file and ignore the others.',
        'These files depend on each other in a loop, so there''s no single correct order — an estimate is used instead. They are best understood together as a subsystem.' FROM described WHERE is_cyclic GROUP BY repo_id
       UNION ALL SELECT d.repo_id, 'q_tier_' || tier_index || '_role', tier_index, 0, 'What is the architectural role of Milestone ' || tier_index || ' (' || title || ')?',
        'It implements the ' || dominant_domain || ' layer that builds upon and depends on lower-tier foundational modules. | It defines low-level leaf utilities with zero internal imports. | It is completely isolated and detached from all other repository components. | It acts exclusively as a temporary build artifact cache.',
        'Milestone ' || tier_index || ' serves the ' || dominant_domain || ' layer, consuming the abstractions provided by lower tiers.' FROM described d JOIN q0 ON q0.repo_id = d.repo_id AND base <> tier_index WHERE NOT is_cyclic
       UNION ALL SELECT dn.repo_id, 'q_domain_profile', coalesce((SELECT min(tier_index) FROM described d WHERE d.repo_id = dn.repo_id AND d.dominant_domain = dn.dom), base), greatest(0, coalesce(list_position(names[1:4], dom), 0) - 1), 'Which domain represents the largest portion of files in `' || dn.repo_id || '`?',
        array_to_string(list_transform(names[1:4], lambda d: '`' || d || '`'), ' | '), '`' || dom || '` accounts for ' || most || ' out of ' || total || ' analyzed files in the codebase.' FROM dn JOIN q0 USING (repo_id)"""


@query("s14_quiz", "repo_id string, question_id string, tier_index int, correct int, question string, options string, explanation string", facts_query(_QUIZ_SQL))
def s14(spark, sf):
    segments = O.convention_domains(B.file_table(spark, sf))
    asked = M.quiz(described(spark, sf), segments.groupBy("repo_id", "domain").agg(F.count(F.lit(1)).alias("files")))
    return asked.withColumn("options", F.array_join("options", " | "))


def node_table(spark, sf):
    return scored_table(spark, sf).filter("tier_index >= 0").select("repo_id", "path", "tier_index", "domain")


@query("s15_first_hints", "repo_id string, tier_index int, hint string",
       facts_query(""", hf AS (SELECT s.repo_id, s.tier_index, array_to_string(list_sort(list(DISTINCT upper(s.domain))), ', ') AS domains, bool_or(e.target IS NOT NULL) AS inb FROM scored s LEFT JOIN (SELECT DISTINCT repo_id, target FROM valid) e ON e.repo_id = s.repo_id AND e.target = s.path WHERE s.tier_index >= 0 GROUP BY ALL)
       SELECT h.repo_id, h.tier_index, CASE WHEN h.tier_index = 0 THEN 'Milestone 0 forms the foundation layer (' || role || ') operating in the ' || domains || ' domain. Modules in this layer should have minimal or no external dependencies within the project, acting as leaf nodes that higher tiers rely on. Focus on defining the primary configuration structures and core initialization abstractions required by upstream orchestrators.'
        ELSE 'Milestone ' || h.tier_index || ' (' || role || ') operates primarily within the ' || domains || ' domain. It bridges lower foundation tiers (Tier ' || (h.tier_index - 1) || ') into ' || CASE WHEN inb THEN 'higher tiers (such as Tier ' || (h.tier_index + 1) || ')' ELSE 'top-level entry points' END || '. Ensure your implementation correctly encapsulates the domain boundaries and exposes clean callable contracts for upper layers to orchestrate.' END AS hint
       FROM hf h JOIN described d ON d.repo_id = h.repo_id AND d.tier_index = h.tier_index"""))
def s15_first(spark, sf):
    facts = M.hint_facts(node_table(spark, sf), B.edge_table(spark, sf))
    return M.first_hint(facts.join(described(spark, sf).select("repo_id", "tier_index", "role"), ["repo_id", "tier_index"]))


_EXPECTED = r"xs AS (SELECT repo_id, tier_index, symbol AS name, CASE WHEN regexp_matches(symbol, '^\p{Lu}') AND NOT contains(symbol, '_') THEN 'class' ELSE 'function' END AS kind, min(path) AS source_file FROM symbols JOIN tiers USING (repo_id, path) GROUP BY ALL)"


def expected(spark, sf):
    return C.expected_symbols(C.exports_of(V.symbol_lists(spark, sf), B.placed_files(spark, sf), "doc_id"))


@query("s15_second_hints", "repo_id string, tier_index int, hint string",
       tiers_query("files edges symbols", f"""WITH {_EXPECTED}, f3 AS (SELECT repo_id, tier_index, string_agg('`' || path || '`', ', ' ORDER BY path) AS fs FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, tier_index ORDER BY path) AS p FROM tiers) WHERE p <= 3 GROUP BY ALL),
       s5 AS (SELECT repo_id, tier_index, string_agg('`' || name || '` (' || kind || ')', ', ' ORDER BY p) AS ss FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, tier_index ORDER BY source_file, name) AS p FROM xs) WHERE p <= 5 GROUP BY ALL)
       SELECT repo_id, tier_index, 'Target Files: ' || fs || '. Key required contracts: ' || coalesce(ss, 'primary exported classes and functions') || '. Verify that all class definitions and method signatures match these expected AST interfaces.' AS hint FROM f3 LEFT JOIN s5 USING (repo_id, tier_index)"""))
def s15_second(spark, sf):
    return M.second_hint(B.tiers(spark, sf), V.symbol_lists(spark, sf), B.placed_files(spark, sf), "doc_id")


@query("s15_skeleton_pieces", "repo_id string, tier_index int, part int, name string, piece string",
       tiers_query("files edges symbols", f"""WITH {_EXPECTED} SELECT repo_id, tier_index, CASE kind WHEN 'class' THEN 0 ELSE 1 END AS part, name, CASE kind WHEN 'class' THEN 'class ' || name || ':' || chr(10) || '    \"\"\"Reference architectural contract.\"\"\"' || chr(10) || '    def __init__(self):' || chr(10) || '        pass' || chr(10)
         ELSE 'def ' || name || '():' || chr(10) || '    \"\"\"Exported module function.\"\"\"' || chr(10) || '    return None' || chr(10) END AS piece FROM xs"""))
def s15_skeleton(spark, sf):
    return M.skeleton_lines(expected(spark, sf))


_COUNTED = ", ".join(f"count(*) FILTER (domain = '{d}') AS {d}" for d in R.DOMAINS)


@query("h21_validation_matrix", "repo_id string, total bigint, " + ", ".join(f"{d} bigint" for d in R.DOMAINS) + ", uncategorized_pct double",
       with_views("files", f"WITH {CLASSIFIED} SELECT coalesce(repo_id, 'GRAND TOTAL') AS repo_id, count(*) AS total, {_COUNTED}, round_even(count(*) FILTER (domain = 'uncategorized') / count(*) * 100, 1) AS uncategorized_pct FROM classified GROUP BY ROLLUP (repo_id)"))
def h21(spark, sf):
    return M.validation_matrix(O.convention_domains(B.file_table(spark, sf)), R.DOMAINS)


@query("h21_confidence_shares", "repo_id string, denominator string, files bigint, high_pct double, medium_pct double, low_pct double",
       tiers_query("files edges", f"""WITH {SCORED_SQL}, d AS (SELECT repo_id, confidence, 'all' AS denominator FROM scored UNION ALL SELECT repo_id, confidence, 'code' FROM scored WHERE path LIKE '%.py')
       SELECT repo_id, denominator, count(*) AS files, round_even(count(*) FILTER (confidence = 'high') / count(*) * 100, 2) AS high_pct, round_even(count(*) FILTER (confidence = 'medium') / count(*) * 100, 2) AS medium_pct, round_even(count(*) FILTER (confidence = 'low') / count(*) * 100, 2) AS low_pct FROM d GROUP BY ALL"""))
def h21_shares(spark, sf):
    return M.shares(scored_table(spark, sf))


@query("h21_before_after", "repo_id string, domain string, before bigint, after bigint",
       with_views("files", f"""WITH {CLASSIFIED}, a AS (SELECT repo_id, domain, count(*) AS before FROM classified GROUP BY ALL), b AS (SELECT repo_id, CASE WHEN path LIKE 'zzz/%' THEN 'examples' ELSE domain END AS domain, count(*) AS after FROM classified GROUP BY ALL)
       SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.domain, b.domain) AS domain, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.domain = b.domain"""))
def h21_before_after(spark, sf):
    a = O.convention_domains(B.file_table(spark, sf))
    b = a.withColumn("domain", F.when(F.col("path").startswith("zzz/"), "examples").otherwise(F.col("domain")))
    return M.compare_counts(a, b, "domain")


@query("h22_edge_fingerprint", "repo_id string, outgoing bigint, incoming bigint, both bigint, edges bigint, fingerprint string",
       with_views("edges", r"""WITH e AS (SELECT repo_id, source, 'use ' || target AS raw, target FROM edges), h AS (SELECT DISTINCT repo_id, sha256(source || ' --[' || raw || ']--> ' || target) AS d FROM e WHERE regexp_matches(source, '\.py$') OR regexp_matches(target, '\.py$')),
       b AS (SELECT repo_id, substr(d, 1, 3) AS b, sha256(string_agg(d, chr(10) ORDER BY d)) AS h, count(*) AS n FROM h GROUP BY ALL), w AS (SELECT repo_id, substr(sha256(string_agg(h, chr(10) ORDER BY b)), 1, 16) AS fingerprint, sum(n) AS edges FROM b GROUP BY repo_id)
       SELECT e.repo_id, count(*) FILTER (regexp_matches(source, '\.py$')) AS outgoing, count(*) FILTER (regexp_matches(target, '\.py$')) AS incoming, count(*) FILTER (regexp_matches(source, '\.py$') AND regexp_matches(target, '\.py$')) AS both, coalesce(any_value(edges), 0) AS edges, coalesce(any_value(fingerprint), substr(sha256(''), 1, 16)) AS fingerprint FROM e LEFT JOIN w USING (repo_id) GROUP BY e.repo_id""".replace("string_agg(d, chr(10) ORDER", "string_agg(d, '\n' ORDER").replace("string_agg(h, chr(10) ORDER", "string_agg(h, '\n' ORDER")))
def h22(spark, sf):
    e = V.edges(spark, sf).withColumn("raw", F.concat(F.lit("use "), "target"))
    return M.edge_fingerprint(e, r"\.py$")
