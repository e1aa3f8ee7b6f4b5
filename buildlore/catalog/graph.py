from pyspark.sql import functions as F

from buildlore.catalog.base import query
from buildlore.catalog.sqlviews import with_views
from buildlore.functions.rules import classify
from buildlore.operators import graph as G
from buildlore.operators.scale import ordered_positions
from buildlore.plans import build_order as B
from buildlore.plans import views as V

VALID_SQL = "valid AS (SELECT DISTINCT repo_id, source, target FROM edges WHERE source <> target)"
SCC_SQL = f"""{VALID_SQL},
 reach(repo_id, a, b) AS (SELECT repo_id, source, target FROM valid UNION SELECT r.repo_id, r.a, v.target FROM reach r JOIN valid v ON v.repo_id = r.repo_id AND v.source = r.b),
 scc AS (SELECT x.repo_id, x.a AS path, least(x.a, min(x.b)) AS scc, count(DISTINCT x.b) AS size FROM reach x JOIN reach y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a GROUP BY x.repo_id, x.a),
 nodes AS (SELECT v.repo_id, v.path, coalesce(s.scc, v.path) AS scc, s.scc IS NOT NULL AS is_cyclic FROM (SELECT repo_id, source AS path FROM valid UNION SELECT repo_id, target FROM valid) v LEFT JOIN scc s USING (repo_id, path))"""
DAG_SQL = f"""{SCC_SQL},
 dag AS (SELECT DISTINCT v.repo_id, a.scc AS source, b.scc AS target FROM valid v JOIN nodes a ON a.repo_id = v.repo_id AND a.path = v.source JOIN nodes b ON b.repo_id = v.repo_id AND b.path = v.target WHERE a.scc <> b.scc)"""
DEPTH_SQL = f"""{DAG_SQL},
 walk(repo_id, node, depth) AS (SELECT DISTINCT repo_id, scc, 0 FROM nodes UNION SELECT w.repo_id, d.source, w.depth + 1 FROM walk w JOIN dag d ON d.repo_id = w.repo_id AND d.target = w.node),
 depths AS (SELECT repo_id, node AS scc, max(depth) AS depth FROM walk GROUP BY ALL)"""
TIERS_SQL = f"""{DEPTH_SQL},
 tiers AS (SELECT n.repo_id, n.path, n.scc, n.is_cyclic, d.depth, CAST(dense_rank() OVER (PARTITION BY n.repo_id ORDER BY d.depth, n.is_cyclic, CASE WHEN n.is_cyclic THEN n.scc ELSE '' END) - 1 AS INT) AS tier_index
   FROM nodes n JOIN depths d USING (repo_id, scc))"""


def tiers_query(views: str, body: str) -> str:
    """A query that starts from the tiers of the given edges."""
    body = body.strip()
    rest = ", " + body[5:].lstrip() if body.upper().startswith("WITH ") else " " + body
    return with_views(views, f"WITH {TIERS_SQL}{rest}", recursive=True)


@query("g1_valid_edges", "repo_id string, source string, target string",
       with_views("edges", "SELECT DISTINCT repo_id, source, target FROM edges WHERE source <> target"))
def g1(spark, sf):
    raw = V.edges(spark, sf).withColumn("is_external", F.lit(False))
    loops = raw.withColumn("target", F.col("source"))
    outside = raw.withColumn("target", F.lit("numpy")).withColumn("is_external", F.lit(True))
    return G.valid_edges(raw.unionByName(raw).unionByName(loops).unionByName(outside))


@query("g2_degrees", "repo_id string, path string, dependencies bigint, dependents bigint",
       with_views("files edges", """SELECT repo_id, path, (SELECT count(*) FROM edges e WHERE e.repo_id = f.repo_id AND e.source = f.path) AS dependencies,
       (SELECT count(*) FROM edges e WHERE e.repo_id = f.repo_id AND e.target = f.path) AS dependents FROM files f"""))
def g2(spark, sf):
    return G.degrees(V.files(spark, sf), V.edges(spark, sf))


@query("g3_isolated_files", "repo_id string, path string",
       with_views("files edges", "SELECT repo_id, path FROM files EXCEPT (SELECT repo_id, source FROM edges UNION SELECT repo_id, target FROM edges)"))
def g3(spark, sf):
    return G.isolated(V.files(spark, sf), V.edges(spark, sf))


@query("g4_strong_components", "repo_id string, path string, scc string, size bigint",
       with_views("edges", f"WITH {SCC_SQL} SELECT repo_id, path, scc, size FROM scc", recursive=True))
def g4(spark, sf):
    return B.cycles(spark, sf)


@query("g5_condensation", "repo_id string, source string, target string",
       with_views("edges", f"WITH {DAG_SQL} SELECT * FROM dag", recursive=True))
def g5(spark, sf):
    return G.condensation(B.edge_table(spark, sf), B.cycles(spark, sf))


@query("g6_longest_depth", "repo_id string, path string, depth int",
       with_views("edges", f"WITH {DEPTH_SQL} SELECT n.repo_id, n.path, d.depth FROM nodes n JOIN depths d USING (repo_id, scc)", recursive=True))
def g6(spark, sf):
    edges = B.edge_table(spark, sf)
    nodes = B.tiers(spark, sf).select("repo_id", "path", "scc", "is_cyclic")
    units = nodes.select("repo_id", F.col("scc").alias("path")).distinct()
    depth = G.longest_depth(G.condensation(edges, nodes.filter("is_cyclic")), units)
    return nodes.join(depth.withColumnRenamed("path", "scc"), ["repo_id", "scc"])


@query("g7_tiers", "repo_id string, tier_index int, is_cyclic boolean, path string, pos bigint",
       tiers_query("edges", "SELECT repo_id, tier_index, is_cyclic, path, row_number() OVER (PARTITION BY repo_id, tier_index ORDER BY path) AS pos FROM tiers"))
def g7(spark, sf):
    return ordered_positions(B.tiers(spark, sf), ["repo_id", "tier_index"], ["path"], "pos")


COMMUNITIES_SQL = """und AS (SELECT DISTINCT repo_id, least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target),
 und_total AS (SELECT repo_id, 2 * count(*) AS total FROM und GROUP BY repo_id),
 und_degree AS (SELECT repo_id, path, count(*) AS d FROM (SELECT repo_id, a AS path FROM und UNION ALL SELECT repo_id, b FROM und) GROUP BY repo_id, path),
 unite(repo_id, path, community, step) AS (SELECT repo_id, path, path, 0 FROM und_degree UNION ALL
   SELECT g.repo_id, g.path, CASE WHEN g.community = w.pair.j THEN w.pair.i ELSE g.community END, g.step + 1 FROM unite g JOIN (
     SELECT p.repo_id, arg_min({'i': p.i, 'j': p.j}, (p.di * p.dj - t.total * p.k, p.i, p.j)) AS pair FROM (
       SELECT e.repo_id, least(x.community, y.community) AS i, greatest(x.community, y.community) AS j, count(*) AS k, any_value(x.whole * y.whole) AS di, 1 AS dj
       FROM und e JOIN (SELECT u.repo_id, u.path, u.community, sum(n.d) OVER (PARTITION BY u.repo_id, u.community) AS whole FROM unite u JOIN und_degree n USING (repo_id, path)) x ON x.repo_id = e.repo_id AND x.path = e.a
       JOIN (SELECT u.repo_id, u.path, u.community, sum(n.d) OVER (PARTITION BY u.repo_id, u.community) AS whole FROM unite u JOIN und_degree n USING (repo_id, path)) y ON y.repo_id = e.repo_id AND y.path = e.b
       WHERE x.community <> y.community GROUP BY ALL) p JOIN und_total t USING (repo_id) WHERE t.total * p.k > p.di * p.dj GROUP BY p.repo_id) w ON w.repo_id = g.repo_id),
 united AS (SELECT f.repo_id, f.path, coalesce(u.community, f.path) AS community FROM files f LEFT JOIN (SELECT * FROM unite QUALIFY step = max(step) OVER (PARTITION BY repo_id)) u USING (repo_id, path))"""


@query("g8_communities", "repo_id string, path string, community string",
       with_views("files edges", f"WITH {COMMUNITIES_SQL} SELECT repo_id, path, community FROM united", recursive=True))
def g8(spark, sf):
    return B.communities(spark, sf)


@query("g9_connected_components", "repo_id string, path string, component string",
       with_views("numbered_edges", """WITH part_edges AS (SELECT repo_id, source, target FROM numbered_edges),
       both_ways AS (SELECT repo_id, source AS a, target AS b FROM part_edges UNION SELECT repo_id, target, source FROM part_edges),
       walk(repo_id, a, b) AS (SELECT repo_id, a, b FROM both_ways UNION SELECT w.repo_id, w.a, e.b FROM walk w JOIN both_ways e ON e.repo_id = w.repo_id AND e.a = w.b)
       SELECT repo_id, a AS path, least(a, min(b)) AS component FROM walk GROUP BY repo_id, a""", recursive=True))
def g9(spark, sf):
    return G.connected_components(V.edges(spark, sf))


def members(spark, sf):
    """Every file with its community as found and its domain by convention."""
    return B.communities(spark, sf).withColumn("domain", classify(F.col("path"))["domain"])


def _vote_sql(classified: str) -> str:
    return f"""{COMMUNITIES_SQL},
 m AS (SELECT c.repo_id, c.path, u.community, c.domain FROM {classified} c JOIN united u USING (repo_id, path)),
 votes AS (SELECT repo_id, community, domain, count(*) AS k, sum(count(*)) OVER (PARTITION BY repo_id, community) AS total FROM m WHERE domain <> 'uncategorized' GROUP BY repo_id, community, domain),
 winners AS (SELECT repo_id, community, domain FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, community ORDER BY k DESC, domain) AS rn FROM votes) WHERE rn = 1 AND k / total >= 0.5),
 voted AS (SELECT m.repo_id, m.path, coalesce(w.domain, 'uncategorized') AS domain FROM m LEFT JOIN winners w USING (repo_id, community) WHERE m.domain = 'uncategorized')"""


@query("g11_display_edges", "repo_id string, source string, target string",
       with_views("numbered_edges", "SELECT repo_id, source, target FROM numbered_edges WHERE t % 3 <> 0 AND n % 5 <> 0"))
def g11(spark, sf):
    e = V.numbered_edges(spark, sf).withColumn("is_external", F.col("t") % 3 == 0).withColumn("resolved", F.col("n") % 5 != 0)
    return G.display_edges(e)
