"""Dependency graphs of many repositories at once. Vertices are (repo_id, path); an edge's source depends on its target.

The iterative operators write each round's state to the shared folder and read it back, which cuts lineage, survives
lost executors and lets one pass both store the state and say whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from buildlore.operators import repositories as R
from buildlore.operators.scale import ordered_positions
from buildlore.session import drop_table, write_table

VERTEX = ["repo_id", "path"]


def valid_edges(edges: DataFrame) -> DataFrame:
    """Internal edges between two different named files, once each."""
    if "is_external" in edges.columns:
        edges = edges.filter(~F.col("is_external"))
    return (
        edges.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
        .select("repo_id", "source", "target")
        .distinct()
    )


def display_edges(edges: DataFrame) -> DataFrame:
    """Edges a drawing shows: internal, resolved, with a target."""
    return edges.filter(~F.col("is_external") & F.col("resolved") & (F.col("target") != "")).select("repo_id", "source", "target")


def sources(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", F.col("source").alias("path"))


def targets(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", F.col("target").alias("path"))


def vertices(edges: DataFrame) -> DataFrame:
    return sources(edges).unionByName(targets(edges)).distinct()


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies and dependents of every file; both counts come from one aggregation over both ends of the edges."""
    ends = sources(edges).withColumns({"o": F.lit(1), "i": F.lit(0)}).unionByName(targets(edges).withColumns({"o": F.lit(0), "i": F.lit(1)}))
    counts = ends.groupBy(*VERTEX).agg(F.sum("o").alias("dependencies"), F.sum("i").alias("dependents"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return files.select(*VERTEX).join(counts, VERTEX, "left").select(*VERTEX, zero("dependencies"), zero("dependents"))


def isolated(files: DataFrame, edges: DataFrame) -> DataFrame:
    return files.select(*VERTEX).join(vertices(edges), VERTEX, "left_anti")


def _store(df: DataFrame, changed: str = "changed") -> tuple[DataFrame, str, int]:
    """Write one round's state; returns it with its location and the number of rows flagged as changed."""
    seen = Observation()
    watched = df.observe(seen, F.sum(F.when(F.col(changed), 1).otherwise(0)).alias("n"))
    table, place = write_table(watched)
    return table, place, int(seen.get["n"] or 0)


def _counted(df: DataFrame) -> tuple[DataFrame, str, int]:
    return _store(df.withColumn("changed", F.lit(True)))


def trim(edges: DataFrame) -> tuple[DataFrame, str, int]:
    """Drop edges that cannot lie on or between cycles, to the end: nothing enters their source or nothing leaves their target."""
    spark = edges.sparkSession
    live, place, n = _counted(edges.select("repo_id", "source", "target"))
    while n:
        entered = live.select("repo_id", F.col("target").alias("source")).distinct()
        left = live.select("repo_id", F.col("source").alias("target")).distinct()
        kept = live.join(entered, ["repo_id", "source"], "left_semi").join(left, ["repo_id", "target"], "left_semi")
        smaller, where, m = _counted(kept.select("repo_id", "source", "target"))
        drop_table(spark, place)
        live, place = smaller, where
        if m == n:
            break
        n = m
    return live, place, n


def _reach_labels(live: DataFrame) -> tuple[DataFrame, str]:
    """(repo_id, path, fwd, bwd): the smallest vertex that reaches each vertex, and the smallest one it reaches."""
    spark = live.sparkSession
    start = vertices(live).select(*VERTEX, F.col("path").alias("fwd"), F.col("path").alias("bwd"), F.lit(True).alias("changed"))
    state, place, n = _store(start)
    while n:
        news = state.filter("changed")
        down = live.join(news.withColumnRenamed("path", "source"), ["repo_id", "source"]).select("repo_id", F.col("target").alias("path"), "fwd", F.lit(None).cast("string").alias("bwd"))
        up = live.join(news.withColumnRenamed("path", "target"), ["repo_id", "target"]).select("repo_id", F.col("source").alias("path"), F.lit(None).cast("string").alias("fwd"), "bwd")
        none = F.lit(None).cast("string")
        old = state.select(*VERTEX, "fwd", "bwd", F.col("fwd").alias("of"), F.col("bwd").alias("ob"))
        news_all = down.unionByName(up).select("*", none.alias("of"), none.alias("ob"))
        merged = old.unionByName(news_all).groupBy(*VERTEX).agg(
            F.min("fwd").alias("fwd"), F.min("bwd").alias("bwd"), F.max("of").alias("of"), F.max("ob").alias("ob"))
        nxt, where, n = _store(merged.select(*VERTEX, "fwd", "bwd", ((F.col("fwd") != F.col("of")) | (F.col("bwd") != F.col("ob"))).alias("changed")))
        drop_table(spark, place)
        state, place = nxt, where
    return state, place


def chain_ends(edges: DataFrame) -> tuple[DataFrame, str]:
    """(repo_id, path, end, dist, low, loop) of the inner vertices of chains: those with one way in and one way out.

    `end` is the first vertex behind that is no inner one, `dist` edges away. Inner vertices that form a cycle by themselves have no end:
    for them `loop` is set and `low` is the cycle's smallest vertex. Pointers double in each round, so a chain of n takes log n rounds.
    """
    spark = edges.sparkSession
    out = edges.groupBy("repo_id", F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("end"))
    into = edges.groupBy("repo_id", F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("m"))
    inner = out.filter("n = 1").join(into.filter("m = 1"), VERTEX).filter("path <> end")
    state, place, n = _counted(inner.select(*VERTEX, "end", F.lit(1).cast("bigint").alias("dist"), F.col("path").alias("low")))
    reach, open_ends = 1, n
    while open_ends and reach < 2 * n:
        ahead = state.select("repo_id", F.col("path").alias("end"), F.col("end").alias("e2"), F.col("dist").alias("d2"), F.col("low").alias("l2"))
        both = state.drop("changed").join(ahead, ["repo_id", "end"], "left")
        further = both.select(*VERTEX, F.coalesce("e2", "end").alias("end"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"),
                              F.least("low", "l2").alias("low"), F.col("e2").isNotNull().alias("changed"))
        nxt, where, open_ends = _store(further)
        drop_table(spark, place)
        state, place, reach = nxt, where, reach * 2
    # whoever still moves after as many steps as there are inner vertices goes round in a circle
    return state.withColumnRenamed("changed", "loop") if open_ends else state.withColumn("loop", F.lit(False)).drop("changed"), place


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(repo_id, path, scc, size) for the members of components with two or more files; `scc` is the smallest member.

    Small repositories are a task each, large ones go through rounds.
    """
    small, large = R.by_size(edges.select("repo_id", "source", "target").filter("source <> target").distinct())
    here = R.placed_vertices(small).filter("size > 1").select(*VERTEX, "scc", "size")
    large, place = write_table(large)
    if not large.isEmpty():
        here = here.unionByName(_connected_by_rounds(large))
    drop_table(edges.sparkSession, place)
    return here


def _connected_by_rounds(edges: DataFrame) -> DataFrame:
    """Strongly connected components of any size.

    Chains become single edges first, and cycles that are nothing but a chain are found on the way, so long ones take few rounds. On what is
    left, a vertex whose smallest ancestor is also its smallest descendant shares a component with it.
    """
    spark = edges.sparkSession
    edges, edges_at = write_table(edges)
    ahead, ahead_at = chain_ends(edges)
    circles = ahead.filter("loop").select(*VERTEX, F.col("low").alias("key"))
    open_edges = edges.join(circles.select("repo_id", F.col("path").alias("source")), ["repo_id", "source"], "left_anti")
    back, back_at = chain_ends(open_edges.select("repo_id", F.col("target").alias("source"), F.col("source").alias("target")))
    inner = ahead.filter("NOT loop").select(*VERTEX, F.col("end").alias("to")).join(back.filter("NOT loop").select(*VERTEX, F.col("end").alias("of")), VERTEX)
    inner, inner_at = write_table(inner)
    outer = open_edges.join(ahead.select("repo_id", F.col("path").alias("source")), ["repo_id", "source"], "left_anti")
    short = outer.join(inner.select("repo_id", F.col("path").alias("target"), "to"), ["repo_id", "target"], "left")
    short = short.select("repo_id", "source", F.coalesce("to", "target").alias("target")).filter("source <> target").distinct()
    core = _core_components(short)
    ends = core.select(*VERTEX, F.col("scc").alias("key"))
    # an inner vertex is on a cycle if its chain's two ends are one vertex, or lie in one component
    at_start = inner.join(ends.select("repo_id", F.col("path").alias("of"), F.col("key").alias("k1")), ["repo_id", "of"], "left")
    placed = at_start.join(ends.select("repo_id", F.col("path").alias("to"), F.col("key").alias("k2")), ["repo_id", "to"], "left")
    closed = placed.filter((F.col("of") == F.col("to")) | (F.col("k1") == F.col("k2")))
    own = closed.select(*VERTEX, F.coalesce("k1", "of").alias("key"))
    heads = closed.select("repo_id", F.col("of").alias("path"), F.coalesce("k1", "of").alias("key")).distinct()
    members, members_at = write_table(ends.unionByName(own).unionByName(heads).unionByName(circles).distinct())
    named = members.groupBy("repo_id", "key").agg(F.min("path").alias("scc"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    out, _ = write_table(members.join(named, ["repo_id", "key"]).select(*VERTEX, "scc", "size"))
    for old in (edges_at, ahead_at, back_at, inner_at, members_at):
        drop_table(spark, old)
    return out


def _core_components(edges: DataFrame) -> DataFrame:
    """(repo_id, path, scc): components of two or more by smallest ancestor and descendant.

    Each pass assigns at least the component of the smallest vertex left and keeps only edges inside one (ancestor, descendant) class.
    """
    spark = edges.sparkSession
    found, places = sources(edges).limit(0).withColumn("scc", F.col("path")), []
    live, place, n = trim(edges)
    while n:
        labels, labels_at = _reach_labels(live)
        part, part_at = write_table(labels.filter(F.col("fwd") == F.col("bwd")).select(*VERTEX, F.col("fwd").alias("scc")))
        found, places = found.unionByName(part), [*places, part_at]
        rest = labels.filter(F.col("fwd") != F.col("bwd")).select("repo_id", "path", F.struct("fwd", "bwd").alias("k"))
        inside = (
            live.join(rest.select("repo_id", F.col("path").alias("source"), F.col("k").alias("ks")), ["repo_id", "source"])
            .join(rest.select("repo_id", F.col("path").alias("target"), F.col("k").alias("kt")), ["repo_id", "target"])
            .filter(F.col("ks") == F.col("kt"))
        )
        smaller, where, n = trim(inside)
        drop_table(spark, place)
        drop_table(spark, labels_at)
        live, place = smaller, where
    drop_table(spark, place)
    big = found.groupBy("repo_id", "scc").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    out, _ = write_table(found.join(big, ["repo_id", "scc"]).select(*VERTEX, "scc"))
    for old in places:
        drop_table(spark, old)
    return out


def with_scc(nodes: DataFrame, scc: DataFrame) -> DataFrame:
    """Every node with its component (itself when alone) and whether the component is a cycle."""
    return nodes.join(scc.select(*VERTEX, "scc"), VERTEX, "left").select(
        *VERTEX, F.coalesce("scc", "path").alias("scc"), F.col("scc").isNotNull().alias("is_cyclic"))


def condensation(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Edges between components, once each."""
    s = scc.select("repo_id", F.col("path").alias("source"), F.col("scc").alias("s"))
    t = scc.select("repo_id", F.col("path").alias("target"), F.col("scc").alias("t"))
    mapped = edges.join(s, ["repo_id", "source"], "left").join(t, ["repo_id", "target"], "left")
    return (
        mapped.select("repo_id", F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"))
        .filter(F.col("source") != F.col("target")).distinct()
    )


def longest_depth(dag: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, path, depth) over an acyclic graph: 0 without prerequisites, else one more than the deepest of them.

    Small repositories are a task each, large ones go through rounds.
    """
    small, large = R.by_size(dag.select("repo_id", "source", "target").distinct())
    alone = nodes.select(*VERTEX, F.lit(0).alias("depth"))
    here = alone.unionByName(R.placed_vertices(small).select(*VERTEX, "depth"))
    large, place = write_table(large)
    if not large.isEmpty():
        here = here.unionByName(_depth_by_rounds(large))
    drop_table(dag.sparkSession, place)
    return here.groupBy(*VERTEX).agg(F.max("depth").alias("depth"))


def _depth_by_rounds(dag: DataFrame) -> DataFrame:
    """(repo_id, path, depth) of every vertex of an acyclic graph of any size.

    Chains become single edges that count their steps. On the vertices left, depths rise until none does: in each round only vertices that
    have just risen tell those that depend on them. The inner vertices of a chain follow from its end.
    """
    spark = dag.sparkSession
    dag, dag_at = write_table(dag)
    ahead, ahead_at = chain_ends(dag)
    inner = ahead.select(*VERTEX, "end", "dist")
    outer = dag.join(inner.select("repo_id", F.col("path").alias("source")), ["repo_id", "source"], "left_anti")
    short = outer.join(inner.select("repo_id", F.col("path").alias("target"), "end", "dist"), ["repo_id", "target"], "left")
    short = short.select("repo_id", "source", F.coalesce("end", "target").alias("target"), (F.coalesce("dist", F.lit(0)) + 1).alias("steps"))
    short, short_at = write_table(short.groupBy("repo_id", "source", "target").agg(F.max("steps").alias("steps")))
    ends = vertices(short).unionByName(inner.select("repo_id", F.col("end").alias("path"))).distinct()
    state, place, n = _store(ends.select(*VERTEX, F.lit(0).cast("bigint").alias("depth"), F.lit(True).alias("changed")))
    while n:
        risen = state.filter("changed").select("repo_id", F.col("path").alias("target"), "depth")
        told = short.join(risen, ["repo_id", "target"]).select("repo_id", F.col("source").alias("path"), (F.col("steps") + F.col("depth")).alias("depth"), F.lit(None).cast("bigint").alias("was"))
        both = state.select(*VERTEX, "depth", F.col("depth").alias("was")).unionByName(told).groupBy(*VERTEX).agg(F.max("depth").alias("depth"), F.max("was").alias("was"))
        nxt, where, n = _store(both.select(*VERTEX, "depth", (F.col("depth") > F.col("was")).alias("changed")))
        drop_table(spark, place)
        state, place = nxt, where
    behind = inner.join(state.select("repo_id", F.col("path").alias("end"), F.col("depth").alias("rest")), ["repo_id", "end"]).select(*VERTEX, (F.col("dist") + F.col("rest")).alias("depth"))
    reached = state.select(*VERTEX, "depth").unionByName(behind)
    out = write_table(reached.groupBy(*VERTEX).agg(F.max("depth").cast("int").alias("depth")))[0]
    for old in (dag_at, ahead_at, short_at, place):
        drop_table(spark, old)
    return out


def number_tiers(nodes: DataFrame) -> DataFrame:
    """nodes(repo_id, path, scc, is_cyclic, depth) plus tier_index: per depth one tier of all acyclic files, then one per cycle.

    The running index is a sum over depths, plus the cycle's rank inside its depth, so no window spans a repository.
    """
    groups = nodes.groupBy("repo_id", "depth", "is_cyclic", F.when(F.col("is_cyclic"), F.col("scc")).alias("cycle")).agg(F.lit(1).alias("one"))
    ranked = ordered_positions(groups.filter("is_cyclic").select("repo_id", "depth", "cycle"), ["repo_id", "depth"], ["cycle"], "rank")
    plain = F.max(F.when(~F.col("is_cyclic"), 1).otherwise(0)).alias("plain")
    per_depth = groups.groupBy("repo_id", "depth").agg(plain, F.sum(F.when(F.col("is_cyclic"), 1).otherwise(0)).alias("cycles"))
    before = Window.partitionBy("repo_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    per_depth = per_depth.select("repo_id", "depth", "plain", F.coalesce(F.sum(F.col("plain") + F.col("cycles")).over(before), F.lit(0)).alias("base"))
    cycle_rank = ranked.select("repo_id", "depth", F.col("cycle").alias("scc"), "rank")
    index = F.col("base") + F.when(F.col("is_cyclic"), F.col("plain") + F.col("rank") - 1).otherwise(0)
    return (
        nodes.join(per_depth, ["repo_id", "depth"]).join(cycle_rank, ["repo_id", "depth", "scc"], "left")
        .select(*VERTEX, "scc", "is_cyclic", "depth", index.cast("int").alias("tier_index"))
    )


def tier_table(edges: DataFrame, scc: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, scc, is_cyclic, depth, tier_index) of every connected file, from valid edges.

    Cycles and depths of a small repository come from one task together; `scc`, where given, is what large ones start from.
    """
    small, large = R.by_size(edges.select("repo_id", "source", "target"))
    here = R.placed_vertices(small).select(*VERTEX, "scc", (F.col("size") > 1).alias("is_cyclic"), "depth")
    large, place = write_table(large)
    if not large.isEmpty():
        scc = strongly_connected(large) if scc is None else scc
        nodes = with_scc(vertices(large), scc)
        units = nodes.select("repo_id", F.col("scc").alias("path")).distinct()
        depth = longest_depth(condensation(large, scc), units)
        here = here.unionByName(nodes.join(depth.withColumnRenamed("path", "scc"), ["repo_id", "scc"]).select(*VERTEX, "scc", "is_cyclic", "depth"))
    here, here_at = write_table(here)
    drop_table(edges.sparkSession, place)
    out, _ = write_table(number_tiers(here))
    drop_table(edges.sparkSession, here_at)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(repo_id, path, component): smallest member of each weakly connected group of two or more.

    Alternates large-star and small-star steps, which need about log(n) rounds however long a chain is. A hub's
    neighbours are only ever reduced to a minimum before they are joined back.
    """
    spark = edges.sparkSession
    flat = edges.select("repo_id", F.greatest("source", "target").alias("v"), F.least("source", "target").alias("p")).distinct()
    state, place, stamp = _fingerprint(flat)
    while True:
        both = state.unionByName(state.select("repo_id", F.col("p").alias("v"), F.col("v").alias("p")))
        low = both.groupBy("repo_id", "v").agg(F.min("p").alias("m")).select("repo_id", "v", F.least("v", "m").alias("m"))
        large = both.filter(F.col("p") > F.col("v")).join(low, ["repo_id", "v"]).select("repo_id", F.col("p").alias("v"), F.col("m").alias("p")).distinct()
        large_table, large_at = write_table(large)
        least = large_table.groupBy("repo_id", "v").agg(F.min("p").alias("m"))
        small = large_table.join(least, ["repo_id", "v"]).filter(F.col("p") != F.col("m")).select("repo_id", F.col("p").alias("v"), F.col("m").alias("p"))
        roots = least.select("repo_id", "v", F.col("m").alias("p"))
        nxt, where, after = _fingerprint(small.unionByName(roots).filter(F.col("v") != F.col("p")).distinct())
        drop_table(spark, place)
        drop_table(spark, large_at)
        state, place = nxt, where
        if after == stamp:
            break
        stamp = after
    stars = state.select("repo_id", F.col("v").alias("path"), F.col("p").alias("component"))
    return stars.unionByName(stars.select("repo_id", F.col("component").alias("path"), "component").distinct())


def _fingerprint(df: DataFrame) -> tuple[DataFrame, str, tuple]:
    """Store an edge set with an order-independent summary of it."""
    seen = Observation()
    h = F.xxhash64("repo_id", "v", "p")
    watched = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.sum(F.pmod(h, F.lit(1000003))).alias("t"))
    table, place = write_table(watched)
    got = seen.get
    return table, place, (got["n"], got["s"], got["t"])


def communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, path, community): label propagation on the undirected graph, until no vertex wants another label.

    A vertex wants the label most common among its neighbours and itself, the smallest among equals. In every round a half of the vertices,
    another one each time, chosen by a hash, takes what it wants; since neighbours seldom change together, agreement grows and no two labels
    can be exchanged for ever. The result is a fixpoint: every vertex has the label it wants.
    """
    spark = edges.sparkSession
    und = edges.select("repo_id", "source", "target").unionByName(edges.select("repo_id", F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    und, und_at = write_table(und)
    state, place, n = _store(nodes.select(*VERTEX, F.col("path").alias("community"), F.lit(True).alias("changed")))
    turn = 0
    while n:
        turn += 1
        sent = und.join(state.select("repo_id", F.col("path").alias("source"), "community"), ["repo_id", "source"]).select("repo_id", F.col("target").alias("path"), "community")
        votes = sent.unionByName(state.select(*VERTEX, "community")).groupBy(*VERTEX, "community").agg(F.count(F.lit(1)).alias("votes"))
        won = votes.groupBy(*VERTEX).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("community").alias("c"))).alias("_w"))
        mine = F.crc32(F.concat_ws(":", *VERTEX, F.lit(turn)).cast("binary")) % 2 == 0
        moved = won.join(state.select(*VERTEX, F.col("community").alias("was")), VERTEX).select(
            *VERTEX, F.when(mine, F.col("_w.c")).otherwise(F.col("was")).alias("community"), (F.col("_w.c") != F.col("was")).alias("changed"))
        nxt, where, n = _store(moved)
        drop_table(spark, place)
        state, place = nxt, where
    drop_table(spark, und_at)
    return state.drop("changed")


def modularity_communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, path, community) of `nodes`: communities by greedy modularity on the undirected graph, named by their smallest member.

    A file without edges is a community of its own. In a small repository the best pair of communities is united until no union raises
    modularity. In a large one many pairs are united a round, each of them raising it: see `_united_by_rounds`.
    """
    known = edges.filter("source <> target").select("repo_id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    small, large = R.by_size(known)
    found = R.greedy_members(small)
    large, place = write_table(large)
    if not large.isEmpty():
        found = found.unionByName(_united_by_rounds(large))
    out = nodes.select(*VERTEX).join(found, VERTEX, "left").select(*VERTEX, F.coalesce("community", "path").alias("community"))
    out, _ = write_table(out)
    drop_table(edges.sparkSession, place)
    return out


def _united_by_rounds(pairs: DataFrame) -> DataFrame:
    """(repo_id, path, community) of the vertices of undirected `pairs` (repo_id, source, target), each pair once, of repositories of any size.

    In each round communities are heads or joiners by a hash. A joiner whose best union is with a head asks for it; a head takes those who ask in order of
    worth as long as each raises modularity after the ones before it. The united graph has fewer vertices, with weights; rounds end when no union
    is worth anything.
    """
    spark = pairs.sparkSession
    total = pairs.groupBy("repo_id").agg((2 * F.count(F.lit(1))).alias("total"))
    ends = sources(pairs).unionByName(targets(pairs))
    state, state_at = write_table(ends.distinct().select(*VERTEX, F.col("path").alias("community")))
    own, own_at = write_table(ends.groupBy(*VERTEX).agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("path", "c"))
    links, links_at = write_table(pairs.select("repo_id", F.col("source").alias("a"), F.col("target").alias("b"), F.lit(1).cast("bigint").alias("w")))
    turn = 0
    while True:
        turn += 1
        both = links.unionByName(links.select("repo_id", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        degree = lambda c, name: own.select("repo_id", F.col("c").alias(c), F.col("degree").alias(name))  # noqa: E731, B023
        valued = both.join(degree("a", "da"), ["repo_id", "a"]).join(degree("b", "db"), ["repo_id", "b"]).join(total, "repo_id")
        valued = valued.withColumn("worth", F.col("total") * F.col("w") - F.col("da") * F.col("db")).filter("worth > 0")
        best = valued.groupBy("repo_id", "a").agg(F.min(F.struct((-F.col("worth")).alias("worth"), "b", "w", "da", "db", "total")).alias("x")).select("repo_id", "a", "x.*")
        best, best_at = write_table(best)
        if best.isEmpty():
            drop_table(spark, best_at)
            break
        heads = lambda c: F.pmod(F.xxhash64("repo_id", c, F.lit(turn)), F.lit(2)) == 0  # noqa: E731, B023
        asking = best.filter(~heads("a") & heads("b"))
        before = Window.partitionBy("repo_id", "b").orderBy("worth", "a").rowsBetween(Window.unboundedPreceding, -1)
        grown = F.col("db") + F.coalesce(F.sum("da").over(before), F.lit(0))
        taken = asking.withColumn("raises", F.col("total") * F.col("w") > F.col("da") * grown)
        # whoever would not raise it stays; the others count with all who asked before them, so each still raises it
        joins, joins_at = write_table(taken.filter("raises").select("repo_id", F.col("a").alias("c"), F.col("b").alias("into")))
        moved = lambda df, c: df.join(joins.select("repo_id", F.col("c").alias(c), "into"), ["repo_id", c], "left").withColumn(c, F.coalesce("into", c)).drop("into")  # noqa: E731, B023
        new_state, new_state_at = write_table(moved(state, "community"))
        new_own, new_own_at = write_table(moved(own, "c").groupBy("repo_id", "c").agg(F.sum("degree").alias("degree")))
        ends_of = moved(moved(links, "a"), "b").filter("a <> b").select("repo_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        new_links, new_links_at = write_table(ends_of.groupBy("repo_id", "a", "b").agg(F.sum("w").alias("w")))
        for old in (state_at, own_at, links_at, best_at, joins_at):
            drop_table(spark, old)
        state, own, links, state_at, own_at, links_at = new_state, new_own, new_links, new_state_at, new_own_at, new_links_at
    named = state.groupBy("repo_id", "community").agg(F.min("path").alias("least"))
    out, _ = write_table(state.join(named, ["repo_id", "community"]).select(*VERTEX, F.col("least").alias("community")))
    for old in (state_at, own_at, links_at):
        drop_table(spark, old)
    return out


def community_vote(members: DataFrame, threshold: float = 0.5) -> DataFrame:
    """members(repo_id, path, community, domain): domain each unclassified member takes from its community.

    The top domain must hold `threshold` of the community's classified members; equal counts go to the smaller name.
    """
    known = members.filter(F.col("domain") != "uncategorized")
    counts = known.groupBy("repo_id", "community", "domain").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("repo_id", "community").agg(
        F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), F.col("domain").alias("d"))).alias("_t"))
    winner = top.filter(-F.col("_t.k") / F.col("total") >= threshold).select("repo_id", "community", F.col("_t.d").alias("winner"))
    return members.filter(F.col("domain") == "uncategorized").join(winner, ["repo_id", "community"], "left").select(
        *VERTEX, F.coalesce("winner", F.lit("uncategorized")).alias("domain"))
