"""Domains, tie-breaks inside tiers, and confidence per file and repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlore.functions.rules import classify
from buildlore.operators.graph import community_vote
from buildlore.operators.scale import attach_counts

# Which domain is built first.
DOMAIN_PRIORITY = {
    "config": 1, "database": 2, "core": 3, "backend": 4, "frontend": 5, "examples": 6, "tests": 7, "docs": 8, "uncategorized": 9,
}
UNKNOWN_PRIORITY = 8
TIER = ["repo_id", "tier_index"]


def convention_domains(files: DataFrame) -> DataFrame:
    lang = F.col("language") if "language" in files.columns else None
    return files.select("repo_id", "path", classify(F.col("path"), lang).alias("_c")).select("repo_id", "path", "_c.domain", "_c.confidence")


def segment(files: DataFrame, communities: DataFrame) -> DataFrame:
    """Conventions first, then the vote of each file's community, else uncategorized."""
    named = convention_domains(files)
    members = named.join(communities, ["repo_id", "path"], "left")
    voted = community_vote(members).select("repo_id", "path", F.col("domain").alias("vote"))
    out = named.join(voted, ["repo_id", "path"], "left")
    by_rule = F.col("domain") != "uncategorized"
    by_vote = F.coalesce(F.col("vote"), F.lit("uncategorized")) != "uncategorized"
    return out.select(
        "repo_id", "path", F.when(by_rule, F.col("domain")).when(by_vote, F.col("vote")).otherwise("uncategorized").alias("domain"),
        F.when(by_rule, "convention").when(by_vote, "graph").otherwise("uncategorized").alias("method"),
        F.when(by_rule, F.col("confidence")).when(by_vote, "medium").otherwise("low").alias("confidence"),
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(repo_id, kind, value, files): how often each value of the columns occurs; the columns are counted in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in columns])
    return df.select("repo_id", F.explode(pairs).alias("_p")).groupBy("repo_id", "_p.kind", "_p.value").agg(F.count(F.lit(1)).alias("files"))


def priority(domain: Column) -> Column:
    out = None
    for name, rank in DOMAIN_PRIORITY.items():
        out = F.when(F.lower(domain) == name, rank) if out is None else out.when(F.lower(domain) == name, rank)
    return out.otherwise(UNKNOWN_PRIORITY)


def tie_groups(tiers: DataFrame, first_seen: DataFrame, history: DataFrame) -> DataFrame:
    """Adds `group_key` (the timestamp that splits a tier, or -1 when history does not) and the sizes ties are judged by.

    Tier and group facts are aggregates joined back, so a tier that holds a third of all files is never one task's work.
    """
    seen = first_seen.select("repo_id", "path", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("at"))
    usable = first_seen.select("repo_id").distinct().join(history, "repo_id").filter(F.col("available") & (F.col("confidence") != "reduced"))
    files = tiers.join(seen, ["repo_id", "path"], "left").join(usable.select("repo_id", F.lit(True).alias("usable")), "repo_id", "left")
    files = attach_counts(files, TIER, tier_size=F.count(F.lit(1)), dated=F.count("at"), oldest=F.min("at"), newest=F.max("at"))
    splits = F.coalesce(F.col("usable"), F.lit(False)) & (F.col("dated") == F.col("tier_size")) & (F.col("oldest") != F.col("newest"))
    files = files.withColumn("by_history", splits).withColumn("group_key", F.when(splits, F.col("at")).otherwise(F.lit(-1).cast("bigint")))
    files = files.withColumn("prio", priority(F.coalesce("domain", F.lit("uncategorized"))))
    return attach_counts(files, [*TIER, "group_key"], group_size=F.count(F.lit(1)), low=F.min("prio"), high=F.max("prio"))


def accepted_proposals(groups: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposed orders (repo_id, tier_index, group_key, pos, path) that are permutations of their group."""
    key = [*TIER, "group_key"]
    here = groups.select(*key, "path", "group_size", F.lit(1).alias("known"))
    sizes = groups.select(*key, "group_size").distinct()
    judged = proposals.join(here.drop("group_size"), [*key, "path"], "left").groupBy(*key).agg(
        F.count(F.lit(1)).alias("listed"), F.sum("known").alias("known"), F.count_distinct("path").alias("different"))
    good = judged.join(sizes, key).filter(
        (F.col("listed") == F.col("group_size")) & (F.col("known") == F.col("group_size")) & (F.col("different") == F.col("group_size")))
    return proposals.join(good.select(*key), key, "left_semi")


def break_ties(groups: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """Adds `method` and the columns that order a tier: group_key, rank, path."""
    method = (
        F.when(F.col("tier_size") == 1, "none")
        .when(F.col("by_history") & (F.col("group_size") == 1), "history")
        .when(F.col("low") != F.col("high"), "heuristic")
    )
    ranked = groups.withColumn("method", method).withColumn("rank", F.when(F.col("method") == "heuristic", F.col("prio")).otherwise(0))
    if proposals is None:
        return ranked.withColumn("method", F.coalesce("method", F.lit("unresolved")))
    ok = accepted_proposals(groups, proposals).select(*TIER, "group_key", "path", F.col("pos").alias("proposed"))
    out = ranked.join(ok, [*TIER, "group_key", "path"], "left")
    used = F.col("method").isNull() & F.col("proposed").isNotNull()
    return (
        out.withColumn("rank", F.when(used, F.col("proposed")).otherwise(F.col("rank")))
        .withColumn("method", F.when(used, "llm").otherwise(F.coalesce("method", F.lit("unresolved"))))
        .drop("proposed")
    )


def score(refined: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Adds `confidence` and `reason`; without any history the reduced-history rule never fires."""
    if history is None:
        df, reduced = refined, F.lit(False)
    else:
        df = refined.join(history.select("repo_id", F.col("available").alias("_a"), F.col("confidence").alias("_c")), "repo_id", "left")
        reduced = F.coalesce(F.col("_a") & (F.col("_c") == "reduced"), F.lit(False))
    m = F.col("method")
    rules = [
        (F.col("is_cyclic"), "low", "cyclic cluster (circular dependency)"),
        (reduced, "low", "reduced history confidence (squashed or rebased commits)"),
        (m == "unresolved", "low", "unresolved tie within tier"),
        (m == "none", "high", "topology (hard dependency fact)"),
        (m == "history", "high", "topology + verified history"),
        (m == "heuristic", "medium", "topology + domain heuristic tie-break"),
        (m == "llm", "medium", "topology + LLM tie-break"),
    ]
    conf = reason = None
    for cond, c, r in rules:
        conf = F.when(cond, c) if conf is None else conf.when(cond, c)
        reason = F.when(cond, r) if reason is None else reason.when(cond, r)
    reason = reason.otherwise(F.concat(F.lit("topology + "), m, F.lit(" tie-break")))
    return df.withColumn("confidence", conf.otherwise("medium")).withColumn("reason", reason).drop("_a", "_c")


def score_isolated(isolated: DataFrame) -> DataFrame:
    return isolated.select(
        "repo_id", "path", F.lit(-1).alias("tier_index"), F.lit("low").alias("confidence"),
        F.lit("isolated, no internal dependency signal").alias("reason"), F.lit("none").alias("method"))


def share(condition: Column) -> Column:
    """Percentage of rows that meet a condition, two decimals, halves to even."""
    return F.bround(F.count_if(condition) / F.count(F.lit(1)) * 100.0, 2)


def confidence_summary(scored: DataFrame, repos: DataFrame) -> DataFrame:
    c = F.col("confidence")
    got = scored.groupBy("repo_id").agg(*[share(c == level).alias(f"{level}_pct") for level in ("high", "medium", "low")])
    out = repos.select("repo_id").distinct().join(got, "repo_id", "left")
    return out.select("repo_id", *[F.coalesce(f"{level}_pct", F.lit(0.0)).alias(f"{level}_pct") for level in ("high", "medium", "low")])
