"""Stored analysis documents: reading them back as columns, and writing the graph export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlore.functions.text import line_count, literal_map
from buildlore.operators.milestones import fallback_domain

DOCUMENT = (
    "struct<architecture_overview:struct<total_files:bigint,total_loc:bigint>,total_files:bigint,total_nodes:bigint,total_loc:bigint,"
    "nodes:array<struct<id:string,path:string,tier:int,domain:string,exports:array<string>,source_code:string,test_code:string>>,"
    "edges:array<struct<source:string,target:string>>>"
)

# Colour of each domain in a drawn graph.
DOMAIN_COLOURS = {
    "core": "#3B82F6", "backend": "#10B981", "frontend": "#8B5CF6", "database": "#F59E0B", "tests": "#6B7280", "config": "#EC4899",
    "docs": "#14B8A6", "build": "#F97316", "devops": "#6366F1", "examples": "#84CC16", "uncategorized": "#9CA3AF",
}
OTHER_COLOUR = "#9CA3AF"


def with_document(jobs: DataFrame, column: str = "graph_json") -> DataFrame:
    """Adds `doc`, the typed document; anything unreadable counts as empty."""
    return jobs.withColumn("doc", F.from_json(column, DOCUMENT))


def document_nodes(jobs: DataFrame) -> DataFrame:
    """(id, node...) of every stored document, one row per node; documents without nodes keep one empty row."""
    return with_document(jobs).select("id", F.explode_outer("doc.nodes").alias("node")).select(
        "id", F.coalesce("node.path", "node.id").alias("path"), "node.tier", "node.domain", F.coalesce(F.size("node.exports"), F.lit(0)).alias("exports"))


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def complexity(jobs: DataFrame) -> DataFrame:
    """Files and lines of each analysed repository: overview, then direct fields, then what nodes and report text allow."""
    doc = with_document(jobs)
    ov_files, ov_loc = F.col("doc.architecture_overview.total_files"), F.col("doc.architecture_overview.total_loc")
    use_ov = F.coalesce((ov_files > 0) & (ov_loc > 0), F.lit(False))
    nodes = F.col("doc.nodes")
    counted = F.coalesce(_positive(F.col("doc.total_files")), _positive(F.col("doc.total_nodes")), F.when(nodes.isNotNull(), F.size(nodes)), F.lit(0))
    loc = F.coalesce(F.col("doc.total_loc"), F.lit(0))
    told = F.regexp_extract("markdown", r"Total Analyzed Files\*\*:\s*`?(\d+)`?", 1)
    files = F.when((counted == 0) & (loc == 0) & (told != ""), told.cast("bigint")).otherwise(counted)
    text = lambda n: F.coalesce(F.when(n["source_code"] != "", n["source_code"]), n["test_code"], F.lit(""))
    estimate = F.aggregate(F.coalesce(nodes, F.array().cast("array<struct<id:string,path:string,tier:int,domain:string,exports:array<string>,source_code:string,test_code:string>>")),
                           F.lit(0), lambda acc, n: acc + line_count(text(n)))
    lines = F.when(loc > 0, loc).otherwise(estimate)
    return doc.select("id", F.when(use_ov, ov_files).otherwise(files).alias("files"), F.when(use_ov, ov_loc).otherwise(lines).alias("loc"))


def learning_progress(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Distinct tiers of each completed job against its verified attempts, as a whole percentage."""
    tiers = F.size(F.array_distinct(F.filter(F.transform("doc.nodes", lambda n: n["tier"]), lambda t: t.isNotNull())))
    told = F.regexp_count("markdown", F.lit(r"###\s+Milestone\s+\d+:"))
    solved = attempts.filter("status = 'structurally_verified'").groupBy("job_id").agg(F.count(F.lit(1)).alias("verified"))
    out = with_document(jobs.filter("status = 'completed'")).join(solved, F.col("id") == F.col("job_id"), "left")
    verified = F.coalesce("verified", F.lit(0))
    total = F.coalesce(_positive(tiers), _positive(told), _positive(verified), F.lit(0))
    total = F.greatest(F.lit(1), total)
    return out.select("id", verified.alias("verified"), total.alias("milestones"), (verified / total.cast("double") * 100).cast("int").alias("pct"))


def graph_nodes(members: DataFrame, facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """One JSON node per placed file. facts as from `milestones.described`."""
    exports = symbols.groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("symbol")).alias("exports"))
    f = facts.select("repo_id", "tier_index", F.col("dominant_domain").alias("dom"), "dominant_confidence", "is_cyclic")
    df = members.select("repo_id", "path", "tier_index").join(f, ["repo_id", "tier_index"]).join(exports, ["repo_id", "path"], "left")
    domain = F.when(F.col("dom") == "mixed", fallback_domain(F.col("path"), "graph")).otherwise(F.col("dom"))
    df = df.withColumn("domain", domain)
    colour = F.coalesce(F.try_element_at(literal_map(DOMAIN_COLOURS), F.lower("domain")), F.lit(OTHER_COLOUR))
    node = F.struct(
        F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), "path", F.col("tier_index").alias("tier"), "domain", colour.alias("color"),
        F.col("dominant_confidence").alias("confidence"), "is_cyclic", F.lit(False).alias("is_isolated"), F.coalesce("exports", F.array().cast("array<string>")).alias("exports"))
    return df.select("repo_id", F.lit("node").alias("kind"), F.to_json(node).alias("payload"))


def graph_edges(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", F.lit("edge").alias("kind"), F.to_json(F.struct("source", "target", F.lit("import").alias("type"))).alias("payload"))


def graph_tiers(members: DataFrame) -> DataFrame:
    """Tier membership, a row per file: a tier's list has no bound."""
    return members.select("repo_id", F.lit("tier").alias("kind"), F.to_json(F.struct(F.col("tier_index").alias("tier"), "path")).alias("payload"))


def graph_overview(members: DataFrame, files: DataFrame) -> DataFrame:
    counts = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"))
    placed = members.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_nodes"))
    return counts.join(placed, "repo_id", "left").select("repo_id", F.lit("overview").alias("kind"), F.to_json(F.struct(
        F.col("repo_id").alias("repo_name"), F.coalesce("total_nodes", F.lit(0)).alias("total_nodes"), "total_files")).alias("payload"))


def run_summary(repos: DataFrame) -> DataFrame:
    """repos(repo_id, recorded, lacks_counts, readable): totals of one backfill run."""
    need = F.col("readable") & ((F.col("recorded") > 0) | F.col("lacks_counts"))
    return repos.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("readable") & ~need).alias("clean"), F.count_if(need).alias("needing_update"), F.count_if(~F.col("readable")).alias("errors"))


