"""In what order were the files of each repository built, and how sure are we: the whole job over the test views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.operators import graph as G
from buildlore.operators import ordering as O
from buildlore.operators.scale import spread
from buildlore.plans import views as V
from buildlore.session import staged


def edge_table(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, "edges", sf, lambda: G.valid_edges(V.edges(spark, sf)))


def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, "cycles", sf, lambda: G.strongly_connected(edge_table(spark, sf)))


def tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Tier of every connected file; built once per session and folder, then read by every plan that needs it."""
    return staged(spark, "tiers", sf, lambda: G.tier_table(edge_table(spark, sf)))


def communities(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, "communities", sf, lambda: G.modularity_communities(edge_table(spark, sf), file_table(spark, sf)))


def placed_files(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, repo_id, path, tier_index) of every connected file: small rows, to be joined before any text is."""
    return file_table(spark, sf).select("doc_id", "repo_id", "path").join(tiers(spark, sf).select("repo_id", "path", "tier_index"), ["repo_id", "path"])


def file_table(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, "files", sf, lambda: V.files(spark, sf).select("repo_id", "n", "path", F.col("doc_id")))


def domain_table(spark: SparkSession, sf: str) -> DataFrame:
    """(repo_id, path, domain, confidence) of every file by the conventions, told once for all that a plan does with them; by all cores, as the files are few bytes."""
    return staged(spark, "domains", sf, lambda: O.convention_domains(spread(file_table(spark, sf))))
