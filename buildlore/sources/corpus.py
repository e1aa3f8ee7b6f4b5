"""Readers for file corpora, file listings and exported commit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.functions.paths import basename, normalize, suffix

LISTING_SCHEMA = "struct<tree:array<struct<path:string,type:string,size:bigint>>>"


def scan_folder(spark: SparkSession, root: str, repo_id: str, pattern: str = "*") -> DataFrame:
    """One row per file below `root`, content still binary. Spark lists and splits the work."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("://")[-1]
    full = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    path = F.when(F.startswith(full, F.lit(base + "/")), F.substring(full, F.lit(len(base) + 2), F.length(full))).otherwise(full)
    return raw.select(F.lit(repo_id).alias("repo_id"), path.alias("path"), F.col("length").alias("size_bytes"), "content")


def scan_documents(docs: DataFrame) -> DataFrame:
    """The corpus when it already is a table: path, size, extension and content, nothing else read."""
    return docs.select("repo_id", "path", "size_bytes", F.lower(suffix(basename(normalize(F.col("path"))))).alias("ext"), "content")


def decode_text(content):
    """UTF-8 text of a binary column with undecodable bytes replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def parse_listings(listings: DataFrame) -> DataFrame:
    """Repository listings (one JSON page per row) to one row per blob."""
    tree = F.explode(F.from_json("listing", LISTING_SCHEMA).getField("tree"))
    return (
        listings.select("repo_id", tree.alias("item"))
        .filter(F.col("item.type") == "blob")
        .select("repo_id", F.col("item.path").alias("path"), F.col("item.size").alias("size_bytes"))
    )


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Exported logs, one record per commit: the record separator is the commit header, so no record needs its neighbours."""
    raw = spark.read.option("lineSep", "\nCOMMIT:").text(path)
    return raw.select(F.regexp_replace("value", r"^COMMIT:", "").alias("block"), F.input_file_name().alias("log"))


def parse_commits(blocks: DataFrame, *keep: str) -> DataFrame:
    """Commit blocks (header line, then tab-separated status lines) to one row per changed file, null path for none."""
    body = F.transform(F.split("block", r"\r?\n"), lambda line: F.trim(line))
    head = F.split(F.element_at(body, 1), r"\|", 4)
    rows = F.filter(F.slice(body, F.lit(2), F.size(body)), lambda line: F.contains(line, F.lit("\t")))
    field = lambda i: F.coalesce(F.try_element_at(head, F.lit(i)), F.lit(""))
    out = blocks.select(
        *keep, field(1).alias("hash"), field(2).alias("timestamp"), field(3).alias("author"), field(4).alias("message"),
        F.posexplode_outer(rows).alias("pos", "row"),
    )
    p = F.split("row", "\t")
    renamed = F.col("row").startswith("R") & (F.size(p) >= 3)
    status = (
        F.when(renamed, "renamed")
        .when(F.col("row").startswith("A"), "added")
        .when(F.col("row").startswith("D"), "deleted")
        .when(F.col("row").isNotNull(), "modified")
    )
    slash = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    return out.select(
        *keep, "hash", "timestamp", "author", "message", "pos", status.alias("change_type"),
        slash(F.when(renamed, F.try_element_at(p, F.lit(3))).otherwise(F.try_element_at(p, F.lit(2)))).alias("path"),
        slash(F.when(renamed, F.try_element_at(p, F.lit(2)))).alias("old_path"),
    )


# The timestamp spellings a text store may hold, in the order they are tried.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd",
]


def coerce_timestamp(text):
    clean = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(fmt)) for fmt in TIMESTAMP_FORMATS])


def coerce_boolean(number):
    return number.isNotNull() & (number != 0)
