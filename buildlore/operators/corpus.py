"""Corpus filtering: what is kept, what is skipped and why, and which repositories are too large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlore.functions.paths import exclusion_reason, hardening_reason, is_binary_content, normalize, parents
from buildlore.functions.text import REDACTED, redact_secrets
from buildlore.operators.scale import attach_counts, first_rows

FILE_CAP = 150


def with_reason(files: DataFrame, subpath: Column | None = None, binary: bool = False) -> DataFrame:
    """Adds `reason`: null for files to keep, else the first of path, hardening and content rules that rejects them."""
    rules = [
        exclusion_reason(F.col("path"), subpath, F.col("size_bytes")),
        F.concat(F.lit("skipped — "), hardening_reason(F.col("path"))),
    ]
    if binary:
        rules.append(F.when(is_binary_content(F.col("content")), F.lit("skipped — binary file")))
    return files.withColumn("reason", F.coalesce(*rules))


def split_files(files: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped); both read the same expression, so the scan prunes columns for each side on its own."""
    marked = with_reason(files, **options)
    kept = marked.filter(F.col("reason").isNull()).drop("reason")
    skipped = marked.filter(F.col("reason").isNotNull()).select("repo_id", "path", "reason")
    return kept, skipped


FEW_NAMES = 8


def directory_counts(files: DataFrame) -> DataFrame:
    """(directory, times) for the directories above every file. A path of few different names is counted before its names become rows."""
    named = files.select(parents(normalize(F.col("path"))).alias("_names")).withColumn("_own", F.array_distinct("_names"))
    told = lambda n: lambda d: F.struct(d.alias("directory"), n(d).cast("bigint").alias("times"))
    counted = F.transform("_own", told(lambda d: F.size("_names") - F.size(F.array_remove("_names", d))))
    rows = F.when(F.size("_own") <= FEW_NAMES, counted).otherwise(F.transform("_names", told(lambda d: F.lit(1))))
    return named.select(F.explode(rows).alias("_d")).select("_d.*")


def file_cap(files: DataFrame, cap: int = FILE_CAP) -> tuple[DataFrame, DataFrame]:
    """(files of repositories within the cap, rejected repositories with their count)."""
    counts = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("file_count"))
    rejected = counts.filter(F.col("file_count") > cap)
    return files.join(rejected, "repo_id", "left_anti"), rejected


def repo_counts(files: DataFrame, cap: int = FILE_CAP) -> DataFrame:
    counts = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("file_count"))
    return counts.withColumn("within_cap", F.col("file_count") <= cap)


def redact_files(files: DataFrame) -> DataFrame:
    """Replaces secrets in `content` and adds `redaction_count`."""
    found = files.withColumn("_r", redact_secrets(F.col("content")))
    return found.withColumn("content", F.col("_r.text")).withColumn("redaction_count", F.col("_r.count")).drop("_r")


def redacted_paths(files: DataFrame) -> DataFrame:
    """Files that hold redactions: by recorded count, or by a new scan when a repository recorded none per file."""
    seen = attach_counts(
        files, ["repo_id"], _known=F.max(F.col("redaction_count").isNotNull()), _total=F.max("repo_redactions")
    )
    by_count = F.col("_known") & (F.coalesce(F.col("redaction_count"), F.lit(0)) > 0)
    rescan = ~F.col("_known") & (F.coalesce(F.col("_total"), F.lit(0)) > 0)
    dirty = (redact_secrets(F.col("content")).getField("count") > 0) | F.contains("content", F.lit(REDACTED))
    hit = F.when(by_count, True).when(rescan, dirty).otherwise(False)
    return seen.filter(hit).select("repo_id", "path")


def needs_backfill(files: DataFrame) -> DataFrame:
    """Repositories to scan again: something was redacted, or a file has no count of its own."""
    return (
        files.groupBy("repo_id")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.max("repo_redactions"), F.lit(0)).alias("recorded"),
            F.max(F.col("redaction_count").isNull()).alias("lacks_counts"),
        )
        .withColumn("needs_update", (F.col("recorded") > 0) | F.col("lacks_counts"))
    )


def active_snapshots(repos: DataFrame, now: Column) -> DataFrame:
    """The newest complete, unexpired snapshot of every (address, commit)."""
    live = repos.filter((F.col("status") == "complete") & (F.col("expires_at") > now))
    newest = F.max(F.struct("created_at", "id")).alias("_m")
    return live.groupBy("github_url", "commit_hash").agg(newest).select(
        "github_url", "commit_hash", F.col("_m.id").alias("id"), F.col("_m.created_at").alias("created_at")
    )


def is_paid(status: Column, period_end: Column, now: Column) -> Column:
    return F.coalesce(status.isin("active", "trialing") & (period_end.isNull() | (period_end > now)), F.lit(False))


def active_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now))


def revoke_tokens(tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Revoke every still-open token of the given users."""
    flagged = tokens.join(users.select("user_id").distinct().withColumn("_hit", F.lit(True)), "user_id", "left")
    return flagged.withColumn(
        "revoked_at", F.when(F.col("_hit") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))
    ).drop("_hit")


def test_run_passed(exit_code: Column, stdout: Column, stderr: Column, timed_out: Column) -> Column:
    failed = (exit_code != 0) | F.contains(stdout, F.lit("FAILED (")) | F.contains(stdout, F.lit("FAIL:")) | F.contains(stderr, F.lit("FAIL:"))
    return ~failed & ~timed_out


def latest_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    return first_rows(jobs, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], limit, "position")
