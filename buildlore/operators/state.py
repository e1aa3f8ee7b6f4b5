"""Latest-state folds that need no order-dependent step: maxima, latest values and first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_SECONDS = 900
ATTEMPT = ["user_id", "job_id", "milestone_tier"]


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the earliest: a partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def attempt_states(events: DataFrame) -> DataFrame:
    """events(..., ts, event_id, scratch, code, status, hint_level, revealed): one state per attempt.

    Hints only rise, reveals stay, code and status are the latest graded ones; scratch runs touch their own column only.
    """
    place = F.struct("ts", "event_id")
    graded = ~F.col("scratch")
    last = lambda c, cond: F.max_by(F.when(cond, F.col(c)), F.when(cond, place))
    return events.groupBy(*ATTEMPT).agg(
        F.coalesce(F.max(F.when(graded, F.col("hint_level"))), F.lit(0)).alias("hint_level"),
        F.coalesce(F.max(F.when(graded, F.col("revealed"))), F.lit(False)).alias("revealed"),
        F.coalesce(last("status", graded), F.lit("not_started")).alias("status"),
        F.coalesce(last("code", graded), F.lit("")).alias("submitted_code"),
        last("code", ~graded).alias("last_run_code"),
        F.max("ts").alias("updated_at"),
    )


def latest_values(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Latest non-null value of every column: a null keeps the older value."""
    place = F.struct(*order)
    return events.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def stale_runs(repos: DataFrame, now: Column, timeout: int = STALE_SECONDS) -> DataFrame:
    """Of each address and commit the newest unexpired run becomes failed, with the reason, if it still processes long after its last heartbeat.

    Older and expired runs stay as they are. Of runs created at the same time the one with the smaller id counts as the newest.
    """
    age = F.timestamp_diff("SECOND", F.col("created_at"), now)
    live = repos.filter(F.col("expires_at") > now)
    newest = live.groupBy("github_url", "commit_hash").agg(F.max_by("id", F.struct("created_at", -F.col("id"))).alias("id")).select("id", F.lit(True).alias("_newest"))
    repos = repos.join(newest, "id", "left")
    stale = F.col("_newest").isNotNull() & (F.col("status") == "processing") & (age >= timeout)
    message = F.concat(F.lit("Processing lock expired after "), age.cast("string"), F.lit(f"s (timeout: {timeout}s). Dead worker detected; lock reclaimed."))
    failed = F.when(stale, "failed").otherwise(F.col("status"))
    return repos.withColumn("error_message", F.when(stale, message)).withColumn("status", failed).drop("_newest")


def retained(repos: DataFrame, now: Column) -> DataFrame:
    """What a purge keeps: unexpired snapshots and those marked to stay."""
    return repos.filter((F.col("expires_at") > now) | F.col("keep_longer"))


def surviving_children(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent survived."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_anti")


def prunable_backups(listing: DataFrame, now: Column, days: int) -> DataFrame:
    """Backups past retention, except Sundays of the last 30 days."""
    at = F.col("modified_at")
    old = at < F.timestamp_add("DAY", F.lit(-days), now)
    whole_days = F.floor(F.timestamp_diff("SECOND", at, now) / 86400)
    kind = F.col("name").rlike(r"\.(gz|sha256|json)$")
    return listing.filter(kind & old & ~((F.dayofweek(at) == 1) & (whole_days <= 30)))


def stage_progress(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first completion of every stage of a run, latest percentage of every run)."""
    done = first_of(events.filter("completed").select("run_id", "stage", "ts", "event_id"), ["run_id", "stage"], ["ts", "event_id"])
    latest = events.groupBy("run_id").agg(F.max_by("pct", F.struct("ts", "event_id")).alias("pct"), F.max("ts").alias("ts"))
    return done, latest


def hint_gate(requests: DataFrame, submissions: DataFrame) -> DataFrame:
    """requests(user, job, tier, id, ts, mode): level granted to each, or locked.

    The first request of an attempt always gives level 1. Any later one asks for level 2, which needs code submitted
    before it unless the mode is `fill`, so the answer follows from two minima and needs no running state.
    """
    place = F.struct("ts", "id")
    first = requests.groupBy(*ATTEMPT).agg(F.min(place).alias("_first"))
    coded = submissions.groupBy(*ATTEMPT).agg(F.min("ts").alias("_coded"))
    out = requests.join(first, ATTEMPT).join(coded, ATTEMPT, "left")
    is_first = place == F.col("_first")
    open_ = (F.col("mode") == "fill") | F.coalesce(F.col("_coded") < F.col("ts"), F.lit(False))
    return out.select(*ATTEMPT, "id", F.when(is_first, 1).when(open_, 2).alias("level"), (~is_first & ~open_).alias("locked"))
