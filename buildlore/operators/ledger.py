"""Points, quotas, leaderboards and latency figures over append-only tables. `now` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlore.operators.corpus import is_paid
from buildlore.operators.scale import first_rows
from buildlore.session import drop_table, write_table

# Fixed values of the points economy.
BASE_POINTS = 50
HINT_MULTIPLIERS = {0: 1.0, 1: 0.5, 2: 0.25}
MIN_FILES, MIN_LOC = 5, 150
EXPIRY_DAYS = 180
REDEMPTION_COST, REDEMPTION_REWARD = 100, 2
BADGES = [
    ("first_milestone", "solves", 1), ("zero_hint_streak_5", "clean_solves", 5), ("repo_explorer", "repos", 3),
    ("century_club", "lifetime", 100), ("architect_master", "solves", 10),
]
MIN_SAMPLES = 3


def cutoff(now: Column, days: int = EXPIRY_DAYS) -> Column:
    return F.timestamp_add("DAY", F.lit(-days), now)


def balances(ledger: DataFrame, now: Column) -> DataFrame:
    """Active balance (spends always count, so it is floored at 0), lifetime points and expired points per user."""
    p, fresh = F.col("points"), F.col("created_at") >= cutoff(now)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, p)), F.lit(0)).cast("bigint")
    return ledger.groupBy("user_id").agg(
        F.greatest(F.lit(0), total(fresh | (p < 0))).alias("balance"), total(p > 0).alias("lifetime"), total((p > 0) & ~fresh).alias("expired"))


def quota_bonus(ledger: DataFrame, now: Column) -> DataFrame:
    hit = F.col("reason").startswith("redemption_quota_bump") & (F.col("created_at") >= F.date_trunc("month", now))
    return ledger.groupBy("user_id").agg((F.count_if(hit) * REDEMPTION_REWARD).alias("bonus"))


def monthly_usage(usage: DataFrame, now: Column) -> DataFrame:
    month = usage.filter(F.col("created_at") >= F.date_trunc("month", now))
    return month.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("used"))


def billing_status(users: DataFrame, subs: DataFrame, usage: DataFrame, ledger: DataFrame, now: Column, base_quota: int) -> DataFrame:
    """Tier, usage, quota (null when paid) and whether the quota is used up."""
    used = monthly_usage(usage.filter("event_type = 'repo_analysis'"), now).select("user_id", "used")
    s = subs.select("user_id", "status", "current_period_end")
    out = users.select(F.col("id").alias("user_id")).join(s, "user_id", "left").join(used, "user_id", "left").join(quota_bonus(ledger, now), "user_id", "left")
    paid = is_paid(F.col("status"), F.col("current_period_end"), now)
    count = F.coalesce("used", F.lit(0))
    quota = F.when(~paid, F.lit(base_quota) + F.coalesce("bonus", F.lit(0)))
    return out.select(
        "user_id", F.when(paid, "paid").otherwise("free").alias("tier"), F.coalesce("status", F.lit("inactive")).alias("subscription_status"),
        count.alias("monthly_usage"), quota.alias("monthly_quota"), F.coalesce(count >= quota, F.lit(False)).alias("is_quota_exceeded"))


def badges(users: DataFrame, attempts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Five rows per user: earned, capped progress, whole percent."""
    done = attempts.filter("status = 'structurally_verified'")
    clean = (F.col("hint_level") == 0) & ~F.col("revealed")
    solves = done.groupBy("user_id").agg(F.count(F.lit(1)).alias("solves"), F.count_if(clean).alias("clean_solves"))
    jobs = done.select("user_id", "job_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("repos"))
    life = ledger.filter("points > 0").groupBy("user_id").agg(F.sum("points").alias("lifetime"))
    facts = users.select(F.col("id").alias("user_id")).join(solves, "user_id", "left").join(jobs, "user_id", "left").join(life, "user_id", "left")
    rows = []
    for badge, fact, target in BADGES:
        x = F.coalesce(F.col(fact), F.lit(0)).cast("bigint")
        rows.append(F.struct(
            F.lit(badge).alias("badge"), (x >= target).alias("earned"), F.least(F.lit(target), x).alias("progress"), F.lit(target).alias("target"),
            F.least(F.lit(100), (x / F.lit(float(target)) * 100).cast("int")).alias("pct")))
    return facts.select("user_id", F.explode(F.array(*rows)).alias("_b")).select("user_id", "_b.*")


def user_points(users: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every user with the points earned; the condition is part of the join, so users without any stay with 0."""
    earned = ledger.filter("points > 0").groupBy("user_id").agg(F.sum("points").alias("earned"))
    return users.join(earned, users["id"] == earned["user_id"], "left").select(
        F.col("id").alias("user_id"), "username", F.coalesce("earned", F.lit(0)).alias("points"))


def leaderboard(points: DataFrame, caller: int, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page plus the caller's own row. Only the page is sorted; the caller's rank is a count of better rows.

    A caller who is not a user gets rank 1 and no points.
    """
    best = [F.col("points").desc(), F.col("user_id")]
    top = points.orderBy(*best).limit(offset + limit)
    page = top.withColumn("rank", F.row_number().over(Window.orderBy(*best))).filter(F.col("rank") > offset)
    page = page.select(F.lit("page").alias("section"), "rank", "user_id", "points")
    mine = points.filter(F.col("user_id") == caller).agg(F.max("points")).scalar()
    ahead = (F.col("points") > mine) | ((F.col("points") == mine) & (F.col("user_id") < caller))
    own = points.filter(ahead).agg((F.count(F.lit(1)) + 1).alias("rank")).select(
        F.lit("caller").alias("section"), "rank", F.lit(caller).alias("user_id"), F.coalesce(mine, F.lit(0)).alias("points"))
    size = points.agg(F.count(F.lit(1)).alias("rank")).select(F.lit("total_users").alias("section"), "rank", F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("bigint").alias("points"))
    return page.unionByName(own).unionByName(size)


def awards(solves: DataFrame) -> DataFrame:
    """solves(user_id, job_id, tier, ts, id, files, loc, hint_level, revealed): points, multiplier and reason of each.

    Whether a positive award came earlier is one minimum per (user, job, tier), joined back.
    """
    key = ["user_id", "job_id", "milestone_tier"]
    floor = (F.col("files") < MIN_FILES) | (F.col("loc") < MIN_LOC)
    level = F.least(F.lit(2), F.col("hint_level"))
    multiplier = F.when(level == 1, HINT_MULTIPLIERS[1]).when(level == 2, HINT_MULTIPLIERS[2]).otherwise(HINT_MULTIPLIERS[0])
    worth = F.when(floor | F.col("revealed"), 0).otherwise(F.floor(F.lit(BASE_POINTS) * multiplier))
    marked = solves.withColumn("_worth", worth).withColumn("_at", F.struct("ts", "id"))
    first = marked.filter("_worth > 0").groupBy(*key).agg(F.min("_at").alias("_first"))
    late = F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))
    reason = (
        F.when(late, "first_solve_already_awarded").when(floor, "below_complexity_floor").when(F.col("revealed"), "solution_revealed")
        .when(level == 1, "milestone_solved_hint_1").when(level == 2, "milestone_solved_hint_2").otherwise("milestone_solved_no_hints"))
    return marked.join(first, key, "left").select(
        "id", *key, F.when(late, 0).otherwise(F.col("_worth")).alias("points"),
        F.when(late | floor | F.col("revealed"), 0.0).otherwise(multiplier).alias("multiplier"), reason.alias("reason"))


def quota_gate(requests: DataFrame, limit: int) -> DataFrame:
    """Marks the first `limit` requests of every user and month as allowed; refused ones are not recorded.

    The limit-th request is found with a top-k per group, and each request is compared with it.
    """
    by_month = requests.withColumn("month", F.date_trunc("month", "created_at"))
    place = F.struct("created_at", "id")
    edge = first_rows(by_month, ["user_id", "month"], ["created_at", "id"], limit, "_rn").groupBy("user_id", "month").agg(F.max(place).alias("_edge"))
    return by_month.join(edge, ["user_id", "month"]).withColumn("allowed", place <= F.col("_edge")).drop("_edge")


def ledger_page(ledger: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest entries of every user."""
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    return first_rows(ledger, ["user_id"], newest, offset + limit, "position").filter(F.col("position") > offset)


def layer_averages(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("layer").agg(F.bround(F.avg("duration_ms"), 2).alias("avg_ms"), F.count(F.lit(1)).alias("runs"),
                                        F.bround(F.count_if(F.col("status") == "failed") / F.count(F.lit(1)) * 100, 2).alias("failure_pct"))


def values_at(df: DataFrame, keys: list[str], value: str, wanted: DataFrame, buckets: int = 4096, most: int = 1 << 16) -> DataFrame:
    """Exact order statistics: wanted(keys..., label, index) plus the value at that 0-based place of the sorted values.

    Equal values are counted first. The range that holds a wanted place is cut into buckets and narrowed to the one with the place, again and again, all
    places together, until it holds at most `most` distinct values; only those are ordered. A far outlier costs a round, as each divides the
    range by `buckets`.
    """
    spark = df.sparkSession
    counts, counts_at = write_table(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    span = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_d"))
    target, place = write_table(wanted.join(span, keys).withColumn("_base", F.lit(0).cast("bigint")))
    ends = [*keys, "_lo", "_hi"]
    own = [F.col(c) for c in target.columns if c not in ("_lo", "_hi", "_d", "_base")]

    def inside(ranges: DataFrame) -> DataFrame:
        return counts.join(ranges.select(*ends).distinct(), keys).filter(F.col(value).between(F.col("_lo"), F.col("_hi")))

    def reached(ranged: DataFrame, order: str, upto: int) -> Column:
        return F.coalesce(F.sum("_h").over(Window.partitionBy(*ends).orderBy(order).rowsBetween(Window.unboundedPreceding, upto)), F.lit(0))

    while True:
        wide = target.filter(F.col("_d") > most)
        if wide.isEmpty():
            break
        width = F.col("_hi") - F.col("_lo")
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("_lo")) / width * buckets))
        hist = inside(wide).groupBy(*ends, bucket.alias("_b")).agg(F.sum("_n").alias("_h"), F.count(F.lit(1)).alias("_d2"), F.min(value).alias("_lo2"), F.max(value).alias("_hi2"))
        hist = hist.withColumn("_before", reached(hist, "_b", -1))
        local = F.col("index") - F.col("_base")
        narrow = wide.join(hist, ends).filter((local >= F.col("_before")) & (local < F.col("_before") + F.col("_h")))
        narrow = narrow.select(*own, F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), F.col("_d2").alias("_d"), (F.col("_base") + F.col("_before")).alias("_base"))
        now, where = write_table(target.filter(F.col("_d") <= most).unionByName(narrow))
        drop_table(spark, place)
        target, place = now, where
    few = inside(target).withColumnRenamed("_n", "_h")
    ranked = few.withColumn("_end", reached(few, value, 0))
    local = F.col("index") - F.col("_base")
    found = target.join(ranked, ends).filter((local < F.col("_end")) & (local >= F.col("_end") - F.col("_h")))
    out, _ = write_table(found.select(*keys, "label", "index", F.col(value).alias("value")))
    drop_table(spark, counts_at)
    drop_table(spark, place)
    return out


def layer_medians(metrics: DataFrame) -> DataFrame:
    """Median duration of every layer with at least three samples."""
    n = metrics.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_SAMPLES)
    ends = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    wanted = n.select("layer", F.posexplode(ends).alias("label", "index"))
    return values_at(metrics, ["layer"], "duration_ms", wanted).groupBy("layer").agg(F.avg("value").alias("median_ms"))


def remaining_seconds(medians: DataFrame, layer_order: list[str]) -> DataFrame:
    """Estimated seconds left when a run enters each layer; null when no later layer has enough samples, at least 1."""
    spark = medians.sparkSession
    order = spark.createDataFrame([(l, i) for i, l in enumerate(layer_order)], "layer string, place int")
    later = order.withColumnsRenamed({"layer": "current", "place": "here"}).join(F.broadcast(order), F.col("place") >= F.col("here"))
    got = later.join(medians, "layer", "left").groupBy("current").agg(F.sum("median_ms").alias("ms"))
    eta = F.bround(F.greatest(F.lit(1.0), F.col("ms") / 1000.0), 1)
    return got.select(F.col("current").alias("layer"), F.when(F.col("ms").isNotNull(), eta).alias("eta_s"))


def latency_report(logs: DataFrame, keys: list[str], wall_seconds: float) -> DataFrame:
    """Throughput, extremes, mean, p50/p95/p99 (the element at floor(n*p)) and success share."""
    ok = F.col("status") == "success"
    base = logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        F.bround(F.avg("duration_ms"), 2).alias("avg_ms"))
    spots = F.array(*[F.struct(F.lit(l).alias("label"), F.least(F.floor(F.col("total") * p), F.col("total") - 1).alias("index")) for l, p in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99))])
    wanted = base.select(*keys, F.explode(spots).alias("_s")).select(*keys, "_s.label", "_s.index")
    cuts = values_at(logs, keys, "duration_ms", wanted).groupBy(*keys).agg(*[F.max(F.when(F.col("label") == l, F.col("value"))).alias(l) for l in ("p50_ms", "p95_ms", "p99_ms")])
    return base.join(cuts, keys).withColumn("success_pct", F.bround(F.col("succeeded") / F.col("total") * 100.0, 2)).withColumn(
        "throughput", F.bround(F.col("total") / F.lit(wall_seconds), 2))


def trailing_counts(failures: DataFrame, keys: list[str], seconds: int = 60, threshold: int = 5) -> DataFrame:
    """failures(keys..., id, t) plus how many fell in the trailing window, and whether that is a breach.

    A count in a window is the place of its end less the place of its beginning among all rows of the key. Places come from time slices of
    one window length: running counts inside a slice, and the rows of all slices before. So the work does not depend on how many rows a window holds.
    """
    slice_of = F.floor(F.col("_spot") / F.lit(seconds)).alias("_slice")
    at = failures.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("_n"))
    ends = at.select(*keys, "t", F.col("t").cast("double").alias("_spot"), F.lit(1).alias("_end"), "_n")
    begins = at.select(*keys, "t", (F.col("t") - F.lit(seconds)).cast("double").alias("_spot"), F.lit(0).alias("_end"), F.lit(0).cast("bigint").alias("_n"))
    points = ends.unionByName(begins).select("*", slice_of)
    per_slice = points.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_all"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per_slice.select(*keys, "_slice", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_base"))
    # a window's beginning comes before the rows of the same time, which are in the window
    inside = Window.partitionBy(*keys, "_slice").orderBy("_spot", "_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _joined(points.withColumn("_place", F.sum("_n").over(inside)), base, [*keys, "_slice"]).withColumn("_place", F.col("_place") + F.col("_base"))
    upto = lambda end: F.max(F.when(F.col("_end") == end, F.col("_place")))
    counts = placed.groupBy(*keys, "t").agg((upto(1) - upto(0)).alias("recent"))
    return _joined(failures, counts, [*keys, "t"]).withColumn("breach", F.col("recent") >= threshold)


def _joined(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with the other columns of `facts`, which has one row for each of its keys; null is a key like any other."""
    facts = facts.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(facts, same).drop(*[f"_k{i}" for i in range(len(keys))])


def job_points(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("user_id", "job_id").agg(F.coalesce(F.sum(F.when(F.col("points") > 0, F.col("points"))), F.lit(0)).alias("total_awarded"))
