import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from buildlore.operators import ledger as L
from buildlore.operators import state as S
from buildlore.streaming import cooldown
from buildlore.streaming import fold, streams

NOW = dt.datetime(2024, 7, 1)


def plain_fold(rows, step, start):
    out, state = {}, {}
    for event_id, key, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        state[key], out[event_id] = step(state.get(key, start), (t,))
    return out


def traffic(seed=1, n=600):
    """Three keys: one idle enough to refill, one busy, one in bursts."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        rows.append((i, i % 3, rng.uniform(0, [9000.0, 300.0, 20.0][i % 3]) + (400.0 * (i // 60) if i % 3 == 2 else 0)))
    return rows


REQUESTS = "event_id int, key int, t double"


def test_full_bucket_of_three(spark):
    df = spark.createDataFrame([(i, 1, 100.0 + i * 0.01) for i in range(4)], REQUESTS)
    rows = fold.token_bucket(df, capacity=3).orderBy("event_id").collect()
    assert [r["allowed"] for r in rows] == [True, True, True, False]
    assert [r["remaining"] for r in rows] == [2, 1, 0, 0] and rows[3]["retry_after"] >= 1


def test_splitting_at_pauses_changes_nothing(spark):
    rows = traffic()
    df = spark.createDataFrame(rows, REQUESTS)
    got = {r["event_id"]: (r["allowed"], r["remaining"], r["reset_seconds"], r["retry_after"]) for r in fold.token_bucket(df).collect()}
    assert got == plain_fold(rows, fold.bucket_step(), None)
    got = {r["event_id"]: (r["allowed"], r["in_window"]) for r in fold.sliding_window(df).collect()}
    assert got == plain_fold(rows, fold.window_step(), ())


def test_alert_cooldown(spark):
    rows = traffic(2, 300)
    got = {r["id"]: (r["alert"],) for r in fold.alerts(spark.createDataFrame(rows, "id int, key int, t double")).collect()}
    assert got == plain_fold(rows, fold.cooldown_step(), None)


def test_trailing_counts(spark):
    rows = traffic(3, 300)
    df = L.trailing_counts(spark.createDataFrame(rows, "id int, key int, t double"), ["key"], 60, 5)
    got = {r["id"]: r["recent"] for r in df.collect()}
    assert got == {i: sum(k2 == k and t - 60 <= t2 <= t for _, k2, t2 in rows) for i, k, t in rows}


def micro_batches(spark, tmp_path, rows, schema, order, batches=4):
    """The rows in order as a stream of several files."""
    place = str(tmp_path / "in")
    rows = sorted(rows, key=order)
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = rows[i * size:(i + 1) * size]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{place}/b{i}")
            for name in os.listdir(f"{place}/b{i}"):
                os.utime(f"{place}/b{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(place)


def drain(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return stream.sparkSession.table(name)


@pytest.mark.parametrize("kind", ["bucket", "window"])
def test_streams_agree_with_batch(spark, tmp_path, kind):
    rows = traffic(4, 240)
    batch, stream = {"bucket": (fold.token_bucket, streams.token_bucket_stream), "window": (fold.sliding_window, streams.sliding_window_stream)}[kind]
    got = drain(stream(micro_batches(spark, tmp_path, rows, REQUESTS, lambda r: (r[2], r[0]))), tmp_path, f"out_{kind}")
    want = batch(spark.createDataFrame(rows, REQUESTS)).select(*got.columns)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_duplicates_and_stages_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 30, i % 3, f"s{i % 4}", t0 + dt.timedelta(seconds=i), i % 2 == 0) for i in range(60)]
    schema = "event_id int, run_id int, stage string, ts timestamp, completed boolean"
    src = micro_batches(spark, tmp_path, rows, schema, lambda r: r[3])
    assert drain(streams.distinct_events(src), tmp_path, "out_dedupe").count() == 30
    (tmp_path / "two").mkdir()
    got = drain(streams.stage_completions(src), tmp_path / "two", "out_stages")
    batch, _ = S.stage_progress(spark.createDataFrame([(*r[1:4], r[4], r[0], 1.0) for r in rows], "run_id int, stage string, ts timestamp, completed boolean, event_id int, pct double"))
    assert {(r["run_id"], r["stage"]) for r in got.collect()} == {(r["run_id"], r["stage"]) for r in batch.collect()}


def test_stale_runs_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "processing", t0), (2, "processing", t0), (2, "complete", t0 + dt.timedelta(seconds=60)), (1, "processing", t0 + dt.timedelta(seconds=300)),
            (3, "processing", t0 + dt.timedelta(seconds=3000)), (4, "complete", t0 + dt.timedelta(seconds=3600))]
    src = micro_batches(spark, tmp_path, rows, "id bigint, status string, ts timestamp", lambda r: r[2], 6)
    got = drain(streams.stale_stream(src), tmp_path, "out_stale").collect()
    assert [(r["id"], r["status"]) for r in got] == [(1, "failed")]


def test_attempt_states_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, 1, 0, t0 + dt.timedelta(seconds=i), i % 5 == 4, f"c{i}", "attempting", i % 3, i == 7) for i in range(12)]
    schema = "event_id int, user_id int, job_id int, milestone_tier int, ts timestamp, scratch boolean, code string, status string, hint_level int, revealed boolean"
    want = {tuple(r) for r in S.attempt_states(spark.createDataFrame(rows, schema)).collect()}
    got = drain(S.attempt_states(micro_batches(spark, tmp_path, rows, schema, lambda r: r[0])), tmp_path, "out_attempts", "complete")
    assert {tuple(r) for r in got.collect()} == want
    assert {(r[0], r[3], r[4], r[6], r[7]) for r in want} == {(0, 2, False, "c10", "c4"), (1, 2, True, "c11", "c9")}


def test_redemption_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda d: t0 + dt.timedelta(days=d)
    ledger = spark.createDataFrame([(1, 1, at(0), 150), (2, 1, at(2), 60), (3, 2, at(0), 100), (4, 2, at(1), -20)], "id int, user_id int, created_at timestamp, points int")
    asked = spark.createDataFrame([(10, 1, at(1)), (11, 1, at(1.5)), (12, 1, at(3)), (13, 2, at(0.5)), (14, 2, at(2)), (15, 1, at(400))], "id int, user_id int, at timestamp")
    got = {r["id"]: (r["allowed"], r["balance"]) for r in fold.redemptions(ledger, asked).collect()}
    assert got == {10: (True, 150), 11: (False, 50), 12: (True, 110), 13: (True, 100), 14: (False, 0), 15: (False, 0)}


def test_solve_states(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, 1, 0, t, 9, 500, 0, False), (2, 2, 1, 0, t, 9, 500, 1, False), (3, 3, 1, 0, t, 9, 500, 2, False), (4, 4, 1, 0, t, 9, 500, 0, True),
            (5, 5, 1, 0, t, 4, 500, 0, False), (6, 5, 1, 0, t + dt.timedelta(1), 9, 500, 0, False), (7, 5, 1, 0, t + dt.timedelta(2), 9, 500, 0, False)]
    df = spark.createDataFrame(rows, "id int, user_id int, job_id int, milestone_tier int, ts timestamp, files int, loc int, hint_level int, revealed boolean")
    got = {r["id"]: (r["points"], r["reason"]) for r in L.awards(df).collect()}
    assert got == {1: (50, "milestone_solved_no_hints"), 2: (25, "milestone_solved_hint_1"), 3: (12, "milestone_solved_hint_2"), 4: (0, "solution_revealed"),
                   5: (0, "below_complexity_floor"), 6: (50, "milestone_solved_no_hints"), 7: (0, "first_solve_already_awarded")}


def test_expired_points_stay_in_lifetime(spark):
    df = spark.createDataFrame([(1, NOW - dt.timedelta(days=200), 100), (1, NOW - dt.timedelta(days=300), -30), (2, NOW - dt.timedelta(days=1), 70)], "user_id int, created_at timestamp_ntz, points int")
    got = {r["user_id"]: tuple(r)[1:] for r in L.balances(df, F.lit(NOW).cast("timestamp_ntz")).collect()}
    assert got == {1: (0, 100, 100), 2: (70, 70, 0)}


def test_caller_rank(spark):
    points = spark.createDataFrame([(1, 3000), (2, 5000), (3, 1000), (4, 3000)], "user_id bigint, points bigint")
    page = {(r["section"], r["user_id"]): r["rank"] for r in L.leaderboard(points, caller=4, limit=2).collect()}
    assert page == {("page", 2): 1, ("page", 1): 2, ("caller", 4): 3, ("total_users", None): 4}
    absent = [r for r in L.leaderboard(points, caller=99).collect() if r["section"] == "caller"]
    assert (absent[0]["rank"], absent[0]["points"]) == (1, 0)


def test_order_statistics(spark):
    rng = random.Random(5)
    rows = [("a", float(rng.randrange(50))) for _ in range(400)] + [("b", 7.0)] * 9 + [("c", rng.lognormvariate(0, 4)) for _ in range(301)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = spark.createDataFrame([(k, f"i{i}", i) for k, n in (("a", 400), ("b", 9), ("c", 301)) for i in (0, n // 2, n - 1)], "k string, label string, index bigint")
    got = {(r["k"], r["index"]): r["value"] for r in L.values_at(df, ["k"], "v", wanted, buckets=16).collect()}
    by_key = {k: sorted(v for k2, v in rows if k2 == k) for k in "abc"}
    assert got == {(k, i): by_key[k][i] for (k, i) in got} and len(got) == 9


def test_order_statistics_with_far_outliers(spark, monkeypatch):
    """A range with an outlier is narrowed until few values are left to order."""
    rng = random.Random(6)
    rows = [("a", rng.uniform(0, 1)) for _ in range(900)] + [("a", 1e12), ("a", -1e12), ("a", 5e11)] + [("b", float(i % 7)) for i in range(50)] + [("c", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    by_key = {k: sorted(v for k2, v in rows if k2 == k) for k in "abc"}
    wanted = spark.createDataFrame([(k, f"i{i}", i) for k, v in by_key.items() for i in {0, 1, len(v) // 3, len(v) // 2, len(v) - 1} if i < len(v)], "k string, label string, index bigint")
    rounds = []
    table = L.write_table
    monkeypatch.setattr(L, "write_table", lambda d: rounds.append(1) or table(d))
    got = {(r["k"], r["index"]): r["value"] for r in L.values_at(df, ["k"], "v", wanted, buckets=64, most=20).collect()}
    assert got == {(k, i): by_key[k][i] for k, i in got} and len(got) == wanted.count()
    assert 4 < len(rounds) < 20
    assert L.values_at(df.filter("false"), ["k"], "v", wanted).collect() == []


def test_windows_are_not_read_again_for_each_row(spark):
    """Dense times: no frame slides over the rows of a window or looks ahead over all that follow; counts and pointers as by hand."""
    rows = [(i, "a" if i % 3 else None, float(i // 4) / 8) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, key string, t double")
    counted = L.trailing_counts(df, ["key"], 5, 30)
    got = {r["id"]: (r["recent"], r["breach"]) for r in counted.collect()}
    want = {i: sum(1 for _, k2, t2 in rows if k2 == k and t - 5 <= t2 <= t) for i, k, t in rows}
    assert got == {i: (n, n >= 30) for i, n in want.items()}
    keyed = df.select("id", F.lit("all").alias("key"), "t")
    pointers = cooldown.successors(keyed, ["key"], 2.0)
    later = lambda i, t: min(((t2, j) for j, _, t2 in rows if t2 - t >= 2.0), default=(0, None))[1]
    assert {r["id"]: r["next"] for r in pointers.collect()} == {i: later(i, t) for i, _, t in rows}
    for plan in (counted, pointers):
        told = plan._jdf.queryExecution().executedPlan().toString()
        assert "RangeFrame" not in told and "unboundedfollowing" not in told
