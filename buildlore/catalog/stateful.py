from pyspark.sql import functions as F

from buildlore.catalog.base import query
from buildlore.catalog.ledger import FAILURES_SQL, failures
from buildlore.catalog.sqlviews import NOW_SQL, REPO_NOW_SQL, with_views
from buildlore.operators import ledger as L
from buildlore.operators import state as S
from buildlore.plans import views as V
from buildlore.streaming import fold

_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS rn FROM requests)"


@query("t1_token_bucket", "event_id bigint, key bigint, allowed boolean, remaining int, reset_seconds int, retry_after int",
       with_views("requests", f"""WITH {_RANKED}, c AS (SELECT CAST(10 AS DOUBLE) / CAST(60 AS DOUBLE) AS rate),
       f(key, rn, event_id, t, x, tokens) AS (SELECT key, rn, event_id, t, CAST(10 AS DOUBLE), CAST(9 AS DOUBLE) FROM r WHERE rn = 1
         UNION ALL SELECT key, rn, event_id, t, x, CASE WHEN x >= 1 THEN x - 1 ELSE x END FROM (SELECT r.key, r.rn, r.event_id, r.t, least(CAST(10 AS DOUBLE), f.tokens + greatest(CAST(0 AS DOUBLE), r.t - f.t) * (SELECT rate FROM c)) AS x FROM f JOIN r ON r.key = f.key AND r.rn = f.rn + 1))
       SELECT event_id, key, x >= 1 AS allowed, CASE WHEN x >= 1 THEN greatest(0, floor(tokens)) ELSE 0 END AS remaining, greatest(1, ceil((CAST(10 AS DOUBLE) - tokens) / (SELECT rate FROM c))) AS reset_seconds,
        CASE WHEN x >= 1 THEN 0 ELSE greatest(1, ceil((CAST(1 AS DOUBLE) - x) / (SELECT rate FROM c))) END AS retry_after FROM f""", recursive=True))
def t1(spark, sf):
    return fold.token_bucket(V.requests(spark, sf))


@query("t2_sliding_window", "event_id bigint, key bigint, allowed boolean, in_window int",
       with_views("requests", f"""WITH {_RANKED}, f(key, rn, event_id, ok, live) AS (SELECT key, rn, event_id, true, [t] FROM r WHERE rn = 1
         UNION ALL SELECT key, rn, event_id, len(l) < 15, CASE WHEN len(l) < 15 THEN list_append(l, t) ELSE l END FROM (SELECT r.key, r.rn, r.event_id, r.t, list_filter(f.live, lambda v: v > r.t - 60) AS l FROM f JOIN r ON r.key = f.key AND r.rn = f.rn + 1))
       SELECT event_id, key, ok AS allowed, len(live) AS in_window FROM f""", recursive=True))
def t2(spark, sf):
    return fold.sliding_window(V.requests(spark, sf))


@query("t3_duplicate_events", "event_id bigint, user_id bigint, event_type string, delivery int",
       """WITH d AS (SELECT event_id, user_id, event_type, ts, 1 AS delivery FROM events UNION ALL SELECT event_id, user_id, event_type, ts + INTERVAL 1 MINUTE, 2 FROM events WHERE event_id % 5 = 0)
       SELECT event_id, user_id, event_type, delivery FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, delivery) AS rn FROM d) WHERE rn = 1""")
def t3(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", F.lit(1).alias("delivery"))
    again = e.filter("event_id % 5 = 0").withColumn("ts", F.timestamp_add("MINUTE", F.lit(1), F.col("ts"))).withColumn("delivery", F.lit(2))
    return S.first_of(e.unionByName(again), ["event_id"], ["ts", "delivery"])


@query("t4_burst_alerts", "id bigint, alert boolean",
       f"""WITH RECURSIVE {FAILURES_SQL}, w AS (SELECT id, t, count(*) OVER (ORDER BY t RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS recent FROM failures),
       b AS (SELECT id, t, row_number() OVER (ORDER BY t, id) AS rn FROM w WHERE recent >= 25),
       f(rn, id, alert, last) AS (SELECT rn, id, true, t FROM b WHERE rn = 1 UNION ALL SELECT b.rn, b.id, b.t - f.last >= 10, CASE WHEN b.t - f.last >= 10 THEN b.t ELSE f.last END FROM f JOIN b ON b.rn = f.rn + 1)
       SELECT id, alert FROM f""")
def t4(spark, sf):
    breaches = L.trailing_counts(failures(spark, sf), ["key"], 60, 25).filter("breach").select("id", "key", "t")
    return fold.alerts(breaches)


_ATTEMPT_SQL = "a AS (SELECT *, event_id % 7 = 0 AS scratch, 'code' || event_id AS code FROM attempts)"


def attempt_events(spark, sf):
    return V.attempts(spark, sf).withColumn("scratch", F.col("event_id") % 7 == 0).withColumn("code", F.concat(F.lit("code"), V.text_of(F.col("event_id"))))


@query("t5_attempt_states", "user_id bigint, job_id bigint, milestone_tier int, hint_level int, revealed boolean, status string, submitted_code string, last_run_code string, updated_at timestamp",
       with_views("attempts", f"""WITH {_ATTEMPT_SQL} SELECT user_id, job_id, milestone_tier, coalesce(max(hint_level) FILTER (NOT scratch), 0) AS hint_level, coalesce(bool_or(revealed) FILTER (NOT scratch), false) AS revealed,
       coalesce(arg_max(status, (ts, event_id)) FILTER (NOT scratch), 'not_started') AS status, coalesce(arg_max(code, (ts, event_id)) FILTER (NOT scratch), '') AS submitted_code, arg_max(code, (ts, event_id)) FILTER (scratch) AS last_run_code, max(ts) AS updated_at FROM a GROUP BY ALL"""))
def t5(spark, sf):
    return S.attempt_states(attempt_events(spark, sf))


@query("t6_latest_status", "user_id bigint, status string, failed_stage string, seconds double",
       """WITH e AS (SELECT user_id, ts, event_id, event_type AS status, CASE WHEN event_type = 'error' THEN 'stage' || (event_id % 5) END AS failed_stage, CASE WHEN event_id % 3 = 0 THEN value END AS seconds FROM events)
       SELECT user_id, arg_max(status, (ts, event_id)) AS status, arg_max(failed_stage, (ts, event_id)) FILTER (failed_stage IS NOT NULL) AS failed_stage, arg_max(seconds, (ts, event_id)) FILTER (seconds IS NOT NULL) AS seconds FROM e GROUP BY user_id""")
def t6(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("stage"), V.text_of(F.col("event_id") % 5))).alias("failed_stage"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("seconds"))
    return S.latest_values(e, ["user_id"], ["ts", "event_id"], ["status", "failed_stage", "seconds"])


# redemption requests: one per `view` event; 5 days of validity so that awards expire inside the month
@query("t7_redemptions", "user_id bigint, id bigint, allowed boolean, balance bigint",
       with_views("ledger", """WITH e AS (SELECT user_id, id, created_at AS at_ts, 0 AS turn, points AS amount FROM ledger UNION ALL SELECT user_id, id, created_at + INTERVAL 5 DAY, 2, -points FROM ledger WHERE points > 0 UNION ALL SELECT user_id, event_id, ts, 1, 0 FROM events WHERE event_type = 'view'),
       r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ts, turn, id) AS rn FROM e),
       f(user_id, rn, id, turn, before, state) AS (SELECT user_id, rn, id, turn, 0, CASE WHEN turn = 1 THEN 0 ELSE amount END FROM r WHERE rn = 1
         UNION ALL SELECT r.user_id, r.rn, r.id, r.turn, f.state, CASE WHEN r.turn <> 1 THEN f.state + r.amount WHEN f.state >= 100 THEN f.state - 100 ELSE f.state END FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
       SELECT user_id, id, before >= 100 AS allowed, greatest(0, before) AS balance FROM f WHERE turn = 1""", recursive=True))
def t7(spark, sf):
    asked = V.table(spark, sf, "events").filter("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return fold.redemptions(V.ledger(spark, sf), asked, days=5)


@query("t8_stale_runs", "id bigint, status string, error_message string",
       with_views("repos", f"""WITH a AS (SELECT *, CAST(epoch({REPO_NOW_SQL}) - epoch(created_at) AS BIGINT) AS age, expires_at > {REPO_NOW_SQL} AND row_number() OVER (PARTITION BY github_url, commit_hash, expires_at > {REPO_NOW_SQL} ORDER BY created_at DESC, id) = 1 AS newest FROM repos)
       SELECT id, CASE WHEN newest AND status = 'processing' AND age >= 900 THEN 'failed' ELSE status END AS status,
       CASE WHEN newest AND status = 'processing' AND age >= 900 THEN 'Processing lock expired after ' || age || 's (timeout: 900s). Dead worker detected; lock reclaimed.' END AS error_message FROM a"""))
def t8(spark, sf):
    return S.stale_runs(V.repos(spark, sf), V.repo_now())


@query("t9_retention_purge", "id bigint, keep_longer boolean, expires_at timestamp",
       with_views("repos", f"SELECT id, keep_longer, expires_at FROM repos WHERE NOT (expires_at <= {REPO_NOW_SQL} AND NOT keep_longer)"))
def t9(spark, sf):
    return S.retained(V.repos(spark, sf), V.repo_now())


@query("j18_cascade_purge", "line_key bigint, line_number int",
       with_views("repos", f"SELECT l_orderkey AS line_key, l_linenumber AS line_number FROM lineitem WHERE l_orderkey IN (SELECT id FROM repos WHERE expires_at > {REPO_NOW_SQL} OR keep_longer)"))
def j18(spark, sf):
    kept = S.retained(V.repos(spark, sf), V.repo_now()).select(F.col("id").alias("line_key"))
    lines = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("line_key"), F.col("l_linenumber").alias("line_number"))
    return S.surviving_children(lines, kept, "line_key")


@query("t10_backup_retention", "id bigint, name string",
       with_views("repos", f"""SELECT id, name FROM (SELECT id, 'backup_' || id || ['.gz', '.sha256', '.txt'][id % 3 + 1] AS name, {REPO_NOW_SQL} - to_seconds(id * 7919 % 8640000) AS at_ts FROM repos)
       WHERE name NOT LIKE '%.txt' AND at_ts < {REPO_NOW_SQL} - INTERVAL 14 DAY AND NOT (dayofweek(at_ts) = 0 AND floor(epoch({REPO_NOW_SQL} - at_ts) / 86400) <= 30)"""))
def t10(spark, sf):
    k = F.col("id")
    listing = V.repos(spark, sf).select("id", F.concat(F.lit("backup_"), V.text_of(k), V.pick([".gz", ".sha256", ".txt"], k % 3)).alias("name"),
                                        F.timestamp_add("SECOND", -(k * 7919 % 8640000).cast("int"), V.repo_now()).alias("modified_at"))
    return S.prunable_backups(listing, V.repo_now(), 14)


_PROGRESS = "p AS (SELECT user_id AS run_id, event_type AS stage, ts, event_id, value AS pct, event_id % 3 = 0 AS completed FROM events)"


def progress(spark, sf):
    return V.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), "ts", "event_id", F.col("value").alias("pct"), (F.col("event_id") % 3 == 0).alias("completed"))


@query("t11_stage_progress", "run_id bigint, stage string, event_id bigint, pct double",
       f"""WITH {_PROGRESS}, d AS (SELECT run_id, stage, arg_min(event_id, (ts, event_id)) AS event_id FROM p WHERE completed GROUP BY ALL), l AS (SELECT run_id, arg_max(pct, (ts, event_id)) AS pct FROM p GROUP BY run_id)
       SELECT run_id, stage, event_id, pct FROM d JOIN l USING (run_id)""")
def t11(spark, sf):
    done, latest = S.stage_progress(progress(spark, sf))
    return done.drop("ts").join(latest.select("run_id", "pct"), "run_id")


@query("t12_hint_gate", "id bigint, user_id bigint, job_id bigint, milestone_tier int, level int, locked boolean",
       with_views("attempts", """WITH q AS (SELECT event_id AS id, user_id, job_id % 4 AS job_id, milestone_tier, ts, CASE WHEN k % 8 = 0 THEN 'fill' ELSE 'write' END AS mode FROM attempts WHERE event_type IN ('view', 'click', 'signup')),
       s AS (SELECT user_id, job_id % 4 AS job_id, milestone_tier, min(ts) AS coded FROM attempts WHERE event_type = 'purchase' GROUP BY ALL),
       n AS (SELECT q.*, row_number() OVER (PARTITION BY q.user_id, q.job_id, q.milestone_tier ORDER BY ts, id) = 1 AS first, mode = 'fill' OR coalesce(coded < ts, false) AS open FROM q LEFT JOIN s USING (user_id, job_id, milestone_tier))
       SELECT id, user_id, job_id, milestone_tier, CASE WHEN first THEN 1 WHEN open THEN 2 END AS level, NOT first AND NOT open AS locked FROM n"""))
def t12(spark, sf):
    a = V.attempts(spark, sf).withColumn("job_id", F.col("job_id") % 4)
    asked = a.filter(F.col("event_type").isin("view", "click", "signup")).select("user_id", "job_id", "milestone_tier", F.col("event_id").alias("id"), "ts", F.when(F.col("k") % 8 == 0, "fill").otherwise("write").alias("mode"))
    return S.hint_gate(asked, a.filter("event_type = 'purchase'"))


__all__ = ["NOW_SQL"]
