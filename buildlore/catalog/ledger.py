from pyspark.sql import functions as F

from buildlore.catalog.base import query
from buildlore.catalog.sqlviews import NOW_SQL, with_views
from buildlore.functions.text import repository_count_key
from buildlore.operators import corpus as C
from buildlore.operators import ledger as L
from buildlore.plans import views as V

# the expiry window is shortened to 10 days here because the events span one month only
_CUT = f"({NOW_SQL} - INTERVAL 10 DAY)"


def aged(spark, sf):
    """The ledger as seen 170 days later, so that a 180-day expiry falls inside the month the events cover."""
    return V.ledger(spark, sf), F.timestamp_add("DAY", F.lit(170), V.now())


@query("h1_active_balance", "user_id bigint, balance bigint",
       with_views("ledger", f"SELECT user_id, greatest(0, coalesce(sum(points) FILTER (created_at >= {_CUT} OR points < 0), 0)) AS balance FROM ledger GROUP BY user_id"))
def h1(spark, sf):
    return L.balances(*aged(spark, sf))


@query("h2_lifetime_expired", "user_id bigint, lifetime bigint, expired bigint",
       with_views("ledger", f"SELECT user_id, coalesce(sum(points) FILTER (points > 0), 0) AS lifetime, coalesce(sum(points) FILTER (points > 0 AND created_at < {_CUT}), 0) AS expired FROM ledger GROUP BY user_id"))
def h2(spark, sf):
    return L.balances(*aged(spark, sf))


@query("h3_quota_bonus", "user_id bigint, bonus bigint",
       with_views("ledger", f"SELECT user_id, 2 * count(*) FILTER (reason LIKE 'redemption_quota_bump%' AND created_at >= date_trunc('month', {NOW_SQL})) AS bonus FROM ledger GROUP BY user_id"))
def h3(spark, sf):
    return L.quota_bonus(V.ledger(spark, sf), V.now())


@query("h4_monthly_usage", "user_id bigint, event_type string, used bigint",
       with_views("usage", f"SELECT user_id, event_type, count(*) AS used FROM usage WHERE created_at >= date_trunc('month', {NOW_SQL}) GROUP BY ALL"))
def h4(spark, sf):
    return L.monthly_usage(V.usage(spark, sf), V.now())


@query("h5_billing_status", "user_id bigint, tier string, subscription_status string, monthly_usage bigint, monthly_quota bigint, is_quota_exceeded boolean",
       with_views("users subscriptions usage ledger", f"""WITH u AS (SELECT id AS user_id, coalesce(status IN ('active', 'trialing') AND (current_period_end IS NULL OR current_period_end > {NOW_SQL}), false) AS paid, status,
         (SELECT count(*) FROM usage x WHERE x.user_id = users.id AND event_type = 'repo_analysis') AS used,
         20 + (SELECT 2 * count(*) FROM ledger l WHERE l.user_id = users.id AND reason LIKE 'redemption%') AS quota FROM users LEFT JOIN subscriptions s ON s.user_id = users.id)
       SELECT user_id, CASE WHEN paid THEN 'paid' ELSE 'free' END AS tier, coalesce(status, 'inactive') AS subscription_status, used AS monthly_usage, CASE WHEN NOT paid THEN quota END AS monthly_quota, NOT paid AND used >= quota AS is_quota_exceeded FROM u"""))
def h5(spark, sf):
    return L.billing_status(V.users(spark, sf), V.subscriptions(spark, sf), V.usage(spark, sf), V.ledger(spark, sf), V.now(), 20)


@query("h6_badges", "user_id bigint, badge string, earned boolean, progress bigint, target int, pct int",
       with_views("users attempts ledger", """WITH f AS (SELECT u.id AS user_id, (SELECT count(*) FROM attempts a WHERE a.user_id = u.id AND status = 'structurally_verified') AS solves,
         (SELECT count(*) FROM attempts a WHERE a.user_id = u.id AND status = 'structurally_verified' AND hint_level = 0 AND NOT revealed) AS clean,
         (SELECT count(DISTINCT job_id) FROM attempts a WHERE a.user_id = u.id AND status = 'structurally_verified') AS repos,
         coalesce((SELECT sum(points) FROM ledger l WHERE l.user_id = u.id AND points > 0), 0) AS lifetime FROM users u),
       b AS (SELECT user_id, 'first_milestone' AS badge, solves AS x, 1 AS target FROM f UNION ALL SELECT user_id, 'zero_hint_streak_5', clean, 5 FROM f UNION ALL SELECT user_id, 'repo_explorer', repos, 3 FROM f
         UNION ALL SELECT user_id, 'century_club', lifetime, 100 FROM f UNION ALL SELECT user_id, 'architect_master', solves, 10 FROM f)
       SELECT user_id, badge, x >= target AS earned, least(x, target) AS progress, target, CAST(least(100, trunc(CAST(x AS DOUBLE) / target * 100)) AS INT) AS pct FROM b"""))
def h6(spark, sf):
    return L.badges(V.users(spark, sf), V.attempts(spark, sf), V.ledger(spark, sf))


_METRICS = "layer_metrics"


@query("h7_layer_averages", "layer string, avg_ms double, runs bigint, failure_pct double",
       with_views(_METRICS, "SELECT layer, round_even(avg(duration_ms), 2) AS avg_ms, count(*) AS runs, round_even(count(*) FILTER (status = 'failed') / count(*) * 100, 2) AS failure_pct FROM layer_metrics GROUP BY layer"))
def h7(spark, sf):
    return L.layer_averages(V.layer_metrics(spark, sf))


_LAYERS = ["click", "view", "idle", "signup", "purchase", "error", "shutdown"]


@query("h8_remaining_time", "layer string, eta_s double",
       with_views(_METRICS, f"""WITH o AS (SELECT unnest({_LAYERS}) AS layer, unnest(range({len(_LAYERS)})) AS i), m AS (SELECT layer, median(duration_ms) AS m FROM layer_metrics GROUP BY layer HAVING count(*) >= 3)
       SELECT a.layer, CASE WHEN sum(m) IS NOT NULL THEN round_even(greatest(1.0, sum(m) / 1000.0), 1) END AS eta_s FROM o a JOIN o b ON b.i >= a.i LEFT JOIN m ON m.layer = b.layer GROUP BY a.layer"""))
def h8(spark, sf):
    return L.remaining_seconds(L.layer_medians(V.layer_metrics(spark, sf)), _LAYERS)


@query("h9_latency_report", "layer string, total bigint, succeeded bigint, success_pct double, throughput double, min_ms double, avg_ms double, p50_ms double, p95_ms double, p99_ms double, max_ms double",
       with_views(_METRICS, """SELECT layer, count(*) AS total, count(*) FILTER (status = 'success') AS succeeded, round_even(count(*) FILTER (status = 'success') / count(*) * 100.0, 2) AS success_pct, round_even(count(*) / 60.0, 2) AS throughput,
       min(duration_ms) AS min_ms, round_even(avg(duration_ms), 2) AS avg_ms, list_sort(list(duration_ms))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS p50_ms, list_sort(list(duration_ms))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95_ms,
       list_sort(list(duration_ms))[CAST(least(floor(count(*) * 0.99), count(*) - 1) AS INT) + 1] AS p99_ms, max(duration_ms) AS max_ms FROM layer_metrics GROUP BY layer"""))
def h9(spark, sf):
    return L.latency_report(V.layer_metrics(spark, sf), ["layer"], 60.0)


@query("h14_repeat_submissions", "repo_key string, submissions bigint",
       with_views("repos", "SELECT lower(rtrim(trim(github_url), '/')) AS repo_key, count(*) AS submissions FROM repos GROUP BY ALL"))
def h14(spark, sf):
    return V.repos(spark, sf).groupBy(repository_count_key(F.col("github_url")).alias("repo_key")).agg(F.count(F.lit(1)).alias("submissions"))


EVERY_TABLE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("h17_table_counts", "table_name string, row_count bigint",
       " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in EVERY_TABLE))
def h17(spark, sf):
    out = None
    for t in EVERY_TABLE:
        one = V.table(spark, sf, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        out = one if out is None else out.unionAll(one)
    return out


@query("h18_job_points", "user_id bigint, job_id bigint, total_awarded bigint",
       with_views("ledger", "SELECT user_id, job_id, coalesce(sum(points) FILTER (points > 0), 0) AS total_awarded FROM ledger GROUP BY ALL"))
def h18(spark, sf):
    return L.job_points(V.ledger(spark, sf))


@query("j10_users_left_ledger", "user_id bigint, username string, points bigint",
       with_views("users ledger", "SELECT u.id AS user_id, u.username, coalesce(sum(points), 0) AS points FROM users u LEFT JOIN ledger l ON l.user_id = u.id AND l.points > 0 GROUP BY ALL"))
def j10(spark, sf):
    return L.user_points(V.users(spark, sf), V.ledger(spark, sf))


_PTS = "p AS (SELECT u.id AS user_id, coalesce(sum(points), 0) AS points FROM users u LEFT JOIN ledger l ON l.user_id = u.id AND l.points > 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY points DESC, user_id) AS rank FROM p)"


@query("w1_leaderboard", "section string, rank bigint, user_id bigint, points bigint",
       with_views("users ledger", f"WITH {_PTS} SELECT 'page' AS section, rank, user_id, points FROM r WHERE rank > 5 AND rank <= 25 UNION ALL SELECT 'caller', rank, user_id, points FROM r WHERE user_id = 77 UNION ALL SELECT 'total_users', count(*), NULL, NULL FROM r"))
def w1(spark, sf):
    return L.leaderboard(L.user_points(V.users(spark, sf), V.ledger(spark, sf)), caller=77, limit=20, offset=5)


@query("w2_first_solve_awards", "id bigint, user_id bigint, job_id bigint, milestone_tier int, points bigint, multiplier double, reason string",
       with_views("attempts", """WITH s AS (SELECT event_id AS id, user_id, job_id, milestone_tier, ts, hint_level AS h, revealed, k % 12 < 5 OR k * 4 < 150 - 100 AS low, CASE WHEN k % 12 < 5 OR k * 4 < 150 - 100 OR revealed THEN 0 WHEN hint_level = 1 THEN 25 WHEN hint_level >= 2 THEN 12 ELSE 50 END AS worth FROM attempts WHERE status = 'structurally_verified'),
       w AS (SELECT *, coalesce(max(worth > 0) OVER (PARTITION BY user_id, job_id, milestone_tier ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM s)
       SELECT id, user_id, job_id, milestone_tier, CASE WHEN late THEN 0 ELSE worth END AS points, CASE WHEN late OR low OR revealed THEN 0.0 WHEN h = 1 THEN 0.5 WHEN h >= 2 THEN 0.25 ELSE 1.0 END AS multiplier,
        CASE WHEN late THEN 'first_solve_already_awarded' WHEN low THEN 'below_complexity_floor' WHEN revealed THEN 'solution_revealed' WHEN h = 1 THEN 'milestone_solved_hint_1' WHEN h >= 2 THEN 'milestone_solved_hint_2' ELSE 'milestone_solved_no_hints' END AS reason FROM w"""))
def w2(spark, sf):
    a = V.attempts(spark, sf).filter("status = 'structurally_verified'")
    return L.awards(a.select(F.col("event_id").alias("id"), "user_id", "job_id", "milestone_tier", "ts", "hint_level", "revealed",
                             (F.col("k") % 12).alias("files"), (F.col("k") * 4 + 100).alias("loc")))


@query("w3_quota_gate", "id bigint, user_id bigint, allowed boolean",
       with_views("usage", "SELECT id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('month', created_at) ORDER BY created_at, id) <= 5 AS allowed FROM usage WHERE event_type = 'repo_analysis'"))
def w3(spark, sf):
    return L.quota_gate(V.usage(spark, sf).filter("event_type = 'repo_analysis'"), 5)


@query("w4_ledger_page", "user_id bigint, position int, id bigint, points int",
       with_views("ledger", "SELECT user_id, position, id, points FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position FROM ledger) WHERE position > 3 AND position <= 13"))
def w4(spark, sf):
    return L.ledger_page(V.ledger(spark, sf), limit=10, offset=3)


@query("w5_latest_jobs", "user_id bigint, position int, id bigint, status string",
       with_views("repos", "SELECT user_id, position, id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position FROM repos) WHERE position <= 4"))
def w5(spark, sf):
    return C.latest_jobs(V.repos(spark, sf), 4)


FAILURES_SQL = "failures AS (SELECT event_id AS id, epoch_us(ts) / 1e6 / 600.0 AS t FROM events WHERE event_type = 'error')"


def failures(spark, sf):
    return V.table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit("all").alias("key"), (V.seconds_of(F.col("ts")) / F.lit(600.0)).alias("t"))


@query("w6_failure_bursts", "id bigint, recent bigint, breach boolean",
       f"WITH {FAILURES_SQL} SELECT id, count(*) OVER w AS recent, count(*) OVER w >= 25 AS breach FROM failures WINDOW w AS (ORDER BY t RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)")
def w6(spark, sf):
    return L.trailing_counts(failures(spark, sf), ["key"], 60, 25)
