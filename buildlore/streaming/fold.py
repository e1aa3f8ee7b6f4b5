"""Folding a key's rows in order, for state that depends on its own earlier outcomes.

Rows are shuffled by key and sorted, then streamed through a Python step with constant state: a group is never held in
memory. Callers first split keys at points where the state is known to be reset, so a busy key still spreads out. Keys that stay
long are folded by ranges where the operator has a map of a range (`ranges`), and alerts follow pointers (`cooldown`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlore.operators.ledger import EXPIRY_DAYS, REDEMPTION_COST
from buildlore.operators.scale import gap_sessions
from buildlore.session import drop_table, write_table
from buildlore.streaming import cooldown as C
from buildlore.streaming import ranges as R

State = Any
Step = Callable[[State, tuple], tuple[State, tuple]]


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Step, start: State, outputs: str) -> DataFrame:
    """Every row plus the columns `step(state, inputs)` returns for it; `outputs` is their DDL."""
    key_at = [df.columns.index(k) for k in keys]
    input_at = [df.columns.index(c) for c in inputs]
    out_names = [part.split()[0] for part in outputs.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, start
        for batch in batches:
            made = []
            columns = [batch.iloc[:, i].tolist() for i in range(batch.shape[1])]
            key_rows = zip(*[columns[i] for i in key_at])
            for key, row in zip(key_rows, zip(*[columns[i] for i in input_at])):
                if key != current:
                    current, state = key, start
                state, out = step(state, row)
                made.append(out)
            extra = pd.DataFrame(made, columns=out_names, index=batch.index)
            yield pd.concat([batch, extra], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + outputs
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Step, start: State, outputs: str, summary: Callable, exact: bool, whole: Callable | None = None) -> DataFrame:
    """`fold_in_order`, where keys of more than `ranges.ROWS` rows are cut into ranges that many tasks fold; the results are the same.

    The rows are written once: they are counted, divided and put in order from there.
    """
    df, _ = write_table(df)
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > R.ROWS).select(*keys)
    long, place = write_table(long)
    if long.isEmpty():
        drop_table(df.sparkSession, place)
        return fold_in_order(df, keys, order, inputs, step, start, outputs)
    short = fold_in_order(df.join(long, keys, "left_anti").select(*df.columns), keys, order, inputs, step, start, outputs)
    return short.unionByName(R.fold_long_keys(df.join(long, keys, "left_semi").select(*df.columns), keys, order, inputs, step, start, outputs, summary, exact, whole))


# Fixed values of the two limiters and the alert.
CAPACITY, REFILL_PER_MINUTE = 10, 10
WINDOW_REQUESTS, WINDOW_SECONDS = 15, 60
COOLDOWN = 10.0


def bucket_step(capacity: int = CAPACITY, per_minute: float = REFILL_PER_MINUTE, cost: float = 1.0) -> Step:
    rate = per_minute / 60.0

    def step(state, row):
        (t,) = row
        tokens = float(capacity) if state is None else min(float(capacity), state[0] + max(0.0, t - state[1]) * rate)
        allowed = tokens >= cost
        retry = 0 if allowed else max(1, math.ceil((cost - tokens) / rate))
        if allowed:
            tokens -= cost
        remaining = max(0, math.floor(tokens)) if allowed else 0
        reset = max(1, math.ceil((capacity - tokens) / rate))
        return (tokens, t), (allowed, remaining, reset, retry)

    return step


SINGLE, WIDTH = 16, 1 << 12  # refused requests in a row before they are summed together, and how many are at most


def bucket_range(capacity: int = CAPACITY, per_minute: float = REFILL_PER_MINUTE, cost: float = 1.0) -> Callable:
    """`bucket_step` for all rows of a range at once, bit for bit: while requests are refused, what they find is a running sum."""
    rate, full = per_minute / 60.0, float(capacity)

    def run(state, columns):
        times = columns[0].to_numpy(zero_copy_only=False)
        tokens, since = (full, times[0]) if state is None else state
        gains = R.gained(times, since, rate)
        found, singles, at, refused, width = np.empty(len(gains)), gains.tolist(), 0, 0, SINGLE
        while at < len(gains):
            if refused < SINGLE:
                found[at] = tokens = min(full, tokens + singles[at])
                at, refused = at + 1, 0 if tokens >= cost else refused + 1
                tokens -= cost if tokens >= cost else 0.0
                continue
            sums = np.add.accumulate(np.r_[tokens, gains[at : at + width]])[1:]  # adds one by one
            stops = sums >= min(cost, full)
            n = int(stops.argmax()) if stops.any() else len(sums)
            found[at : at + n] = sums[:n]
            tokens, at = float(sums[n - 1]) if n else tokens, at + n
            refused, width = (0, SINGLE) if n < len(sums) else (refused, min(WIDTH, 2 * width))
        allowed = found >= cost
        left = np.where(allowed, found - cost, found)
        remaining = np.where(allowed, np.maximum(0, np.floor(left)), 0)
        reset = np.maximum(1, np.ceil((capacity - left) / rate))
        retry = np.where(allowed, 0, np.maximum(1, np.ceil((cost - found) / rate)))
        return (float(left[-1]), float(times[-1])), [allowed, *(v.astype(np.int32) for v in (remaining, reset, retry))]

    return run


BUCKET_OUTPUTS = "allowed boolean, remaining int, reset_seconds int, retry_after int"


def token_bucket(requests: DataFrame, capacity: int = CAPACITY, per_minute: float = REFILL_PER_MINUTE) -> DataFrame:
    """requests(event_id, key, t): a pause long enough to fill the bucket starts a new, independent run."""
    full = capacity / (per_minute / 60.0) * (1 + 1e-9)
    runs = gap_sessions(requests, ["key"], "t", "event_id", full, "run")
    summary = lambda times: R.Refill.of(times, float(capacity), per_minute / 60.0)
    return fold(runs, ["key", "run"], ["t", "event_id"], ["t"], bucket_step(capacity, per_minute), None, BUCKET_OUTPUTS, summary, False, bucket_range(capacity, per_minute))


def window_step(limit: int = WINDOW_REQUESTS, seconds: float = WINDOW_SECONDS) -> Step:
    def step(state, row):
        (t,) = row
        live = tuple(x for x in state if x > t - seconds)
        allowed = len(live) < limit
        return (live + (t,) if allowed else live), (allowed, len(live) + int(allowed))

    return step


def sliding_window(requests: DataFrame, limit: int = WINDOW_REQUESTS, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Refused calls do not count; a pause of one window empties it."""
    runs = gap_sessions(requests, ["key"], "t", "event_id", float(seconds), "run")
    summary = lambda times: R.Slots.of(times, limit, float(seconds))
    return fold(runs, ["key", "run"], ["t", "event_id"], ["t"], window_step(limit, seconds), (), "allowed boolean, in_window int", summary, True)


def cooldown_step(cooldown: float = COOLDOWN) -> Step:
    def step(state, row):
        (t,) = row
        alert = state is None or t - state >= cooldown
        return (t if alert else state), (alert,)

    return step


def alerts(breaches: DataFrame, cooldown: float = COOLDOWN) -> DataFrame:
    """breaches(id, key, t): the ones that raise an alert, at most one per cooldown."""
    return C.alerts_by_pointers(breaches, cooldown)


def redemption_step(cost: int = REDEMPTION_COST) -> Step:
    def step(state, row):
        kind, amount = row
        balance = max(0, state)
        if kind != "request":
            return state + amount, (None, None)
        allowed = balance >= cost
        return (state - cost if allowed else state), (allowed, balance)

    return step


def redemptions(ledger: DataFrame, requests: DataFrame, days: int = EXPIRY_DAYS, cost: int = REDEMPTION_COST) -> DataFrame:
    """requests(user_id, id, at): allowed when the balance left by earlier events and redemptions covers the cost.

    An award is two events, its grant and its expiry, so the fold's state is one number.
    """
    cols = ["user_id", "id", "at", "turn", "kind", "amount"]
    kind = lambda name, turn: [F.lit(turn).alias("turn"), F.lit(name).alias("kind")]
    rows = ledger.select("user_id", "id", F.col("created_at").alias("at"), *kind("ledger", 0), F.col("points").cast("bigint").alias("amount"))
    expiry = ledger.filter("points > 0").select(
        "user_id", "id", F.timestamp_add("DAY", F.lit(days), F.col("created_at")).alias("at"), *kind("expiry", 2), (-F.col("points")).cast("bigint").alias("amount"))
    asked = requests.select("user_id", "id", "at", *kind("request", 1), F.lit(0).cast("bigint").alias("amount"))
    events = rows.unionByName(expiry).unionByName(asked).select(*cols)
    summary = lambda kinds, amounts: R.Spending.of(kinds, amounts, cost)
    out = fold(events, ["user_id"], ["at", "turn", "id"], ["kind", "amount"], redemption_step(cost), 0, "allowed boolean, balance bigint", summary, True)
    return out.filter("kind = 'request'").select("user_id", "id", "at", "allowed", "balance")
