"""Structured Streaming forms of the keyed operators. They run the same steps and aggregates as their batch twins."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from buildlore.operators.state import STALE_SECONDS
from buildlore.streaming.fold import (
    BUCKET_OUTPUTS, CAPACITY, COOLDOWN, REFILL_PER_MINUTE, WINDOW_REQUESTS, WINDOW_SECONDS, State, Step, bucket_step, cooldown_step, redemption_step, window_step,
)


def _freeze(value: Any) -> Any:
    return tuple(_freeze(v) for v in value) if isinstance(value, list) else value


def fold_stream(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Step, start: State, outputs: str, ttl_ms: int | None = None) -> DataFrame:
    """A stream's rows with what `step` returns for each, state kept per key between batches.

    A batch's rows of one key are put in order first. A key idle for `ttl_ms` is forgotten, which callers choose long
    enough for the state to have returned to its start by then.
    """
    names = [part.split()[0] for part in outputs.split(",")]
    columns = df.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order)
        state = _freeze(json.loads(kept.get[0])) if kept.exists else start
        made = []
        for row in zip(*[rows[c].tolist() for c in inputs]):
            state, out = step(state, row)
            made.append(out)
        kept.update((json.dumps(state),))
        if ttl_ms is not None:
            kept.setTimeoutDuration(ttl_ms)
        yield pd.concat([rows[columns].reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + outputs
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", timeout)


def bucket_ttl_ms(capacity: int = CAPACITY, per_minute: float = REFILL_PER_MINUTE) -> int:
    """Twice the time a bucket needs to fill, two minutes at least."""
    return max(120_000, int(2 * capacity / (per_minute / 60.0) * 1000))


def token_bucket_stream(requests: DataFrame, capacity: int = CAPACITY, per_minute: float = REFILL_PER_MINUTE, ttl_ms: int | None = None) -> DataFrame:
    """requests(event_id, key, t). Long-running jobs pass `bucket_ttl_ms()`; replays of old requests pass no limit."""
    return fold_stream(requests, ["key"], ["t", "event_id"], ["t"], bucket_step(capacity, per_minute), None, BUCKET_OUTPUTS, ttl_ms)


def sliding_window_stream(requests: DataFrame, limit: int = WINDOW_REQUESTS, seconds: float = WINDOW_SECONDS, ttl_ms: int | None = None) -> DataFrame:
    return fold_stream(requests, ["key"], ["t", "event_id"], ["t"], window_step(limit, seconds), (), "allowed boolean, in_window int", ttl_ms)


def alert_stream(breaches: DataFrame, cooldown: float = COOLDOWN) -> DataFrame:
    return fold_stream(breaches, ["key"], ["t", "id"], ["t"], cooldown_step(cooldown), None, "alert boolean")


def redemption_stream(events: DataFrame) -> DataFrame:
    """events(user_id, id, at, turn, kind, amount) as `fold.redemptions` builds them: grants, expiries and requests."""
    return fold_stream(events, ["user_id"], ["at", "turn", "id"], ["kind", "amount"], redemption_step(), 0, "allowed boolean, balance bigint").filter("kind = 'request'")


def distinct_events(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each event_id once; state is dropped when the watermark passes."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def stage_completions(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each stage of each run completes once."""
    return events.filter("completed").withWatermark(ts, delay).dropDuplicatesWithinWatermark(["run_id", "stage"])


def stale_stream(runs: DataFrame, delay: str = "0 seconds", timeout: int = STALE_SECONDS) -> DataFrame:
    """runs(id, status, ts): a failure for every run still processing when event time passes its last heartbeat plus the timeout."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            (last,) = kept.get
            kept.remove()
            yield pd.DataFrame({"id": [key[0]], "status": ["failed"], "last_seen": [pd.Timestamp(last, unit="ms")]})
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        newest = rows.iloc[-1]
        if newest["status"] != "processing":
            if kept.exists:
                kept.remove()
            return
        at = int(newest["ts"].value // 1_000_000)
        kept.update((at,))
        kept.setTimeoutTimestamp(max(at + timeout * 1000, kept.getCurrentWatermarkMs() + 1))

    return runs.withWatermark("ts", delay).groupBy("id").applyInPandasWithState(
        watch, "id bigint, status string, last_seen timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_each_batch(stream: DataFrame, path: str, keys: list[str], version: str, checkpoint: str):
    """Keep a table of latest states up to date from a stream of them."""
    from buildlore.sources.sinks import upsert_snapshots

    return stream.writeStream.foreachBatch(lambda batch, _: upsert_snapshots(batch, path, keys, version, 8)).option("checkpointLocation", checkpoint)
