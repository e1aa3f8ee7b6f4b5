"""Alerts at most once per cooldown, without a fold: pointers from each row to the next that could alert after it, doubled from the first on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from buildlore.operators.scale import gap_sessions
from buildlore.session import drop_table, write_table


def _stored(df: DataFrame) -> tuple[DataFrame, str, int]:
    """One round's state, where it lies, and how many rows still point on."""
    seen = Observation()
    out, place = write_table(df.observe(seen, F.count("next").alias("n")))
    return out, place, int(seen.get["n"] or 0)


def successors(rows: DataFrame, keys: list[str], cooldown: float) -> DataFrame:
    """(keys, id, t, next): for each of `rows` (keys, id, t) the first row, by t and id, at least `cooldown` later; null if there is none.

    Rows without a pause of a cooldown between them: the one looked for is in the slice of a cooldown's length that the earliest possible time falls
    into, or is the first of the slice after it. So no window spans more than a slice.
    """
    # rounding: the least number whose difference from t is a cooldown
    def due(t: pd.Series) -> pd.Series:
        t = t.to_numpy()
        out = t + cooldown
        for _ in range(2):
            lower = np.nextafter(out, -np.inf)
            out = np.where(lower - t >= cooldown, lower, out)
        for _ in range(2):
            out = np.where(out - t >= cooldown, out, np.nextafter(out, np.inf))
        return pd.Series(out)

    slim = rows.select(*keys, "id", "t")
    found = slim.withColumn("spot", F.pandas_udf(due, "double")("t"))
    slice_of = lambda c: F.floor(F.col(c) / F.lit(cooldown)).alias("slice")
    none = F.lit(None).cast(rows.schema["id"].dataType)
    both = slim.select(*keys, slice_of("t"), F.col("t").alias("spot"), F.lit(1).alias("turn"), "id", none.alias("asks"), F.lit(None).cast("double").alias("t"))
    both = both.unionByName(found.select(*keys, slice_of("spot"), "spot", F.lit(0).alias("turn"), none.alias("id"), F.col("id").alias("asks"), "t"))
    # from the last row back, so that a row adds to what is known and no window is read again for each of its rows
    back = [F.col(c).desc() for c in ("spot", "turn", "id")]
    ahead = Window.partitionBy(*keys, "slice").orderBy(*back).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("here", F.last("id", ignorenulls=True).over(ahead)).filter("turn = 0")
    heads = slim.select(*keys, (slice_of("t") - 1).alias("slice"), F.struct("t", "id").alias("head")).groupBy(*keys, "slice").agg(F.min("head").alias("head"))
    out = here.join(heads, [*keys, "slice"], "left")
    return out.select(*keys, F.col("asks").alias("id"), "t", F.coalesce("here", "head.id").alias("next"))


def alerts_by_pointers(breaches: DataFrame, cooldown: float) -> DataFrame:
    """breaches(id, key, t) and `alert`: whether the row is the first of its key or at least a cooldown after the alert before it.

    `id` is unique; rows are in order of t, then id. In each round the rows known to alert mark the ones they point to, and every pointer jumps twice
    as far, so a chain of n alerts takes log n rounds.
    """
    spark = breaches.sparkSession
    runs, runs_at = write_table(gap_sessions(breaches, ["key"], "t", "id", cooldown, "run"))
    first = runs.groupBy("key", "run").agg(F.min(F.struct("t", "id")).alias("first"))
    begun = first.select("key", "run", F.col("first.id").alias("id"), F.lit(True).alias("alert"))
    pointers = successors(runs, ["key", "run"], cooldown).join(begun, ["key", "run", "id"], "left")
    state, place, n = _stored(pointers.select("id", "next", F.coalesce("alert", F.lit(False)).alias("alert")))
    while n:
        reached = state.filter("alert AND next IS NOT NULL").select(F.col("next").alias("id")).distinct().withColumn("reached", F.lit(True))
        further = state.select(F.col("id").alias("next"), F.col("next").alias("after"))
        jumped = state.join(further, "next", "left").join(reached, "id", "left")
        told, where, n = _stored(jumped.select("id", F.col("after").alias("next"), (F.col("alert") | F.coalesce("reached", F.lit(False))).alias("alert")))
        drop_table(spark, place)
        state, place = told, where
    out, _ = write_table(runs.select(*breaches.columns, "run").join(state.select("id", "alert"), "id").select(*breaches.columns, "run", "alert"))
    drop_table(spark, place)
    drop_table(spark, runs_at)
    return out
