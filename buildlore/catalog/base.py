"""Registration of queries: one declared schema shapes the Spark result and the SQL result alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SQL_TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "date": "DATE",
}
PLACES = 6


def columns_of(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in schema.split(",")]


def shape(df: DataFrame, schema: str) -> DataFrame:
    out = []
    for name, kind in columns_of(schema):
        # the tables' timestamps are zoneless, and results stay so
        col = F.col(name).cast("timestamp_ntz" if kind == "timestamp" else kind)
        out.append((F.round(col, PLACES) if kind == "double" else col).alias(name))
    return df.select(*out)


def shape_sql(sql: str, schema: str) -> str:
    out = []
    for name, kind in columns_of(schema):
        col = f'CAST("{name}" AS {_SQL_TYPES[kind]})'
        out.append(f"{f'round({col}, {PLACES})' if kind == 'double' else col} AS \"{name}\"")
    return f"SELECT {', '.join(out)} FROM (\n{sql}\n) AS result"


def query(name: str, schema: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf: shape(build(spark, sf), schema)
        if sql is not None:
            ORACLES[name] = shape_sql(sql, schema)
        return build

    return register
