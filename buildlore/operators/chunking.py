"""Line windows, symbol spans and their assembly into chunks. Everything about one file stays in its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlore.functions.text import bind, lines, strip

MAX_LINES, OVERLAP = 40, 8


def window_starts(n: Column, size: int = MAX_LINES, overlap: int = OVERLAP) -> Column:
    """0-based starts of overlapping windows over n lines; the first window that reaches the end is the last."""
    step = max(1, size - overlap)
    upto = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.filter(upto, lambda s: (n > 0) & ((s == 0) | (s + (size - step) < n)))


def chunk_id(path: Column, start: Column, end: Column, symbol: Column) -> Column:
    key = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), F.coalesce(symbol, F.lit("")))
    return F.substring(F.sha2(key, 256), 1, 16)


def line_range(path: Column, start: Column, end: Column, symbol: Column) -> Column:
    named = F.coalesce(F.concat(F.lit(" ("), F.when(symbol != "", symbol), F.lit(")")), F.lit(""))
    return F.concat(path, F.lit(":L"), start.cast("string"), F.lit("-L"), end.cast("string"), named)


def _cut(files: DataFrame, windows: Column) -> DataFrame:
    """One row per window struct(start, end, symbol), with just its own text."""
    made = F.transform(windows, lambda w: F.struct(
        w["start"].alias("start_line"), w["end"].alias("end_line"), w["symbol"].alias("symbol"),
        F.array_join(F.slice(F.col("_lines"), w["start"], w["end"] - w["start"] + 1), "\n").alias("content")))
    out = files.select("repo_id", "path", F.explode(made).alias("_c")).select("repo_id", "path", "_c.*")
    return out.withColumn("chunk_id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol")))


def window_chunks(files: DataFrame, size: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Sliding windows over whole files; blank files give none."""
    split = files.filter(strip(F.col("content")) != "").select("repo_id", "path", lines(F.col("content")).alias("_lines"))
    n = F.size("_lines")
    none = F.lit(None).cast("string")
    windows = F.transform(window_starts(n, size, overlap), lambda s: F.struct(
        (s + 1).alias("start"), F.least(s + size, n).alias("end"), none.alias("symbol")))
    return _cut(split, windows)


# Words that open a declaration, and the ones that end the span before it.
DECLARES = r"def|fn|func|class|struct|interface|function|public|private|protected|static|void|[A-Z]\w+"
BOUNDARY = r"def |func |fn |public |class "


def symbol_spans(files: DataFrame) -> DataFrame:
    """files(repo_id, path, content, symbols array) plus `_lines` and `spans` array of struct(start, end, symbol).

    A symbol starts on the first line that declares or calls it and ends before the next line that holds a declaring
    word and another symbol's name.
    """
    split = files.filter(strip(F.col("content")) != "").select("repo_id", "path", F.array_sort(F.array_distinct("symbols")).alias("_syms"), lines(F.col("content")).alias("_lines"))
    short = lambda s: F.substring_index(s, ".", -1)
    n = F.size("_lines")
    at = lambda i: F.element_at(F.col("_lines"), i)
    index = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def starts(sym: Column, i: Column) -> Column:
        name, line = short(sym), at(i)
        # what stands before the last whole-word mention; one linear search where a single pattern would backtrack
        before = F.call_function("regexp_extract", line, F.concat(F.lit(r"(?U)^(.*)\b\Q"), name, F.lit(r"\E\b")), F.lit(1))
        declared = before.rlike(rf"(?U)\b(?:{DECLARES})\s")
        called = F.contains(line, F.concat(F.lit(" "), name, F.lit("("))) | F.contains(line, F.concat(F.lit(" "), name, F.lit(" ")))
        return F.contains(line, name) & (called | declared)

    first = F.transform(F.col("_syms"), lambda s: F.struct(s.alias("symbol"), F.try_element_at(F.filter(index, lambda i: starts(s, i)), F.lit(1)).alias("start")))

    def end(f: Column, breaks: Column) -> Column:
        stops = F.filter(breaks, lambda i: (i > f["start"]) & F.exists(F.col("_syms"), lambda s: (s != f["symbol"]) & F.contains(at(i), short(s))))
        return F.coalesce(F.try_element_at(stops, F.lit(1)) - 1, n)

    # the lines that can end a span are bound once per file: inside the lambda below they would be searched per symbol
    spans = bind(F.filter(index, lambda i: at(i).rlike(BOUNDARY)), lambda breaks: F.transform(
        F.filter(first, lambda f: f["start"].isNotNull()),
        lambda f: F.struct(f["start"].alias("start"), end(f, breaks).alias("end"), f["symbol"].alias("symbol"))))
    return split.withColumn("spans", spans).drop("_syms")


def assemble_chunks(spans: DataFrame, size: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of symbol spans (long ones windowed) and of the lines no span covers (windowed)."""
    n = F.size("_lines")
    seed = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<start:int,end:int,symbol:string>>").alias("gaps"))
    none = F.lit(None).cast("string")

    def gap(start: Column, end: Column) -> Column:
        return F.array(F.struct(start.alias("start"), end.alias("end"), none.alias("symbol")))

    def step(acc: Column, s: Column) -> Column:
        more = F.when(s["start"] > acc["upto"] + 1, F.concat(acc["gaps"], gap(acc["upto"] + 1, s["start"] - 1))).otherwise(acc["gaps"])
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), more.alias("gaps"))

    walked = F.aggregate(F.array_sort("spans"), seed, step)
    df = spans.withColumn("_w", walked)
    tail = F.when(F.col("_w.upto") < n, gap(F.col("_w.upto") + 1, n)).otherwise(F.array().cast("array<struct<start:int,end:int,symbol:string>>"))
    blocks = F.concat(F.col("spans"), F.col("_w.gaps"), tail)

    def windows(b: Column) -> Column:
        length = b["end"] - b["start"] + 1
        return F.transform(window_starts(length, size, overlap), lambda s: F.struct(
            (b["start"] + s).alias("start"), F.least(b["start"] + s + size - 1, b["end"]).alias("end"), b["symbol"].alias("symbol")))

    return _cut(df, F.flatten(F.transform(blocks, windows)))
