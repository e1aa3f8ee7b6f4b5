"""Views that turn the given tables into repositories, import edges, histories, ledgers and limiter feeds.

Each view is a lazy DataFrame over whole tables; `catalog/sqlviews.py` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.functions.text import LINE_BREAK, WORD_BREAK
from buildlore.operators.scale import running_index

NOW = "2024-01-25 00:00:00"
DIRECTORIES = ["src/", "tests/", "docs/", "api/", "ui/", "db/", "examples/", "pkg/", "zzz/", "build/", "src/node_modules/"]
SUFFIXES = [".py", ".go", ".md", ".sql", ".tsx", ".rs", ".xyz", ".toml"]
CODE_SUFFIXES = [".py", ".sh", ".c", ".tla", ".java", ".ts", ".go", ".rs"]
CODE_DIRECTORIES = ["pkg", "lib", "src/core"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970 of a zoneless timestamp, fractions kept."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / F.lit(1e6)


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def text_of(c: Column) -> Column:
    return c.cast("string")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs(repo_id, doc_id, ...) plus n, the place of a file in its repository."""
    # ids alone are numbered, so that no window holds a text
    numbers = running_index(docs.select("repo_id", "doc_id"), ["repo_id"], "doc_id", "n").select("doc_id", (F.col("n") - 1).alias("n"))
    return docs.join(numbers, "doc_id")


def _path() -> Column:
    n = F.col("n")
    return F.concat(pick(DIRECTORIES, n % 11), F.lit("f"), text_of(n), pick(SUFFIXES, F.col("doc_id") % 8))


def files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumnRenamed("source", "repo_id")
    return _numbered(docs).select(
        "repo_id", "n", "doc_id", _path().alias("path"), F.col("n_chars").alias("size_bytes"), F.col("text").alias("content"), "lang"
    )


def _targets(n: Column) -> Column:
    linked = n % 7 != 0
    options = [
        (linked & (n > 0), F.floor(n / 2)),
        (linked & (n >= 3) & (n % 3 == 0), n - 3),
        (n % 10 == 5, n + 1),
        (n % 10 == 6, n - 1),
    ]
    made = F.array(*[F.when(cond, t.cast("bigint")) for cond, t in options])
    return F.array_distinct(F.filter(made, lambda t: t.isNotNull() & (t != n)))


def numbered_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with the numbers of both ends; a file's targets are distinct before they are exploded."""
    fs = files(spark, sf).select("repo_id", "n", "path")
    made = fs.select("repo_id", "n", F.col("path").alias("source"), F.explode(_targets(F.col("n"))).alias("t"))
    ends = fs.select("repo_id", F.col("n").alias("t"), F.col("path").alias("target"))
    return made.join(ends, ["repo_id", "t"]).select("repo_id", "n", "t", "source", "target")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return numbered_edges(spark, sf).select("repo_id", "source", "target")


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose target is spelled as an import would: whole, without extension, file name only, directory only."""
    t, n = F.col("target"), F.col("n")
    raw = (
        F.when(n % 4 == 0, t)
        .when(n % 4 == 1, F.regexp_replace(t, r"\.[^./]*$", ""))
        .when(n % 4 == 2, F.regexp_replace(t, r"^.*/", ""))
        .otherwise(F.regexp_replace(t, r"/[^/]*$", ""))
    )
    return numbered_edges(spark, sf).select("repo_id", "source", raw.alias("target")).distinct()


def _symbols(text: str) -> Column:
    # `sort_array`: `array_sort` compares by a lambda
    return F.sort_array(F.array_distinct(F.filter(F.split(text, WORD_BREAK), lambda w: F.length(w) >= 3)))


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct word of three letters or more as a symbol of its file, with its place among them in name order."""
    return files(spark, sf).select("repo_id", "path", F.posexplode(_symbols("content")).alias("pos", "symbol"))


def symbol_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(repo_id, path, words): the symbols of every file in name order as one text, a blank between two.

    They are told before files are numbered, so no text is joined, and move as a text, which is a third of a list's bytes.
    """
    docs = table(spark, sf, "documents").select(F.col("source").alias("repo_id"), "doc_id", F.array_join(_symbols("text"), " ").alias("words"))
    return _numbered(docs).select("repo_id", _path().alias("path"), "words")


def symbol_lists(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, symbols): the symbols of every file as one list in name order, before files are numbered."""
    return table(spark, sf, "documents").select("doc_id", _symbols("text").alias("symbols"))


def _code_path(n: Column) -> Column:
    return F.concat(pick(CODE_DIRECTORIES, n % 3), F.lit("/m"), text_of(n), pick(CODE_SUFFIXES, n % 8))


def _code_text(n: Column) -> Column:
    k = text_of((F.floor(n / 16) * 8 + n % 8).cast("bigint"))
    s = text_of(n)

    def rows(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    broken = F.when(n % 56 == 48, F.lit("def broken(:\n")).otherwise(F.lit(""))
    return pick_column(
        n % 8,
        [
            rows("import os\nimport m", k, "\nfrom pkg.m", k, " import value, other\nfrom lib.m", k, " import *\n",
                 "try:\n    import json\nexcept ImportError:\n    json = None\nx = __import__(\"m", k, "\")\n",
                 "class C", s, ":\n    def run(self):\n        return 1\ndef main():\n    pass\n", broken),
            rows("#!/bin/bash\n# source ./ignored.sh\nsource ./m", k, ".sh\n. ../pkg/m", k, ".sh\nsource \"$DIR/env.sh\"\n",
                 "bash ./m", k, ".sh --flag\n./run.sh now\necho done\n"),
            rows("#include <stdio.h>\n#include \"m", k, ".c\"\n  #  include \"vector\"\n#include \"sub/x.h\"\n"),
            rows("---- MODULE m", s, " ----\nEXTENDS Naturals, \\* base\n  m", k, ",\n  Sequences\nVARIABLES x\n====\n"),
            rows("import java.util.List;\nimport pkg.m", k, ";\nimport lib.*;\nclass A { Object o = Class.forName(\"src.core.m",
                 k, "\"); }\n"),
            rows("import a from './m", k, "'\n"),
            rows("import \"example.com/app/lib\"\n"),
            rows("use crate::m", k, ";\n"),
        ],
    )


def pick_column(index: Column, values: list[Column]) -> Column:
    out = F.when(index == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(index == i, v)
    return out


def code(spark: SparkSession, sf: str) -> DataFrame:
    """Source files in eight languages that import one another; the document's own text follows as comment lines."""
    n = F.col("n")
    mark = pick(["# ", "# ", "// ", "\\* ", "// ", "// ", "// ", "// "], n % 8)
    body = F.concat(mark, F.regexp_replace("content", F.lit(LINE_BREAK), F.concat(F.lit("\n"), F.replace(mark, F.lit("\\"), F.lit("\\\\")))))
    return files(spark, sf).select(
        "repo_id", "n", _code_path(n).alias("path"), F.concat(_code_text(n), body, F.lit("\n")).alias("content")
    )


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    n, s = F.col("n"), text_of(F.col("n"))
    go = F.concat(F.lit("// generated\nmodule example.com/app"), s, F.lit(" \ngo 1.22\n"))
    cargo = F.concat(F.lit("[workspace]\nname = \"outer\"\n[package]\nname = \"crate"), s, F.lit("\"\n[lib]\nname = \"x\"\n"))
    is_go = n % 25 == 6
    return (
        files(spark, sf)
        .filter(is_go | (n % 25 == 7))
        .select(
            "repo_id",
            F.concat(F.repeat(F.lit("d/"), (n % 4).cast("int")), F.lit("x"), s,
                     F.when(is_go, F.lit("/go.mod")).otherwise(F.lit("/Cargo.toml"))).alias("path"),
            F.when(is_go, go).otherwise(cargo).alias("content"),
        )
    )


def changes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("commit_no"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("f"), text_of(F.col("l_partkey"))).alias("path"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("f"), text_of(F.col("l_partkey") % 500 + 1))).alias("old_path"),
    )


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    return table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "error")).select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"),
        F.when(bought, F.floor("value")).otherwise(-F.floor(F.col("value") / 4)).cast("int").alias("points"),
        F.when(bought, F.lit("milestone_solved_no_hints")).otherwise(F.lit("redemption_quota_bump_2")).alias("reason"),
        (F.col("event_id") % 40).alias("job_id"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        "event_id", "user_id", (F.col("event_id") % 40).alias("job_id"),
        (F.col("event_id") % 6).cast("int").alias("milestone_tier"), "ts",
        (k % 3).alias("hint_level"), (k % 10 == 0).alias("revealed"),
        F.when(F.col("event_type").isin("purchase", "signup"), "structurally_verified").otherwise("attempting").alias("status"),
        "event_type", k.alias("k"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 15).alias("key"), (seconds_of(F.col("ts")) / F.lit(600.0)).alias("t")
    )


def layer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("layer"), F.col("value").alias("duration_ms"),
        F.when(F.col("event_id") % 17 == 0, "failed").otherwise("success").alias("status"),
    )


def repos(spark: SparkSession, sf: str) -> DataFrame:
    """Repository snapshots: one per order."""
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    created = F.col("o_orderdate")
    return o.select(
        key.alias("id"),
        F.concat(F.lit("https://github.com/Owner"), text_of(cust % 50), F.lit("/repo"), text_of(cust),
                 pick(["", "/", ".git", ""], key % 4)).alias("github_url"),
        F.concat(F.lit("c"), text_of(key % 3)).alias("commit_hash"),
        F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "failed")
        .otherwise("processing").alias("status"),
        created.alias("created_at"),
        F.timestamp_add("DAY", F.lit(30), created).alias("expires_at"),
        (key % 9 == 0).alias("keep_longer"),
        F.when(key % 5 == 0, F.lit("packages/api")).when(key % 5 == 1, F.lit("")).alias("subpath"),
        cust.alias("user_id"),
    )


REPO_NOW = "1998-01-01 00:00:00"


def repo_now() -> Column:
    return F.lit(REPO_NOW).cast("timestamp_ntz")


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    return c.filter(key % 3 != 0).select(
        key.alias("user_id"),
        F.when(key % 4 == 0, "active").when(key % 4 == 1, "trialing").when(key % 4 == 2, "canceled").otherwise("past_due").alias("status"),
        F.when(key % 5 != 0, F.timestamp_add("DAY", (key % 60 - 30).cast("int"), now())).alias("current_period_end"),
    )


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "user_id",
        F.when(F.col("event_type").isin("view", "click"), "repo_analysis").otherwise(F.col("event_type")).alias("event_type"),
        F.col("ts").alias("created_at"),
    )


def _job_json(k: Column) -> Column:
    s = text_of
    code = F.repeat(F.lit("x = 1\\n"), (k % 100).cast("int"))

    def node(i: int) -> Column:
        tier = s((k + i) % 3)
        return F.concat(F.lit(f'{{"id": "src/a{i}.py", "tier": '), tier, F.lit(', "domain": "core", "exports": ["Foo'), s(k), F.lit(f'", "bar{i}"], "source_code": "'), code, F.lit('"}'))

    nodes = F.concat(F.lit('"nodes": ['), node(0), F.lit(", "), node(1), F.lit(", "), node(2), F.lit("]"))
    return pick_column(k % 6, [
        F.concat(F.lit('{"architecture_overview": {"total_files": '), s(k % 50), F.lit(', "total_loc": '), s(k % 1000), F.lit('}, "total_files": 7, "total_loc": 99, '), nodes, F.lit("}")),
        F.concat(F.lit('{"total_files": '), s(k % 20), F.lit(', "total_loc": '), s(k % 500), F.lit(', "nodes": []}')),
        F.concat(F.lit("{"), nodes, F.lit("}")),
        F.lit("{}"),
        F.lit(None).cast("string"),
        F.lit("not json"),
    ])


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Finished analyses with their stored document: one per order, in six shapes, some unreadable."""
    k = F.col("o_orderkey")
    told = F.concat(F.lit("- **Total Analyzed Files**: `"), text_of(k % 90), F.lit("`\n### Milestone 1: a\n### Milestone 2: b\n"))
    return table(spark, sf, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
        F.col("o_orderdate").alias("created_at"), _job_json(k).alias("graph_json"), F.when(k % 2 == 1, told).alias("markdown"))
