"""Symbols and blanks whose names meet in lists: the same rows as by joins, and no shuffle of single names."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buildlore import catalog
from buildlore.catalog import verification as V
from buildlore.catalog.base import QUERIES
from buildlore.operators import listed
from buildlore.operators import verification as C

E = "attempt string, pos int, name string, kind string, arg_count int, args array<string>"
S = "attempt string, idx int, name string, kind string, arg_count int, args array<string>, is_stub boolean"
X = "attempt string, full_name string, name string, is_trivial boolean"
Y = "attempt string, idx int, full_name string, name string, is_trivial boolean"


def rows(df):
    return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def lists(df):
    names = [c for c in df.columns if c != "attempt"]
    return df.groupBy("attempt").agg(F.collect_list(F.struct(*names)).alias("symbols"))


def made(seed, n):
    r = random.Random(seed)
    attempt = lambda: r.choice(["a", "b", "c", "only", None])
    kinds, names, args = ["class", "function", "method", "other", None], ["f", "g", "H", "é", "", None], [None, [], ["self"], ["x", "cls"], ["x", None], [None]]
    e = [(attempt(), r.randrange(4), r.choice(names), r.choice(kinds), r.choice([0, 1, 2, None]), r.choice(args)) for _ in range(n)]
    s = [(r.choice(["a", "b", "c", "other", None]), r.choice([*range(n), None]), r.choice(names), r.choice(kinds), r.choice([0, 1, 2, 3, None]), r.choice(args), r.choice([True, False, False, None])) for _ in range(n)]
    return e, s


@pytest.mark.parametrize("seed", [1, 2])
def test_lists_of_symbols_give_the_rows_of_the_join(spark, seed):
    e, s = made(seed, 120)
    e, s = spark.createDataFrame(e, E), spark.createDataFrame(s, S)
    for was, now in zip(C.compare_symbols(e, s), C.compare_symbols(lists(e), lists(s))):
        assert rows(now) == rows(was)


def test_lists_of_blanks_give_the_rows_of_the_joins(spark):
    r = random.Random(3)
    names = ["f", "g", "C.f", "C.g", "D.f", None]
    x = [(r.choice(["a", "b", "only", None]), r.choice(names), r.choice(names), r.choice([True, False, None])) for _ in range(80)]
    y = [(a, i, r.choice(names), r.choice(names), r.choice([True, False, None])) for i, a in enumerate(r.choices(["a", "b", "other", None], k=80))]
    x, y = spark.createDataFrame(x, X), spark.createDataFrame(y, Y)
    assert rows(C.grade_blanks(lists(x), lists(y))) == rows(C.grade_blanks(x, y))


def test_pairs_of_one_name_are_held_in_blocks(monkeypatch):
    monkeypatch.setattr(listed, "PAIRS", 7)
    key, other = np.array([3, -1, 3, 5, 3]), np.array([3, 5, -1, 3, 3, 8])
    blocks = list(listed._pairs(key, other))
    assert max(len(i) for i, _ in blocks) <= 7 and len(blocks) > 1
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*blocks)))) == [(i, j) for i, k in enumerate(key) for j, o in enumerate(other) if k == o >= 0]


def test_lists_are_opened_in_slices(monkeypatch):
    monkeypatch.setattr(listed, "SLICE", 5)
    sizes = [2, 2, 9, 0, 0, 3]
    batch = pa.RecordBatch.from_arrays([pa.array([[0] * n for n in sizes]), pa.array([None] * 6, pa.list_(pa.int64()))], ["expected", "submitted"])
    assert [p.column("expected").to_pylist() for p in listed._slices(batch)] == [[[0] * n for n in part] for part in ([2, 2], [9], [0, 0, 3])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of which some come twice, once with another text, or without text or source."""
    place = str(tmp_path_factory.mktemp("documents"))
    r = random.Random(4)
    words = ["alpha", "Beta", "gamma7", "de", "Delta_x", "zeta", "epsilon", "Étage", "theta99", "iotas", "kappa_lambda"]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(12))), "en", f"s{i % 3}", 5) for i in range(40)]
    docs += [docs[3], (7, "Other words alpha", "en", "s1", 5), (50, None, "en", "s0", 5), (51, "alpha beta", "en", None, 5), (52, "--", "en", "s2", 5)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{place}/documents.parquet")
    return place


@pytest.mark.parametrize("name", ["j11_symbol_comparison", "j11_extra_symbols", "j11_verdicts"])
def test_symbols_are_no_rows_before_they_have_met(spark, folder, name):
    catalog.load()
    ex, su = V.comparison(spark, folder)
    flat = C.compare_symbols(ex.select("attempt", F.inline("symbols")).withColumn("pos", F.col("name")), su.select("attempt", F.inline("symbols")))
    want = {"j11_symbol_comparison": flat[0], "j11_extra_symbols": flat[1], "j11_verdicts": C.verdicts(flat[0])}[name]
    df = QUERIES[name](spark, folder)
    assert rows(df) == rows(want.select(*df.columns))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and ", name#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


@pytest.mark.parametrize("name", ["j13_blank_grading", "j13_blank_verdicts"])
def test_blanks_are_no_rows_before_they_have_met(spark, folder, name, monkeypatch):
    catalog.load()
    grade, sides = C.grade_blanks, []
    monkeypatch.setattr(C, "grade_blanks", lambda *both: sides.extend(both) or grade(*both))
    df = QUERIES[name](spark, folder)
    flat = grade(*(side.select("attempt", F.inline("symbols")) for side in sides))
    want = {"j13_blank_grading": flat, "j13_blank_verdicts": C.blank_verdicts(flat)}[name]
    assert rows(df) == rows(want.select(*df.columns)) and rows(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and ", full_name#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
