import random

import numpy as np
from pyspark.sql import functions as F

from buildlore.operators import retrieval as R
from buildlore.operators import scale
from buildlore.sources import corpus, sinks


def skewed(spark, n=500):
    """One key holds most rows."""
    rng = random.Random(0)
    rows = [("hot" if i % 4 else f"k{i % 5}", i, f"p{rng.random():.6f}{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, id bigint, name string")


def test_running_index(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["n"] for r in scale.running_index(df, ["k"], "id", "n", width=17).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        want |= {r[1]: i for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1]), 1)}
    assert got == want


def test_ordered_positions(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["n"] for r in scale.ordered_positions(df, ["k"], ["name"], "n").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        want |= {r[1]: i for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[2]), 1)}
    assert got == want


def test_top_k_over_blocks(spark):
    rng = np.random.default_rng(0)
    items = [("r1" if i % 5 else "r2", i, rng.normal(size=6).tolist()) for i in range(300)]
    items += [("r1", 1000 + i, items[1][2]) for i in range(4)]  # equal scores
    queries = [(r, q, rng.normal(size=6).tolist()) for r in ("r1", "r2", "r3") for q in range(3)] + [("r1", 9, items[1][2])]
    got = R.vector_topk(spark.createDataFrame(queries, "repo_id string, query_id int, vector array<double>"),
                        spark.createDataFrame(items, "repo_id string, item_id int, vector array<double>"), 4, query_rows=40, item_rows=40)
    found = {}
    for r in got.collect():
        found.setdefault((r["repo_id"], r["query_id"]), []).append((r["rank"], r["item_id"]))
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    want = {}
    for repo, q, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(x)), 6), i) for r, i, x in items if r == repo)[:4]
        if scored:
            want[repo, q] = [(n, i) for n, (_, i) in enumerate(scored, 1)]
    assert {k: sorted(v) for k, v in found.items()} == want


def test_caller_without_shared_words_is_found_by_the_graph(spark):
    chunks = spark.createDataFrame([("r", "lib.py", 1, 2, "c1", None, "def parse tokens grammar"), ("r", "use.py", 1, 2, "c2", None, "zzz qqq"), ("r", "x.py", 1, 2, "c3", None, "yyy www")],
                                   "repo_id string, path string, start_line int, end_line int, chunk_id string, symbol string, content string")
    edges = spark.createDataFrame([("r", "use.py", "lib.py")], "repo_id string, source string, target string")
    q = spark.createDataFrame([("r", 1, "parse tokens", "lib.py")], "repo_id string, query_id int, text string, path string")
    got = {r["chunk_id"]: r["sources"] for r in R.retrieve(q, chunks, edges, k=1, graph_k=5).collect()}
    assert got == {"c1": "graph,vector", "c2": "graph"}


def test_folder_scan_and_decoding(spark, tmp_path):
    (tmp_path / "repo" / "src").mkdir(parents=True)
    (tmp_path / "repo" / "src" / "a.py").write_bytes(b"ok \xff end")
    (tmp_path / "repo" / "b.bin").write_bytes(b"\x00\x01")
    df = corpus.scan_folder(spark, str(tmp_path / "repo"), "r1")
    got = {r["path"]: r["text"] for r in df.withColumn("text", corpus.decode_text(F.col("content"))).collect()}
    assert got["src/a.py"] == "ok � end" and set(got) == {"src/a.py", "b.bin"}


def test_commit_log_file(spark, tmp_path):
    log = ("COMMIT:h2|2024-02-01T00:00:00+00:00|Ann|fix: a|b\n\nM\tsrc/a.py\nR100\told\\x.py\tnew/x.py\nCOMMIT:h1|2024-01-01T00:00:00+00:00|Bo|start\n\n"
           "A\tsrc/a.py\nD\tgone.py\nCOMMIT:h0|2023-12-01T00:00:00+00:00|Bo|empty COMMIT: in text\n")
    (tmp_path / "log.txt").write_text(log)
    rows = corpus.parse_commits(corpus.read_commit_log(spark, str(tmp_path / "log.txt"))).collect()
    got = sorted((r["hash"], r["change_type"] or "", r["path"] or "", r["old_path"] or "", r["message"]) for r in rows)
    assert got == [("h0", "", "", "", "empty COMMIT: in text"), ("h1", "added", "src/a.py", "", "start"), ("h1", "deleted", "gone.py", "", "start"),
                   ("h2", "modified", "src/a.py", "", "fix: a|b"), ("h2", "renamed", "new/x.py", "old/x.py", "fix: a|b")]


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    place = str(tmp_path / "snaps")
    rows = lambda v, ids: spark.createDataFrame([(i, v, f"v{v}") for i in ids], "id int, version int, body string")
    sinks.upsert_snapshots(rows(1, range(20)), place, ["id"], "version", 8)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "snaps").rglob("*.parquet")}
    sinks.upsert_snapshots(rows(2, [3]), place, ["id"], "version", 8)
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "snaps").rglob("*.parquet")}
    assert len(before.items() - after.items()) == 1
    got = {r["id"]: r["body"] for r in spark.read.parquet(place).collect()}
    assert got == {i: "v2" if i == 3 else "v1" for i in range(20)}
