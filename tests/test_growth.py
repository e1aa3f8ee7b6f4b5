"""Results of steps whose work must not grow faster than their input, and the shape of their plans."""

from buildlore.operators import resolution as J


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_folder_hits_are_made_last(spark):
    files = [("r", f"src/f{i}.py") for i in range(9)] + [("r", f"src/deep/g{i}.py") for i in range(7)]
    raw = [("r", a, b) for a, b in [("src/f0.py", "src"), ("src/f0.py", "src/deep"), ("src/f0.py", "g1"), ("src/f1.py", "src/deep"), ("src/f1.py", "src/deep"), ("top.py", "src")]]
    hits = [("r", "src", p) for _, p in files] + [("r", "src/deep", p) for _, p in files if "deep" in p] + [("r", "g1", "src/deep/g1.py")]
    wants = spark.createDataFrame(raw, "repo_id string, source string, want string")
    out = J.edges_of(wants, spark.createDataFrame(hits, "repo_id string, want string, match string"), hit_rows=2)
    expected = sorted({("r", s, m) for _, s, w in raw for _, h, m in hits if h == w and m != s})
    assert sorted(tuple(r) for r in out.collect()) == expected
    universe = spark.createDataFrame(files, "repo_id string, path string")
    resolved = J.resolve_targets(wants.withColumnRenamed("want", "target"), universe)
    assert sorted(tuple(r) for r in resolved.collect()) == expected
    # nothing is grouped or dealt after the lists are opened
    assert plan_of(resolved).splitlines()[0].startswith("Project") and "Aggregate" not in plan_of(resolved).split("Join")[0]


def test_spans_are_not_made_below_the_join(spark):
    from buildlore.catalog import retrieval as Q

    plan = plan_of(Q.s2(spark, "/root/testdata/sf0.001"))
    assert not [line for line in plan.splitlines() if "Join" in line and ("_lines" in line or "split(" in line)]


def test_leaked_symbols_match_plain_version(spark):
    from buildlore.operators import retrieval as R

    rows = [("a", "Run the RUNNER, then stop_it; ÉTÉ", ["run", "Run", "RUN", "runner", "stop_it", "it", "Été", "gone"]), ("b", "", ["abc"]), ("c", "Abc", []), ("d", "of", ["of"]), ("e", None, ["abc"])]
    hints = spark.createDataFrame(rows, "hint_id string, text string, names array<string>").select("hint_id", R.said_words("text").alias("said"), "names")
    got = sorted(tuple(r) for r in R.leaked_symbols(hints).collect())
    assert got == sorted([("a", n) for n in ("run", "Run", "RUN", "runner", "stop_it", "Été")])


def made_files(spark):
    import random

    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma_x", "Delta", "eps", "zeta", "Eta", "theta", "iota", "a/b", "run.py", ""]
    files = [(i, "r", i % 3, f"p{rng.randrange(1000):03}_{i}", rng.sample(words, rng.randrange(0, 9))) for i in range(40)]
    lists = spark.createDataFrame([(f[0], f[4]) for f in files], "id int, symbols array<string>")
    placed = spark.createDataFrame([f[:4] for f in files], "id int, repo_id string, tier_index int, path string")
    return files, lists, placed


def test_first_symbols_of_tiers_match_plain_version(spark):
    from buildlore.operators import milestones as M

    files, lists, placed = made_files(spark)
    got = {}
    for r in M.milestone_symbols(lists, placed, "id", 4).orderBy("place").collect():
        got.setdefault(r["tier_index"], []).append(r["symbol"])
    for t in range(3):
        assert got[t] == sorted({s for f in files if f[2] == t for s in f[4] if s and "/" not in s and not s.endswith(".py")})[:4]


def test_second_hints_match_plain_version(spark):
    from buildlore.operators import milestones as M

    files, lists, placed = made_files(spark)
    got = {r["tier_index"]: r["hint"] for r in M.second_hint(placed, lists, placed, "id", most=3).collect()}
    for t in range(3):
        first = {}
        for f in sorted((f for f in files if f[2] == t), key=lambda f: f[3]):
            for s in f[4]:
                first.setdefault(s, f[3])
        names = [s for _, s in sorted((p, s) for s, p in first.items())][:3]
        kinds = ["class" if s[:1].isupper() and "_" not in s else "function" for s in names]
        assert ", ".join(f"`{s}` ({k})" for s, k in zip(names, kinds)) + ". Verify" in got[t]


def test_items_move_once_for_many_queries(spark):
    import numpy as np
    from buildlore.operators import retrieval as R

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, (1500, 4)).astype(float), rng.integers(0, 4, (60, 4)).astype(float)
    q = spark.createDataFrame([("r", i, v.tolist()) for i, v in enumerate(a)] + [("none", 0, [1.0] * 4)], "repo_id string, query_id int, vector array<double>")
    it = spark.createDataFrame([("r", f"c{i:02}", v.tolist()) for i, v in enumerate(b)], "repo_id string, item_id string, vector array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(a) @ unit(b).T, 6)
    got = {}
    for r in R.vector_topk(q, it, 3, item_rows=20).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == {i: [f"c{j:02}" for j in np.lexsort((np.arange(60), -s))[:3]] for i, s in enumerate(scores)}
    assert R.QUERY_ROWS > len(a) > R.SCORE_ROWS


def test_a_path_is_taken_apart_once_for_all_rules(spark):
    from buildlore.operators.ordering import convention_domains

    told = convention_domains(spark.createDataFrame([("r", "src/tests/a.py"), ("r", "/README.md"), ("r", ".env.x/b.xyz"), ("r", None)], "repo_id string, path string"))
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert max(plan.count(f) for f in ("regexp_extract(", "split(", "replace(")) <= 6
    assert [(r.domain, r.confidence) for r in told.collect()] == [("tests", "high"), ("docs", "high"), ("uncategorized", "low"), ("uncategorized", "low")]
