import datetime as dt

from buildlore.operators import history as H
from buildlore.operators import ordering as O
from buildlore.operators import resolution as J

DAY = dt.datetime(2024, 1, 1)


def tie_methods(spark, files, confidence="high", available=True, proposals=None):
    """files: path -> (domain, day or None), all in one tier."""
    tiers = spark.createDataFrame([("r", 0, False, p, d) for p, (d, _) in files.items()], "repo_id string, tier_index int, is_cyclic boolean, path string, domain string")
    seen = spark.createDataFrame([("r", p, DAY + dt.timedelta(days=n)) for p, (_, n) in files.items() if n is not None], "repo_id string, path string, ts timestamp_ntz")
    history = spark.createDataFrame([("r", available, confidence)], "repo_id string, available boolean, confidence string")
    groups = O.tie_groups(tiers, seen, history)
    rows = O.break_ties(groups, proposals).collect()
    return {r["path"]: r["method"] for r in rows}


def test_shared_timestamp_falls_to_domains(spark):
    files = {"a": ("core", 0), "b": ("config", 1), "c": ("core", 1), "d": ("core", 2)}
    assert tie_methods(spark, files) == {"a": "history", "b": "heuristic", "c": "heuristic", "d": "history"}


def test_history_is_ignored_when_reduced_or_incomplete(spark):
    files = {"a": ("core", 0), "b": ("core", 1)}
    assert set(tie_methods(spark, files, "reduced").values()) == {"unresolved"}
    assert set(tie_methods(spark, files, available=False).values()) == {"unresolved"}
    assert set(tie_methods(spark, {"a": ("core", 0), "b": ("docs", None)}).values()) == {"heuristic"}


def test_lone_file(spark):
    assert tie_methods(spark, {"a": ("core", 3)}) == {"a": "none"}


def test_proposal_naming_another_tier_is_refused(spark):
    files = {"a": ("core", None), "b": ("core", None)}
    schema = "repo_id string, tier_index int, group_key bigint, pos bigint, path string"
    good = spark.createDataFrame([("r", 0, -1, 0, "b"), ("r", 0, -1, 1, "a")], schema)
    bad = spark.createDataFrame([("r", 0, -1, 0, "b"), ("r", 0, -1, 1, "other")], schema)
    twice = spark.createDataFrame([("r", 0, -1, 0, "b"), ("r", 0, -1, 1, "b")], schema)
    assert set(tie_methods(spark, files, proposals=good).values()) == {"llm"}
    assert set(tie_methods(spark, files, proposals=bad).values()) == {"unresolved"}
    assert set(tie_methods(spark, files, proposals=twice).values()) == {"unresolved"}


def test_unknown_domain_ranks_before_uncategorized(spark):
    df = spark.createDataFrame([("weird",), ("uncategorized",), ("docs",)], "d string")
    assert [r[0] for r in df.select(O.priority(df["d"])).collect()] == [8, 9, 8]


def changes(spark, rows):
    return spark.createDataFrame([("r", c, DAY + dt.timedelta(days=c), n, p, o) for c, n, p, o in rows],
                                 "repo_id string, commit bigint, ts timestamp_ntz, line_no int, path string, old_path string")


def test_rename_takes_the_old_name_s_first_commit(spark):
    seen = H.first_seen(changes(spark, [(1, 1, "old", None), (2, 1, "new", "old")]))
    got = {r["path"]: (r["commit"], r["was_rename"]) for r in H.propagate_renames(seen).collect()}
    assert got == {"old": (1, False), "new": (1, True)}


def test_chain_passes_on_what_was_recorded_unless_met_earlier(spark):
    # newest first: c (renamed from b) is met before b (renamed from a), so c takes b's rename, b takes a's creation
    seen = H.first_seen(changes(spark, [(1, 1, "a", None), (2, 1, "b", "a"), (3, 1, "c", "b")]))
    got = {r["path"]: r["commit"] for r in H.propagate_renames(seen).collect()}
    assert got == {"a": 1, "b": 1, "c": 2}
    # b was touched again later, so the walk met it first and c takes its updated value
    seen = H.first_seen(changes(spark, [(1, 1, "a", None), (2, 1, "b", "a"), (3, 1, "c", "b"), (4, 1, "b", None)]))
    assert {r["path"]: r["commit"] for r in H.propagate_renames(seen).collect()} == {"a": 1, "b": 1, "c": 1}


def test_moved_directory_keeps_first_commits(spark):
    rows = [(1, 1, "x", None), (2, 1, "y", None), (3, 1, "src/x", "x"), (3, 2, "src/y", "y"), (4, 1, "lib/x", "src/x"), (4, 2, "lib/y", "src/y")]
    seen = H.first_seen(changes(spark, rows))
    dated = H.propagate_renames(seen)
    fixed = {r["path"]: (r["commit"], r["corrected"]) for r in H.correct_restructures(dated, seen).collect()}
    assert fixed["lib/x"] == (1, True) and fixed["lib/y"] == (2, True)
    assert fixed["x"][0] == 1 and fixed["src/y"][0] == 2


def test_rename_cycle_ends(spark):
    seen = H.first_seen(changes(spark, [(1, 1, "a", "b"), (2, 1, "b", "a"), (3, 1, "a", None)]))
    assert H.propagate_renames(seen).count() == 2
    assert H.correct_restructures(H.propagate_renames(seen), seen).count() == 2


def test_history_confidence(spark):
    rows = [(1, 1, 12, False), (2, 2, 11, False), (5, 4, 1, False), (9, 9, 1, True), (1, 1, 3, False), (3, 3, 500, False)]
    df = spark.createDataFrame(rows, "total int, processed int, paths int, shallow boolean")
    got = [r[0] for r in df.select(H.history_confidence(df["total"], df["processed"], df["paths"], df["shallow"])).collect()]
    assert got == ["reduced", "reduced", "reduced", "reduced", "high", "high"]


def test_extensionless_components_resolve(spark):
    files = ["src/index.tsx", "src/components/Button.jsx", "src/components/Card/index.tsx"]
    universe = spark.createDataFrame([("r", p) for p in files], "repo_id string, path string")
    raw = spark.createDataFrame([("r", files[0], "src/components/Button"), ("r", files[0], "src/components/Card"), ("r", files[0], "nowhere")],
                                "repo_id string, source string, target string")
    assert {r["target"] for r in J.resolve_targets(raw, universe).collect()} == set(files[1:])


def test_target_stages_stop_at_first_hit(spark):
    universe = spark.createDataFrame([("r", p) for p in ("lib", "lib/a.py", "x/lib.py", "m/n.py", "q/m/n.py", "d/1.txt", "d/e/2.txt")], "repo_id string, path string")
    wanted = ["lib", "n", "d", "m/n"]
    raw = spark.createDataFrame([("r", f"s{i}", t) for i, t in enumerate(wanted)], "repo_id string, source string, target string")
    got = {}
    for r in J.resolve_targets(raw, universe).collect():
        got.setdefault(wanted[int(r["source"][1:])], set()).add(r["target"])
    assert got == {"lib": {"lib"}, "n": {"m/n.py", "q/m/n.py"}, "d": {"d/1.txt", "d/e/2.txt"}, "m/n": {"m/n.py"}}
