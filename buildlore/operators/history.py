"""First appearances of files from commit history, and how far that history can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from buildlore.session import drop_table, write_table

RESTRUCTURE_THRESHOLD = 2  # fixed value: files sharing one first-seen timestamp


def first_seen(changes: DataFrame) -> DataFrame:
    """changes(repo_id, commit, ts, line_no, path, old_path) to one row per path: the oldest record that names it.

    `entered` is the newest record's place in the log, which is when a newest-first walk first meets the path.
    """
    old_first = F.struct("ts", "commit", (-F.col("line_no")).alias("l"), F.coalesce("old_path", F.lit("")).alias("o"))
    log_place = F.struct("ts", "commit", (-F.col("line_no")).alias("l"))
    packed = F.struct("commit", "ts", F.col("old_path").isNotNull().alias("was_rename"), F.col("old_path").alias("original_path"))
    return (
        changes.groupBy("repo_id", "path")
        .agg(F.min_by(packed, old_first).alias("_f"), F.max(log_place).alias("entered"), F.min(old_first).alias("born"))
        .select("repo_id", "path", "_f.*", "entered", "born")
    )


def _follow(nodes: DataFrame) -> DataFrame:
    """nodes(repo_id, path, ptr, commit, ts): replace commit and ts by those at the end of each pointer chain.

    `ptr` is null at a chain's end. Pointers are doubled, so a chain of length L takes log2(L) rounds.
    """
    spark = nodes.sparkSession
    nodes = write_table(nodes)[0]
    state, place = write_table(nodes.select("repo_id", "path", F.coalesce("ptr", "path").alias("ptr"), F.col("ptr").isNull().alias("end")))
    while True:
        nxt = state.select("repo_id", F.col("path").alias("ptr"), F.col("ptr").alias("jump"), F.col("end").alias("there"))
        seen = Observation()
        hop = state.join(nxt, ["repo_id", "ptr"]).select("repo_id", "path", F.col("jump").alias("ptr"), "end", "there")
        moved, where = write_table(hop.observe(seen, F.sum(F.when(F.col("there"), 0).otherwise(1)).alias("open")).drop("there"))
        drop_table(spark, place)
        state, place = moved, where
        if not seen.get["open"]:
            break
    ends = nodes.select("repo_id", F.col("path").alias("ptr"), F.col("commit").alias("end_commit"), F.col("ts").alias("end_ts"))
    return nodes.drop("ptr").join(state.select("repo_id", "path", "ptr"), ["repo_id", "path"]).join(ends, ["repo_id", "ptr"])


def propagate_renames(seen: DataFrame) -> DataFrame:
    """A renamed path takes the first commit of the name it had before.

    One pass in log order: the older name passes on a value of its own only when the walk met it earlier; otherwise it
    passes on what was recorded for it. Along such links log places strictly grow, so chains end.
    """
    seen = write_table(seen)[0]
    orig = seen.select("repo_id", F.col("path").alias("original_path"), F.col("commit").alias("oc"), F.col("ts").alias("ot"), F.col("entered").alias("oe"))
    j = seen.join(orig, ["repo_id", "original_path"], "left")
    linked = F.col("was_rename") & F.col("oe").isNotNull()
    earlier = F.struct("oe", "original_path") > F.struct("entered", "path")
    nodes = j.select(
        "repo_id", "path", "was_rename", "original_path", "entered", "born", F.when(linked & earlier, F.col("original_path")).alias("ptr"),
        F.when(linked & ~earlier, F.col("oc")).otherwise(F.col("commit")).alias("commit"),
        F.when(linked & ~earlier, F.col("ot")).otherwise(F.col("ts")).alias("ts"),
    )
    out = _follow(nodes)
    return out.select("repo_id", "path", F.col("end_commit").alias("commit"), F.col("end_ts").alias("ts"), "was_rename", "original_path")


def correct_restructures(dated: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that share a first-seen timestamp get the oldest date along their whole rename chain.

    A name leads to an older one only when that one's own oldest record is older, so chains end here too.
    """
    shared = dated.groupBy("repo_id", "ts").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= RESTRUCTURE_THRESHOLD).select("repo_id", "ts")
    orig = seen.select("repo_id", F.col("path").alias("original_path"), F.col("born").alias("ob"))
    j = seen.join(orig, ["repo_id", "original_path"], "left")
    older = F.col("was_rename") & F.col("ob").isNotNull() & (F.struct("ob.ts", "ob.commit") < F.struct("born.ts", "born.commit"))
    chains = _follow(j.select("repo_id", "path", F.when(older, F.col("original_path")).alias("ptr"), "commit", "ts"))
    true = chains.select("repo_id", "path", F.col("end_commit").alias("tc"), F.col("end_ts").alias("tt"))
    hit = dated.join(shared.withColumn("shared", F.lit(True)), ["repo_id", "ts"], "left").join(true, ["repo_id", "path"], "left")
    fix = F.coalesce(F.col("shared"), F.lit(False)) & F.col("tt").isNotNull() & (F.col("tt") != F.col("ts"))
    return hit.select(
        "repo_id", "path", F.when(fix, F.col("tc")).otherwise(F.col("commit")).alias("commit"), F.when(fix, F.col("tt")).otherwise(F.col("ts")).alias("ts"),
        (fix | F.col("was_rename")).alias("was_rename"), F.when(fix, F.col("path")).otherwise(F.col("original_path")).alias("original_path"),
        fix.alias("corrected"),
    )


def history_confidence(total: Column, processed: Column, unique_paths: Column, shallow: Column) -> Column:
    return (
        F.when(shallow, "reduced")
        .when((total > 0) & (processed < total), "reduced")
        .when((total < 3) & (unique_paths > 10), "reduced")
        .when((total == 1) & (unique_paths > 3), "reduced")
        .otherwise("high")
    )
