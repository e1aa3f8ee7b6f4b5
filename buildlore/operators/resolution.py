"""Target resolution as prioritised equi-joins.

Prefix and suffix tests become equality tests: every path also stands under each of its directory prefixes and tails
(at most its depth). Where only one hit is wanted the smallest path per key is chosen before the join, so a file name
that a third of all files share still is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlore.functions.paths import basename, directory_prefixes, join_dir, normalize, parent_dir, resolve_dots, slashes, tails
from buildlore.functions.text import WORD_BREAK
from buildlore.operators.scale import attach_counts
from buildlore.session import materialize

# Endings tried on a target, in order.
EXTENSIONS = [".py", ".go", ".ts", ".tsx", ".js", ".jsx", ".java", ".rs", ".cpp", ".h", ".tla"]
INDEX_NAMES = ["/index.tsx", "/index.jsx", "/index.ts", "/index.js", "/__init__.py"]
TAIL_ENDINGS = ["", ".py", ".go", ".js", ".jsx", ".ts", ".tsx"]
HIT_ROWS = 1024  # hits of one wanted name that are joined as one row
JS_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def option(rank: int, kind: str, key: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), key.alias("key"))


def _tagger(kind: str):
    return lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))


def keys_of(universe: DataFrame, kinds: dict[str, Column | str]) -> DataFrame:
    """(repo_id, kind, key, path): every name a file answers to. A kind's keys are an array column, or the name of a string column."""
    entries = []
    for kind, keys in kinds.items():
        keys = F.array(F.col(keys)) if isinstance(keys, str) else keys
        entries.append(F.transform(keys, _tagger(kind)))
    return universe.select("repo_id", "path", F.explode(F.concat(*entries)).alias("_k")).select("repo_id", "_k.kind", "_k.key", "path")


def one(c: Column) -> Column:
    return F.array(c)


FULL = "path"


def resolve_first(wants: DataFrame, ids: list[str], options: Column, universe: DataFrame, kinds: dict[str, Column | str]) -> DataFrame:
    """(repo_id, *ids, match, rank): the best-ranked hit of each wanted name, smallest path among equals."""
    keys = keys_of(universe, kinds).groupBy("repo_id", "kind", "key").agg(F.min("path").alias("path"))
    tried = wants.select("repo_id", *ids).distinct().select("repo_id", *ids, F.explode(options).alias("_o"))
    tried = tried.select("repo_id", *ids, F.col("_o.rank").alias("rank"), F.col("_o.kind").alias("kind"), F.col("_o.key").alias("key"))
    return (
        tried.join(keys, ["repo_id", "kind", "key"])
        .groupBy("repo_id", *ids)
        .agg(F.min(F.struct("rank", "path")).alias("_m"))
        .select("repo_id", *ids, F.col("_m.path").alias("match"), F.col("_m.rank").alias("rank"))
    )


def resolve_all(wants: DataFrame, ids: list[str], options: Column, universe: DataFrame, kinds: dict[str, Column | str]) -> DataFrame:
    """(repo_id, *ids, match): every hit of the best rank that hits at all."""
    keys = keys_of(universe, kinds)
    tried = wants.select("repo_id", *ids).distinct().select("repo_id", *ids, F.explode(options).alias("_o"))
    tried = tried.select("repo_id", *ids, F.col("_o.rank").alias("rank"), F.col("_o.kind").alias("kind"), F.col("_o.key").alias("key"))
    # which rank wins needs only the distinct keys, not the files behind them
    present = keys.select("repo_id", "kind", "key").distinct()
    best = tried.join(present, ["repo_id", "kind", "key"], "left_semi").groupBy("repo_id", *ids).agg(F.min("rank").alias("rank"))
    return (
        tried.join(best, ["repo_id", *ids, "rank"], "left_semi")
        .join(keys, ["repo_id", "kind", "key"])
        .select("repo_id", *ids, F.col("path").alias("match"))
        .distinct()
    )


def resolve_targets(raw_edges: DataFrame, universe: DataFrame) -> DataFrame:
    """Internal edges (repo_id, source, target): exact, extensions, index files, directory (all files), suffix (all files)."""
    t = F.col("want")
    ranked = [option(0, "full", t)]
    ranked += [option(1 + i, "full", F.concat(t, F.lit(e))) for i, e in enumerate(EXTENSIONS + INDEX_NAMES)]
    ranked += [option(50, "dir", t)]
    ranked += [option(51, "tail", F.concat(t, F.lit(e))) for e in TAIL_ENDINGS]
    wants = raw_edges.select("repo_id", slashes(F.col("source")).alias("source"), slashes(F.col("target")).alias("want"))
    # four steps below read these edges, so whatever extracts them runs once
    wants = materialize(wants.filter((F.col("source") != "") & (F.col("want") != "")))
    everything = universe.select("repo_id", slashes(F.col("path")).alias("path")).unionByName(
        wants.select("repo_id", F.col("source").alias("path"))
    ).distinct()
    everything = materialize(everything)
    path = F.col("path")
    hits = resolve_all(wants, ["want"], F.array(*ranked), everything, {"full": FULL, "dir": directory_prefixes(path), "tail": tails(path)})
    return edges_of(wants, hits)


def edges_of(wants: DataFrame, hits: DataFrame, hit_rows: int = HIT_ROWS) -> DataFrame:
    """(repo_id, source, target), each once: every hit (repo_id, want, match) of what a source wants, but itself.

    A folder's importers times its files are far more rows than either, so those are made last and are never shuffled: hits are joined as lists of
    bounded length, and a file that several names of one source hit is taken for the first of them, as every hit knows the names that hit it.
    """
    tasks = 4 * wants.sparkSession.sparkContext.defaultParallelism  # few bytes become many rows: by their size they would be one task's work
    key = ["repo_id", "want", "_block"]
    named = hits.groupBy("repo_id", "match").agg(F.collect_set("want").alias("by"))
    counted = attach_counts(hits.join(named, ["repo_id", "match"]), ["repo_id", "want"], _n=F.count(F.lit(1)))
    blocks = F.ceil(F.col("_n") / F.lit(hit_rows)).cast("int")
    lists = materialize(counted.groupBy("repo_id", "want", blocks.alias("_blocks"), F.pmod(F.xxhash64("match"), blocks).cast("int").alias("_block")).agg(
        F.collect_list(F.struct("match", "by")).alias("_hits")))
    asked = wants.groupBy("repo_id", "source").agg(F.array_sort(F.collect_set("want")).alias("_wants"))
    asked = asked.select("repo_id", "source", "_wants", F.posexplode("_wants").alias("_at", "want")).withColumn("_before", F.slice("_wants", F.lit(1), F.col("_at"))).drop("_wants", "_at")
    asked = asked.join(lists.select("repo_id", "want", "_block"), ["repo_id", "want"])
    made = asked.repartition(tasks, *key).join(lists.drop("_blocks").repartition(tasks, *key), key).select("repo_id", "source", "_before", F.explode("_hits").alias("_h"))
    first = (F.size("_before") == 0) | ~F.arrays_overlap("_before", "_h.by")
    return made.filter((F.col("source") != F.col("_h.match")) & first).select("repo_id", "source", F.col("_h.match").alias("target"))


def resolve_python(refs: DataFrame, universe: DataFrame) -> DataFrame:
    """refs(repo_id, path, symbol, ...) plus target and is_external: same directory, root, src/, then any suffix."""
    rel = F.concat(F.replace("symbol", F.lit("."), F.lit("/")), F.lit(".py"))
    pkg = F.concat(F.replace("symbol", F.lit("."), F.lit("/")), F.lit("/__init__.py"))
    inside = lambda c: F.concat(F.col("folder"), F.lit("/"), c)
    near = F.when(F.col("folder") != "", F.array(option(0, "full", inside(rel)), option(1, "full", inside(pkg))))
    rest = F.array(
        option(2, "full", rel), option(3, "full", pkg), option(4, "full", F.concat(F.lit("src/"), rel)),
        option(5, "full", F.concat(F.lit("src/"), pkg)), option(6, "tail", rel), option(6, "tail", pkg),
    )
    options = F.when(F.col("symbol") == "", F.array().cast("array<struct<rank:int,kind:string,key:string>>")).otherwise(
        F.concat(F.coalesce(near, F.array().cast("array<struct<rank:int,kind:string,key:string>>")), rest))
    wants = refs.withColumn("folder", parent_dir(F.col("path")))
    hits = resolve_first(wants, ["folder", "symbol"], options, universe, {"full": FULL, "tail": tails(F.col("path"))})
    top = F.when(F.col("symbol") == "", F.lit("unknown")).otherwise(F.substring_index("symbol", ".", 1))
    return (
        wants.join(hits.drop("rank"), ["repo_id", "folder", "symbol"], "left")
        .withColumn("target", F.coalesce("match", top))
        .withColumn("is_external", F.col("match").isNull())
        .drop("folder", "match")
    )


def resolve_javascript(refs: DataFrame, universe: DataFrame) -> DataFrame:
    """refs(repo_id, path, specifier): relative ones try nine endings, bare ones name a package (two parts when scoped)."""
    local = F.col("specifier").startswith(".")
    wants = refs.withColumn("near", F.when(local, resolve_dots(join_dir(parent_dir(F.col("path")), F.col("specifier")))))
    options = F.array(*[option(i, "full", F.concat(F.col("near"), F.lit(e))) for i, e in enumerate(JS_ENDINGS)])
    hits = resolve_first(wants.filter(local), ["near"], options, universe, {"full": FULL})
    package = F.when(F.col("specifier").startswith("@"), F.substring_index("specifier", "/", 2)).otherwise(F.substring_index("specifier", "/", 1))
    return (
        wants.join(hits.drop("rank"), ["repo_id", "near"], "left")
        .withColumn("target", F.when(local, F.coalesce("match", "near")).otherwise(package))
        .withColumn("is_external", ~local)
        .withColumn("found", F.col("match").isNotNull())
        .drop("near", "match")
    )


def resolve_go(refs: DataFrame, universe: DataFrame, modules: DataFrame) -> DataFrame:
    """refs(repo_id, path, specifier): standard library, own module, relative, else external."""
    s, m = F.col("specifier"), F.col("module")
    wants = refs.join(modules.select("repo_id", F.col("name").alias("module")), "repo_id", "left")
    stdlib = ~F.contains(F.substring_index(s, "/", 1), F.lit("."))
    own = ~stdlib & m.isNotNull() & ((s == m) | F.startswith(s, F.concat(m, F.lit("/"))))
    rel = F.ltrim(F.substring(s, F.length(m) + 1, F.length(s)), F.lit("/"))
    local = ~stdlib & ~own & s.startswith(".")
    wants = wants.withColumn("case", F.when(stdlib, "std").when(own, "own").when(local, "local").otherwise("external")).withColumn(
        "want", F.when(own, rel).when(local, resolve_dots(join_dir(parent_dir(F.col("path")), s))))
    w = F.col("want")
    options = F.array(option(0, "godir", w), option(0, "file", w), option(0, "file", F.concat(w, F.lit(".go"))))
    is_go = F.col("path").endswith(".go")
    root = F.when(is_go & ~F.contains("path", F.lit("/")), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    kinds = {"godir": F.when(is_go, F.concat(directory_prefixes(F.col("path")), root)).otherwise(none), "file": FULL}
    hits = resolve_first(wants.filter(w.isNotNull()), ["want"], options, universe, kinds)
    is_own = F.col("case") == "own"
    return wants.join(hits.drop("rank"), ["repo_id", "want"], "left").select(
        "repo_id", "path", "specifier",
        F.when(is_own & (w == "") , m).when(is_own | (F.col("case") == "local"), w).otherwise(s).alias("target"),
        (F.col("case") == "external").alias("is_external"),
        F.when(F.col("case") == "std", True).when(F.col("case") == "external", False).otherwise(F.col("match").isNotNull()).alias("resolved"),
    )


def resolve_rust(refs: DataFrame, universe: DataFrame, crates: DataFrame) -> DataFrame:
    """refs(repo_id, path, specifier, is_mod): `mod` declarations look beside the file, `use` paths below the crate."""
    s, c = F.col("specifier"), F.col("crate")
    wants = refs.join(crates.select("repo_id", F.col("name").alias("crate")), "repo_id", "left")
    first = F.substring_index(s, "::", 1)
    segments = F.split(s, "::")
    rest = F.array_join(F.slice(segments, F.lit(2), F.size(segments)), "/")
    std = ~F.col("is_mod") & first.isin("std", "core", "alloc")
    inner = ~F.col("is_mod") & first.isin("crate", "super", "self")
    own = ~F.col("is_mod") & ~std & ~inner & c.isNotNull() & ((s == c) | F.startswith(s, F.concat(c, F.lit("::"))))
    case = F.when(F.col("is_mod"), "mod").when(std, "std").when(inner, "inner").when(own, "own").otherwise("external")
    wants = wants.withColumn("case", case).withColumn(
        "want", F.when(F.col("is_mod"), join_dir(parent_dir(F.col("path")), s)).when(inner | own, rest))
    w = F.col("want")
    below = lambda p, e: F.concat(F.lit(p), w, F.lit(e))
    options = F.when(F.col("case") == "mod", F.array(option(0, "full", below("", ".rs")), option(1, "full", below("", "/mod.rs")))).otherwise(
        F.array(*[option(i, "full", below(p, e)) for i, (p, e) in enumerate([("", ".rs"), ("", "/mod.rs"), ("src/", ".rs"), ("src/", "/mod.rs")])]))
    hits = resolve_first(wants.filter(w.isNotNull()), ["want", "case"], options, universe, {"full": FULL})
    target = (
        F.when(F.col("case") == "mod", F.coalesce("match", below("", ".rs")))
        .when((F.col("case") == "own") & (w == ""), c).when(F.col("case").isin("inner", "own") & (w != ""), w).otherwise(s)
    )
    ok = F.when(F.col("case") == "std", True).when(F.col("case") == "external", False).otherwise((w == "") | F.col("match").isNotNull())
    return wants.join(hits.drop("rank"), ["repo_id", "want", "case"], "left").select(
        "repo_id", "path", "specifier", "is_mod", target.alias("target"), (F.col("case") == "external").alias("is_external"), ok.alias("resolved"))


def resolve_java(refs: DataFrame, universe: DataFrame) -> DataFrame:
    """refs(repo_id, path, symbol, import_type, line): any file whose path ends in the symbol's path, slash or not."""
    rel = F.concat(F.replace("symbol", F.lit("."), F.lit("/")), F.lit(".java"))
    java = universe.filter(F.col("path").endswith(".java"))
    ends = F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring(F.col("path"), i, F.length("path")))
    hits = resolve_first(refs, ["symbol"], F.array(option(0, "end", rel)), java, {"end": ends})
    out = refs.join(hits.drop("rank"), ["repo_id", "symbol"], "left")
    missing = F.col("match").isNull()
    return out.withColumn("target", F.coalesce("match", "symbol")).withColumn("is_external", missing).withColumn(
        "resolved", ~missing & (F.col("import_type") == "static")).drop("match")


def resolve_includes(refs: DataFrame, universe: DataFrame) -> DataFrame:
    """refs(repo_id, path, raw, system, line): beside the file, as written, below include/, below src/."""
    local = refs.filter(~F.col("system")).withColumn("near", resolve_dots(join_dir(parent_dir(F.col("path")), F.col("raw"))))
    raw = F.col("raw")
    options = F.array(option(0, "full", F.col("near")), option(1, "full", raw), option(2, "full", F.concat(F.lit("include/"), raw)),
                      option(3, "full", F.concat(F.lit("src/"), raw)))
    hits = resolve_first(local, ["near", "raw"], options, universe, {"full": FULL})
    found = local.join(hits.drop("rank"), ["repo_id", "near", "raw"], "left")
    inside = found.select("repo_id", "path", "line", "raw", F.coalesce("match", "near").alias("target"), F.col("match").isNotNull().alias("resolved"),
                          F.col("match").isNull().alias("is_external"))
    outside = refs.filter("system").select("repo_id", "path", "line", "raw", raw.alias("target"), F.lit(True).alias("resolved"), F.lit(True).alias("is_external"))
    return inside.unionByName(outside)


def resolve_shell(refs: DataFrame, universe: DataFrame) -> DataFrame:
    plain = refs.filter(~F.col("dynamic"))
    hits = resolve_first(plain, ["near", "raw"], F.array(option(0, "full", F.col("near")), option(1, "full", F.col("raw"))), universe, {"full": FULL})
    found = plain.join(hits.drop("rank"), ["repo_id", "near", "raw"], "left")
    hit = F.col("match").isNotNull()
    fixed = found.select("repo_id", "path", "line", "raw", F.coalesce("match", "near").alias("target"), hit.alias("resolved"),
                         (~hit & ~F.col("raw").startswith(".")).alias("is_external"), F.col("kind").alias("import_type"))
    open_ended = refs.filter("dynamic").select("repo_id", "path", "line", "raw", F.col("raw").alias("target"), F.lit(False).alias("resolved"),
                                               F.lit(False).alias("is_external"), F.lit("dynamic").alias("import_type"))
    return fixed.unionByName(open_ended)


def resolve_tla(modules: DataFrame, universe: DataFrame) -> DataFrame:
    """modules(repo_id, path, extends): beside the file, then any .tla of that name; everything else is external."""
    wants = modules.select("repo_id", "path", F.explode("extends").alias("name")).withColumn(
        "near", join_dir(parent_dir(F.col("path")), F.concat(F.col("name"), F.lit(".tla"))))
    specs = universe.filter(F.col("path").endswith(".tla"))
    options = F.array(option(0, "full", F.col("near")), option(1, "base", F.concat(F.col("name"), F.lit(".tla"))))
    hits = resolve_first(wants, ["near", "name"], options, specs, {"full": FULL, "base": one(basename(F.col("path")))})
    return wants.join(hits.drop("rank"), ["repo_id", "near", "name"], "left").select(
        "repo_id", "path", "name", F.coalesce("match", "name").alias("target"), F.col("match").isNull().alias("is_external"), F.col("match").isNotNull().alias("resolved"))


def linked_configs(modules: DataFrame, universe: DataFrame) -> DataFrame:
    """Model files of a specification: same folder by file or module name, otherwise anywhere by name (all of them)."""
    stem = F.regexp_extract(F.col("path"), r"([^/]+?)\.tla$", 1)
    wants = modules.select("repo_id", "path", "module", stem.alias("stem"), parent_dir(F.col("path")).alias("folder"))
    names = F.array_distinct(F.filter(F.array("stem", "module"), lambda x: x != ""))
    tried = wants.select("repo_id", "path", "folder", F.explode(names).alias("name"))
    configs = universe.filter(F.col("path").endswith(".cfg")).select("repo_id", F.col("path").alias("config"))
    configs = configs.withColumn("name", F.regexp_extract("config", r"([^/]+)\.cfg$", 1)).withColumn("at", parent_dir(F.col("config")))
    beside = tried.join(configs.withColumnRenamed("at", "folder"), ["repo_id", "folder", "name"]).select("repo_id", "path", "config")
    others = tried.join(beside.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")
    return beside.unionByName(others.join(configs, ["repo_id", "name"]).select("repo_id", "path", "config")).distinct()


# Names too general to link files of one package by.
GENERIC_SYMBOLS = [
    "app", "cli", "json", "data", "get", "run", "test", "error", "name", "main", "dict", "list", "map", "path", "type",
    "file", "self", "cls", "val", "key", "args", "kwargs", "config", "req", "res", "response", "request", "url", "route",
    "helper", "helpers", "utils", "util", "handler", "handlers", "opts", "options", "params", "param", "init", "setup",
    "info", "log", "logger", "trace", "debug", "warning", "warn", "critical", "exception", "exc", "sys", "os", "re", "time",
    "math", "base", "core", "default", "node", "tree", "item", "items", "builder", "manager", "service", "client", "server",
    "ctx", "context", "engine", "parser", "schema", "result", "status", "code", "event", "events", "flag", "flags", "rule",
    "rules", "state", "model", "view", "controller", "err", "resp",
]


def link_symbols(files: DataFrame, symbols: DataFrame, suffix: str = ".go") -> DataFrame:
    """Edges between files of one directory where one mentions, as a whole word, a symbol another defines.

    A symbol has one definer (the last path), so the join adds one row per distinct mentioned word and never pairs files.
    """
    folder = parent_dir(F.col("path"))
    definers = (
        symbols.filter(F.col("path").endswith(suffix) & (F.length("symbol") >= 3) & ~F.lower("symbol").isin(GENERIC_SYMBOLS))
        .groupBy("repo_id", folder.alias("folder"), F.col("symbol").alias("word"))
        .agg(F.max("path").alias("target"))
    )
    words = F.array_distinct(F.filter(F.split("content", WORD_BREAK), lambda w: F.length(w) >= 3))
    mentions = files.filter(F.col("path").endswith(suffix)).select(
        "repo_id", folder.alias("folder"), F.col("path").alias("source"), F.explode(words).alias("word"))
    return (
        mentions.join(definers, ["repo_id", "folder", "word"])
        .filter(F.col("source") != F.col("target"))
        .select("repo_id", "source", "target")
        .distinct()
    )


def find_files(wants: DataFrame, universe: DataFrame) -> DataFrame:
    """wants(repo_id, want) plus match: exact, normalised, suffix either way, then file name; smallest path among equals."""
    norm = normalize(F.col("want"))
    options = F.concat(
        F.array(option(0, "full", F.col("want")), option(1, "norm", norm), option(2, "tail", norm)),
        F.transform(tails(norm), lambda k: F.struct(F.lit(2).alias("rank"), F.lit("norm").alias("kind"), k.alias("key"))),
        F.array(option(3, "base", basename(norm))),
    )
    p = normalize(F.col("path"))
    kinds = {"full": FULL, "norm": one(p), "tail": tails(p), "base": one(basename(p))}
    return resolve_first(wants.filter(F.col("want") != ""), ["want"], options, universe, kinds)
