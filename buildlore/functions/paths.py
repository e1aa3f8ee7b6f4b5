"""Path expressions and the inclusion rules of the corpus scan."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories, extensions and limits the inclusion rules name.
IGNORED_DIRECTORIES = [
    "node_modules", "dist", "build", ".next", "__pycache__", "target", ".venv", "venv", "env", ".git", ".idea",
    ".vscode", "coverage", ".cache", ".pytest_cache", "bin", "obj",
]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".7z", ".rar", ".bz2", ".xz",
    ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".lib", ".bin",
    ".pyc", ".pyo", ".pyd", ".class", ".jar",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".flv", ".mkv",
    ".db", ".sqlite", ".sqlite3",
]
MAX_FILE_BYTES = 1024 * 1024
MAX_DEPTH = 20
MAX_NAME = 255
MAX_SUBPATH = 255
MAX_SUBPATH_DEPTH = 16
SNIFF_BYTES = 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def slashes(path: Column) -> Column:
    """Backslashes become slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalize(path: Column) -> Column:
    """Slashes only, none at either end."""
    # trimming costs several times a look at both ends, and most paths have nothing to trim
    return let(slashes(path), lambda p: F.when(p.startswith("/") | p.endswith("/"), F.btrim(p, F.lit("/"))).otherwise(p))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def parents(path: Column) -> Column:
    """Directory names above the file."""
    p = parts(path)
    return F.slice(p, 1, F.size(p) - 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(name: Column) -> Column:
    """The last extension with its dot, as pathlib has it: none for dotfiles or a trailing dot."""

    def of_base(base: Column) -> Column:
        return let(F.substring_index(base, ".", -1), lambda ext: F.when(
            F.contains(base, F.lit(".")) & (ext != "") & F.substring(base, F.lit(1), F.length(base) - F.length(ext) - 1).rlike(r"[^.]"),
            F.concat(F.lit("."), ext)).when(base.isNotNull(), ""))

    return let(F.substring_index(name, "/", -1), of_base)


def splitext_ext(name: Column) -> Column:
    """The extension as os.path.splitext has it (a trailing dot counts, leading dots do not)."""
    return F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)


def splitext_stem(name: Column) -> Column:
    ext = splitext_ext(name)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext))


def depth(path: Column) -> Column:
    return F.size(parts(path))


def directory_prefixes(path: Column) -> Column:
    """Every directory above the file, as full prefixes: a/b/c -> [a, a/b]."""
    p = parts(path)
    return F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: i < F.size(p)),
        lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"),
    )


def tails(path: Column) -> Column:
    """Every proper suffix that starts after a slash: a/b/c -> [b/c, c]."""
    p = parts(path)
    return F.transform(
        F.filter(F.sequence(F.lit(2), F.greatest(F.size(p), F.lit(2))), lambda i: i <= F.size(p)),
        lambda i: F.array_join(F.slice(p, i, F.size(p) - i + 1), "/"),
    )


def resolve_dots(path: Column) -> Column:
    """Collapse `.`, `..` and doubled slashes in a relative path; a leading `..` that has nothing to pop stays."""
    seed = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        pop = (seg == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return (
            F.when(seg.isin("", "."), acc)
            .when(pop, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.array_append(acc, seg))
        )

    out = F.array_join(F.aggregate(parts(path), seed, step), "/")
    return F.when(out == "", F.lit(".")).otherwise(out)


def join_dir(directory: Column, relative: Column) -> Column:
    return F.when(directory.isNull() | (directory == ""), relative).otherwise(F.concat(directory, F.lit("/"), relative))


def is_ignored_directory(name: Column) -> Column:
    return F.lower(name).isin(IGNORED_DIRECTORIES) | name.startswith(".git")


def _any_case(names: list[str]) -> str:
    """Pattern of the names in any ASCII case, by first letter: a search tries one letter of each, not every name."""
    heads = sorted({n[0].lower() for n in names})
    return "|".join(f"[{re.escape(h)}{re.escape(h.upper())}](?i:{'|'.join(re.escape(n[1:]) for n in names if n[0].lower() == h)})" for h in heads)


def ignored_parent(norm: Column) -> Column:
    """The first ignored directory above the file, '' if there is none: one search, however deep the path is. No name has a letter that only Unicode folds."""
    found = F.regexp_extract(F.concat(F.lit("/"), norm), rf"/({_any_case(IGNORED_DIRECTORIES)}|\.git[^/]*)(?=/)", 1)
    return F.when(F.contains(norm, F.lit("/")), found).otherwise("")


def exclusion_reason(path: Column, subpath: Column | None = None, size: Column | None = None) -> Column:
    """Null when the file is kept, otherwise the first rule that rejects it."""
    start = F.when(path.isNull() | (path == "") | (path == ".gitmodules"), F.lit("skipped — submodule reference or empty path"))

    def rest(norm: Column, ignored: Column) -> Column:
        out = F.when(
            ignored != "", F.concat(F.lit("skipped — ignored directory '"), ignored, F.lit("'")),
        ).when(F.lower(suffix(norm)).isin(BINARY_EXTENSIONS), F.lit("skipped — binary file"))
        if size is not None:
            out = out.when(
                size > MAX_FILE_BYTES,
                F.concat(F.lit("skipped — file size ("), size.cast("string"), F.lit(" bytes) exceeds 1MB limit")),
            )
        return out

    def reason(norm: Column) -> Column:
        told = let(ignored_parent(norm), lambda ignored: rest(norm, ignored))
        if subpath is None:
            return told
        clean = normalize(subpath)
        inside = (norm == clean) | F.startswith(norm, F.concat(clean, F.lit("/")))
        scoped = subpath.isNotNull() & (subpath != "")
        return F.when(scoped & ~inside, F.lit("skipped — outside scoped subdirectory")).otherwise(told)

    return start.otherwise(let(normalize(path), reason))


def level_count(path: Column) -> Column:
    """How many parts of a path are neither empty nor `.`; plain paths are told by their slashes."""
    named = F.size(F.array_remove(F.array_remove(parts(path), ""), "."))

    def count(whole: Column) -> Column:
        plain = ~F.contains(whole, F.lit("//")) & ~F.contains(whole, F.lit("/./"))
        return F.when(plain, F.length(whole) - F.length(F.replace(whole, F.lit("/"))) - 1).otherwise(named)

    return let(F.concat(F.lit("/"), path, F.lit("/")), count)


def hardening_reason(path: Column, max_depth: int = MAX_DEPTH, max_name: int = MAX_NAME) -> Column:
    """Null when depth and name lengths are acceptable."""
    first = F.regexp_extract(path, rf"[^/]{{{max_name + 1},}}", 0)

    def reason(n: Column) -> Column:
        too_deep = F.concat(F.lit("Path depth ("), n.cast("string"), F.lit(f") exceeds maximum allowed limit of {max_depth} levels."))
        return F.when(n > max_depth, too_deep).when(first != "", too_long)

    too_long = F.concat(
        F.lit("Filename '"), F.substring(first, 1, 20), F.lit("...' length ("), F.length(first).cast("string"),
        F.lit(f") exceeds maximum limit of {max_name} characters."),
    )
    return let(level_count(path), reason)


def is_binary_content(content: Column) -> Column:
    """A zero byte among the first 1024 of a binary column."""
    return F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(b"\x00"))


def clean_subpath(raw: Column) -> Column:
    """struct(clean, error): a validated sub-directory, null when none was given, or the reason it was refused."""
    text = F.btrim(raw, F.lit(" \t\n\r\x0b\x0c"))
    norm = normalize(text)
    segs = F.filter(parts(norm), lambda s: s != "")
    bad = F.filter(segs, lambda s: ~s.rlike(r"^[a-zA-Z0-9_\-.]+$"))
    head = "Invalid subdirectory path: "
    error = (
        F.when(F.contains(text, F.lit("\x00")), F.lit(head + "Null byte injection detected."))
        .when(F.exists(segs, lambda s: F.contains(s, F.lit(".."))),
              F.lit(head + "Directory traversal ('..') is strictly prohibited."))
        .when(text.startswith("/") | text.startswith("\\") | F.contains(text, F.lit(":")),
              F.lit(head + "Absolute filesystem paths are prohibited."))
        .when(F.length(norm) > MAX_SUBPATH, F.lit(head + f"Path exceeds {MAX_SUBPATH} character limit."))
        .when(F.size(segs) > MAX_SUBPATH_DEPTH,
              F.lit(head + f"Path exceeds maximum directory nesting depth ({MAX_SUBPATH_DEPTH})."))
        .when(F.size(bad) > 0, F.concat(F.lit(head + "Segment '"), F.try_element_at(bad, F.lit(1)),
                                        F.lit("' contains illegal characters.")))
    )
    given = raw.isNotNull() & (text != "")
    return F.struct(
        F.when(given & error.isNull(), F.array_join(segs, "/")).alias("clean"), F.when(given, error).alias("error")
    )


HOST = "github.com"
_REPO = r"^https://github\.com/([a-zA-Z0-9_\-]+)/([a-zA-Z0-9_\-.]+?)(?:\.git)?/?$"


def repository_url(url: Column) -> Column:
    """struct(owner, name, error) for a public repository address."""
    parsed = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)"
    scheme = F.lower(F.regexp_extract(url, parsed, 1))
    authority = F.regexp_extract(url, parsed, 2)
    host = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?([^:]*)", 1))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    owner = F.regexp_extract(F.trim(url), _REPO, 1)
    name = F.regexp_extract(F.trim(url), _REPO, 2)
    error = (
        F.when(url.isNull() | (url == ""), F.lit("URL must be a non-empty string."))
        .when(scheme != "https", F.lit("Only HTTPS protocol is allowed."))
        .when(F.contains(authority, F.lit("@")), F.lit("URLs with embedded credentials are explicitly blocked."))
        .when(host != HOST, F.lit("Only public github.com URLs are supported in v1."))
        .when((port != "") & (port != "443"), F.lit("Non-standard ports are explicitly blocked."))
        .when(owner == "", F.lit("Invalid GitHub repository URL format. Expected: https://github.com/owner/repo"))
        .when(F.contains(name, F.lit("..")), F.lit("Path traversal patterns detected in repository URL."))
    )
    ok = error.isNull()
    return F.struct(F.when(ok, owner).alias("owner"), F.when(ok, name).alias("name"), error.alias("error"))


def repository_key(name: Column, url: Column) -> Column:
    """Lower-case `owner/repo` from a name, else from an address; a bare name stays as it is."""

    def key(c: Column) -> Column:
        bare = F.regexp_replace(F.trim(c), r"^https?://github\.com/", "")
        bare = F.lower(F.trim(F.regexp_replace(bare, r"\.git$", "")))
        p = F.split(bare, "/")
        two = F.concat_ws("/", F.try_element_at(p, F.lit(-2)), F.try_element_at(p, F.lit(-1)))
        return F.when(F.contains(bare, F.lit("/")), two).when(bare != "", bare)

    return F.coalesce(key(name), key(url))
