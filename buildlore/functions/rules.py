"""Naming conventions that place a file in a domain. One `when` chain, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlore.functions.paths import let, normalize, parts, splitext_ext, splitext_stem

# Folder, file and extension lists of each domain.
TEST_FOLDERS = ["tests", "test", "spec", "specs", "__tests__", "testing"]
DOC_FOLDERS = ["docs", "doc", "documentation", "man"]
DOC_EXTENSIONS = [".md", ".rst", ".adoc", ".txt"]
DOC_FILES = ["license", "changelog", "contributing", "readme", "architecture"]
CONFIG_FOLDERS = [".github", ".vscode", ".idea", "config", "configs", "configuration", "ci", "scripts", "build"]
CONFIG_FILES = [
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "requirements.txt", "pipfile", "poetry.lock", "pyproject.toml", "setup.py", "setup.cfg",
    "cargo.toml", "cargo.lock", "go.mod", "go.sum", "pom.xml", "build.gradle", "gradlew",
    "tsconfig.json", "jsconfig.json", "docker-compose.yml", "docker-compose.yaml",
    "dockerfile", "makefile", "cmakelists.txt", "rakefile", ".gitignore", ".env", ".flaskenv",
]
CONFIG_EXTENSIONS = [".cfg", ".toml", ".yaml", ".yml", ".ini", ".properties"]
DATABASE_FOLDERS = ["db", "database", "migrations", "migration", "schema", "schemas", "sql"]
DATABASE_EXTENSIONS = [".sql"]
EXAMPLE_FOLDERS = [
    "examples", "example", "demo", "demos", "sample", "samples", "tutorial", "tutorials", "showcase", "cookbook",
]
FRONTEND_FOLDERS = [
    "frontend", "client", "web", "ui", "components", "views", "pages", "styles", "assets", "static", "public",
    "layouts", "hooks",
]
FRONTEND_EXTENSIONS = [".tsx", ".jsx", ".vue", ".svelte", ".css", ".scss", ".sass", ".less", ".html"]
BACKEND_FOLDERS = [
    "backend", "server", "api", "routes", "controllers", "services", "handlers", "endpoints", "models", "repository",
    "dao",
]
BACKEND_FILES = ["main.go", "app.py", "server.js", "main.rs", "application.java", "wsgi.py", "asgi.py"]
BACKEND_WORDS = ["controller", "route", "service", "handler", "endpoint", "repository", "dao"]
CORE_FOLDERS = [
    "core", "runtime", "kernel", "lib", "library", "internal", "pkg", "include", "src", "specifications", "specs",
]
CODE_EXTENSIONS = [
    ".rs", ".go", ".py", ".java", ".js", ".ts", ".cpp", ".c", ".h", ".hpp", ".cc", ".tla", ".swift", ".kt", ".rb",
    ".php", ".cs",
]
CODE_LANGUAGES = ["go", "rust", "java", "python", "javascript", "typescript", "cpp", "c", "tla+", "shell"]

DOMAINS = ["config", "database", "core", "backend", "frontend", "examples", "tests", "docs", "uncategorized"]


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def classify(path: Column, language: Column | None = None) -> Column:
    """struct(domain, confidence) by the first rule that fits.

    What the rules ask of a path is bound by lambdas: as plain columns it would be worked out again wherever a rule names it.
    """
    return let(parts(F.lower(normalize(path))), lambda p: let(F.element_at(p, -1), lambda name: let(
        F.struct(p.alias("p"), F.slice(p, 1, F.size(p) - 1).alias("above"), name.alias("name"), splitext_ext(name).alias("ext"), splitext_stem(name).alias("stem")),
        lambda facts: _by_rules(facts, language))))


def _by_rules(facts: Column, language: Column | None) -> Column:
    p, above, name, ext, stem = (facts[c] for c in ("p", "above", "name", "ext", "stem"))

    def under(folders: list[str]) -> Column:
        return F.arrays_overlap(above, strings(folders))

    def one_of(c: Column, values: list[str]) -> Column:
        return c.isin(values)

    code = one_of(ext, CODE_EXTENSIONS)
    known = F.coalesce(language.isin(CODE_LANGUAGES), F.lit(False)) if language is not None else F.lit(False)
    in_core_root = (F.size(p) > 1) & one_of(F.element_at(p, 1), CORE_FOLDERS)
    found = (
        F.when(under(TEST_FOLDERS) | name.rlike(r"^test_|[._](test|spec)\."), "tests")
        .when(
            one_of(name, CONFIG_FILES)
            | under(CONFIG_FOLDERS)
            | name.rlike(r"^(\.env|dockerfile|\.eslint|\.prettier)")
            | one_of(ext, CONFIG_EXTENSIONS),
            "config",
        )
        .when(under(DOC_FOLDERS) | stem.rlike("^(" + "|".join(DOC_FILES) + ")") | one_of(ext, DOC_EXTENSIONS), "docs")
        .when(under(DATABASE_FOLDERS) | one_of(ext, DATABASE_EXTENSIONS), "database")
        .when(under(EXAMPLE_FOLDERS), "examples")
        .when(under(FRONTEND_FOLDERS) | one_of(ext, FRONTEND_EXTENSIONS), "frontend")
        .when(under(BACKEND_FOLDERS) | one_of(name, BACKEND_FILES) | stem.rlike("|".join(BACKEND_WORDS)), "backend")
        .when((under(CORE_FOLDERS) & code) | (known & in_core_root) | code, "core")
        .otherwise("uncategorized")
    )
    sure = (under(CORE_FOLDERS) & code) | (known & in_core_root) | (code & (F.size(p) == 1))
    return let(found, lambda domain: F.struct(
        domain.alias("domain"), F.when(domain == "uncategorized", "low").when((domain == "core") & ~sure, "medium").otherwise("high").alias("confidence")))


# Extensions each language front-end takes, in registration order.
LANGUAGE_EXTENSIONS = {
    "python": [".py", ".pyw"],
    "javascript": [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"],
    "java": [".java"],
    "go": [".go"],
    "rust": [".rs"],
    "shell": [".sh", ".bash", ".zsh", ".ksh"],
    "cpp": [".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hxx", ".hh"],
    "tla+": [".tla"],
}


def language_of(path: Column) -> Column:
    """Language by the text after the last dot of the path."""
    ext = F.when(F.contains(path, F.lit(".")), F.lower(F.concat(F.lit("."), F.substring_index(path, ".", -1))))
    out = None
    for lang, exts in LANGUAGE_EXTENSIONS.items():
        out = F.when(ext.isin(exts), lang) if out is None else out.when(ext.isin(exts), lang)
    return out


def has_shell_shebang(content: Column) -> Column:
    """First non-blank line starts with #! and names a shell."""
    first = F.lower(F.regexp_extract(content, r"(?U)^\s*([^\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]*)", 1))
    return first.startswith("#!") & F.contains(first, F.lit("sh"))
