"""The views of `plans/views.py` in SQL, and `with_views` to put the ones a query needs in front of it."""

from __future__ import annotations

from buildlore.plans.views import CODE_DIRECTORIES, CODE_SUFFIXES, DIRECTORIES, NOW, REPO_NOW, SUFFIXES

LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
WORD_BREAK = r"[^\p{L}\p{N}_]+"
NOW_SQL = f"TIMESTAMP '{NOW}'"
REPO_NOW_SQL = f"TIMESTAMP '{REPO_NOW}'"


def text_list(values: list[str]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def text_set(values: list[str]) -> str:
    return "(" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def lines_sql(c: str) -> str:
    split = f"regexp_split_to_array({c}, '{LINE_BREAK}')"
    return f"(CASE WHEN {split}[-1] = '' THEN {split}[1:len({split})-1] ELSE {split} END)"


def lit(text: str) -> str:
    """A string literal with real line feeds."""
    return "'" + text.replace("'", "''") + "'"


_K = "CAST(n // 16 * 8 + n % 8 AS VARCHAR)"
_S = "CAST(n AS VARCHAR)"


def _rows(*parts: str) -> str:
    return " || ".join(_K if p == "K" else _S if p == "S" else lit(p) for p in parts)


_CODE_TEXT = f"""CASE n % 8
 WHEN 0 THEN {_rows("import os" + chr(10) + "import m", "K", chr(10) + "from pkg.m", "K", " import value, other" + chr(10) + "from lib.m", "K", " import *" + chr(10) + "try:" + chr(10) + "    import json" + chr(10) + "except ImportError:" + chr(10) + "    json = None" + chr(10) + 'x = __import__("m', "K", '")' + chr(10) + "class C", "S", ":" + chr(10) + "    def run(self):" + chr(10) + "        return 1" + chr(10) + "def main():" + chr(10) + "    pass" + chr(10))} || CASE WHEN n % 56 = 48 THEN {lit("def broken(:" + chr(10))} ELSE '' END
 WHEN 1 THEN {_rows("#!/bin/bash" + chr(10) + "# source ./ignored.sh" + chr(10) + "source ./m", "K", ".sh" + chr(10) + ". ../pkg/m", "K", ".sh" + chr(10) + 'source "$DIR/env.sh"' + chr(10) + "bash ./m", "K", ".sh --flag" + chr(10) + "./run.sh now" + chr(10) + "echo done" + chr(10))}
 WHEN 2 THEN {_rows("#include <stdio.h>" + chr(10) + '#include "m', "K", '.c"' + chr(10) + '  #  include "vector"' + chr(10) + '#include "sub/x.h"' + chr(10))}
 WHEN 3 THEN {_rows("---- MODULE m", "S", " ----" + chr(10) + "EXTENDS Naturals, " + chr(92) + "* base" + chr(10) + "  m", "K", "," + chr(10) + "  Sequences" + chr(10) + "VARIABLES x" + chr(10) + "====" + chr(10))}
 WHEN 4 THEN {_rows("import java.util.List;" + chr(10) + "import pkg.m", "K", ";" + chr(10) + "import lib.*;" + chr(10) + 'class A { Object o = Class.forName("src.core.m', "K", '"); }' + chr(10))}
 WHEN 5 THEN {_rows("import a from './m", "K", "'" + chr(10))}
 WHEN 6 THEN {_rows('import "example.com/app/lib"' + chr(10))}
 ELSE {_rows("use crate::m", "K", ";" + chr(10))} END"""

_MARK = "['# ','# ','// ','" + chr(92) + "* ','// ','// ','// ','// '][n % 8 + 1]"
_NL = "chr(10)"

VIEWS: dict[str, tuple[list[str], str]] = {
    "files": ([], f"""SELECT repo_id, n, doc_id,
        {text_list(DIRECTORIES)}[(n % 11) + 1] || 'f' || n || {text_list(SUFFIXES)}[(doc_id % 8) + 1] AS path,
        n_chars AS size_bytes, text AS content, lang
      FROM (SELECT source AS repo_id, doc_id, text, lang, n_chars,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)"""),
    "numbered_edges": (["files"], """SELECT DISTINCT e.repo_id, e.s AS n, e.t, a.path AS source, b.path AS target FROM (
        SELECT repo_id, n AS s, n // 2 AS t FROM files WHERE n > 0 AND n % 7 <> 0
        UNION ALL SELECT repo_id, n, n - 3 FROM files WHERE n >= 3 AND n % 3 = 0 AND n % 7 <> 0
        UNION ALL SELECT repo_id, n, n + 1 FROM files WHERE n % 10 = 5
        UNION ALL SELECT repo_id, n, n - 1 FROM files WHERE n % 10 = 6) e
      JOIN files a ON a.repo_id = e.repo_id AND a.n = e.s
      JOIN files b ON b.repo_id = e.repo_id AND b.n = e.t WHERE e.s <> e.t"""),
    "edges": (["numbered_edges"], "SELECT repo_id, source, target FROM numbered_edges"),
    "raw_edges": (["numbered_edges"], r"""SELECT DISTINCT repo_id, source, CASE n % 4 WHEN 0 THEN target
        WHEN 1 THEN regexp_replace(target, '\.[^./]*$', '') WHEN 2 THEN regexp_replace(target, '^.*/', '')
        ELSE regexp_replace(target, '/[^/]*$', '') END AS target FROM numbered_edges"""),
    "symbols": (["files"], f"""SELECT repo_id, path, symbol, row_number() OVER (PARTITION BY repo_id, path ORDER BY symbol) - 1 AS pos FROM (SELECT repo_id, path, unnest(list_distinct(list_filter(
        regexp_split_to_array(content, '{WORD_BREAK}'), lambda w: length(w) >= 3))) AS symbol FROM files)"""),
    "code": (["files"], f"""SELECT repo_id, n,
        {text_list(CODE_DIRECTORIES)}[n % 3 + 1] || '/m' || n || {text_list(CODE_SUFFIXES)}[n % 8 + 1] AS path,
        ({_CODE_TEXT}) || {_MARK} || replace(array_to_string(regexp_split_to_array(content, '{LINE_BREAK}'), {_NL} || '@mark@'), '@mark@', {_MARK}) || {_NL} AS content
      FROM files"""),
    "manifests": (["files"], f"""SELECT repo_id, repeat('d/', n % 4) || 'x' || n ||
        CASE WHEN n % 25 = 6 THEN '/go.mod' ELSE '/Cargo.toml' END AS path,
        CASE WHEN n % 25 = 6 THEN {lit("// generated" + chr(10) + "module example.com/app")} || n || {lit(" " + chr(10) + "go 1.22" + chr(10))}
          ELSE {lit("[workspace]" + chr(10) + 'name = "outer"' + chr(10) + "[package]" + chr(10) + 'name = "crate')} || n || {lit('"' + chr(10) + "[lib]" + chr(10) + 'name = "x"' + chr(10))} END AS content
      FROM files WHERE n % 25 IN (6, 7)"""),
    "changes": ([], """SELECT l_orderkey AS commit_no, l_linenumber AS line_no, l_shipdate AS ts, 'f' || l_partkey AS path,
        CASE WHEN l_returnflag = 'R' THEN 'f' || (l_partkey % 500 + 1) END AS old_path FROM lineitem"""),
    "ledger": ([], """SELECT event_id AS id, user_id, ts AS created_at,
        CASE event_type WHEN 'purchase' THEN CAST(floor(value) AS INT) ELSE -CAST(floor(value / 4) AS INT) END AS points,
        CASE event_type WHEN 'error' THEN 'redemption_quota_bump_2' ELSE 'milestone_solved_no_hints' END AS reason,
        event_id % 40 AS job_id FROM events WHERE event_type IN ('purchase', 'error')"""),
    "attempts": ([], """SELECT event_id, user_id, event_id % 40 AS job_id, event_id % 6 AS milestone_tier, ts,
        CAST(json_extract(props, '$.k') AS INT) % 3 AS hint_level, CAST(json_extract(props, '$.k') AS INT) % 10 = 0 AS revealed,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 'structurally_verified' ELSE 'attempting' END AS status,
        event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events"""),
    "requests": ([], "SELECT event_id, user_id % 15 AS key, epoch_us(ts) / 1e6 / 600.0 AS t FROM events"),
    "layer_metrics": ([], """SELECT event_id AS run_id, event_type AS layer, value AS duration_ms,
        CASE WHEN event_id % 17 = 0 THEN 'failed' ELSE 'success' END AS status FROM events"""),
    "repos": ([], """SELECT o_orderkey AS id, 'https://github.com/Owner' || (o_custkey % 50) || '/repo' || o_custkey ||
        ['', '/', '.git', ''][o_orderkey % 4 + 1] AS github_url, 'c' || (o_orderkey % 3) AS commit_hash,
        CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'processing' END AS status,
        o_orderdate AS created_at, o_orderdate + INTERVAL 30 DAY AS expires_at, o_orderkey % 9 = 0 AS keep_longer,
        CASE o_orderkey % 5 WHEN 0 THEN 'packages/api' WHEN 1 THEN '' END AS subpath, o_custkey AS user_id FROM orders"""),
    "users": ([], "SELECT c_custkey AS id, c_name AS username FROM customer"),
    "subscriptions": ([], f"""SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing'
        WHEN 2 THEN 'canceled' ELSE 'past_due' END AS status,
        CASE WHEN c_custkey % 5 <> 0 THEN {NOW_SQL} + to_days(CAST(c_custkey % 60 - 30 AS INT)) END AS current_period_end
      FROM customer WHERE c_custkey % 3 <> 0"""),
    "usage": ([], """SELECT event_id AS id, user_id,
        CASE WHEN event_type IN ('view', 'click') THEN 'repo_analysis' ELSE event_type END AS event_type, ts AS created_at
      FROM events"""),
}

_JOB_NODE = """'{"id": "src/a{i}.py", "tier": ' || ((o_orderkey + {i}) % 3) || ', "domain": "core", "exports": ["Foo' || o_orderkey || '", "bar{i}"], "source_code": "' || repeat('x = 1\\n', o_orderkey % 100) || '"}'"""
_JOB_NODES = "'\"nodes\": [' || " + " || ', ' || ".join(_JOB_NODE.replace("{i}", str(i)) for i in range(3)) + " || ']'"
VIEWS["jobs"] = ([], f"""SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS status, o_orderdate AS created_at,
    CASE o_orderkey % 6 WHEN 0 THEN '{{"architecture_overview": {{"total_files": ' || (o_orderkey % 50) || ', "total_loc": ' || (o_orderkey % 1000) || '}}, "total_files": 7, "total_loc": 99, ' || {_JOB_NODES} || '}}'
      WHEN 1 THEN '{{"total_files": ' || (o_orderkey % 20) || ', "total_loc": ' || (o_orderkey % 500) || ', "nodes": []}}' WHEN 2 THEN '{{' || {_JOB_NODES} || '}}' WHEN 3 THEN '{{}}' WHEN 5 THEN 'not json' END AS graph_json,
    CASE WHEN o_orderkey % 2 = 1 THEN '- **Total Analyzed Files**: `' || (o_orderkey % 90) || '`' || chr(10) || '### Milestone 1: a' || chr(10) || '### Milestone 2: b' || chr(10) END AS markdown FROM orders""")


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Put the named views, and the ones they stand on, in front of a query that starts with SELECT or more CTEs."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    # splitting all texts into words is done once, however often a query reads them
    ctes = ",\n".join(f"{name} AS {'MATERIALIZED ' if name == 'symbols' else ''}({VIEWS[name][1]})" for name in order)
    body = body.strip()
    rest = ",\n" + body[5:].lstrip() if body.upper().startswith("WITH ") else "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{rest}"
