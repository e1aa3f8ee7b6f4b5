"""Straightforward single-machine versions the distributed operators are compared with."""

import re
from zlib import crc32


def closure(edges):
    nodes = {x for e in edges for x in e}
    out = {n: {t for s, t in edges if s == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        reach[n] = seen
    return reach


def scc_of(edges):
    reach = closure(edges)
    return {n: min([m for m in reach[n] if n in reach[m]] + [n]) for n in reach}


def tiers_of(edges):
    scc = scc_of(edges)
    size = {}
    for s in scc.values():
        size[s] = size.get(s, 0) + 1
    dag = {(scc[a], scc[b]) for a, b in edges if scc[a] != scc[b]}
    depth = {}

    def d(s):
        if s not in depth:
            depth[s] = 1 + max((d(t) for a, t in dag if a == s), default=-1)
        return depth[s]

    groups = sorted({(d(s), size[s] > 1, s if size[s] > 1 else "") for s in scc.values()})
    return {n: groups.index((d(s), size[s] > 1, s if size[s] > 1 else "")) for n, s in scc.items()}


def components_of(edges):
    und = edges | {(b, a) for a, b in edges}
    reach = closure(und)
    return {n: min(reach[n] | {n}) for n in reach}


def propagate(repo, nodes, edges):
    und = {n: set() for n in nodes}
    for a, b in edges:
        und[a].add(b)
        und[b].add(a)
    label, turn = {n: n for n in nodes}, 0
    while True:
        turn += 1
        wanted = {}
        for n in nodes:
            votes = {}
            for m in [*und[n], n]:
                votes[label[m]] = votes.get(label[m], 0) + 1
            wanted[n] = min(votes, key=lambda k: (-votes[k], k))
        if wanted == label:
            return label
        label = {n: wanted[n] if crc32(f"{repo}:{n}:{turn}".encode()) % 2 == 0 else label[n] for n in nodes}


def spans_of(lines, symbols):
    words = r"def|fn|func|class|struct|interface|function|public|private|protected|static|void|[A-Z]\w+"
    stops = ("def ", "func ", "fn ", "public ", "class ")
    out = []
    for s in symbols:
        name = s.split(".")[-1]
        for i, line in enumerate(lines):
            if re.search(rf"\b({words})\s+.*\b{re.escape(name)}\b", line) or f" {name}(" in line or f" {name} " in line:
                later = (j for j in range(i + 1, len(lines))
                         if any(o.split(".")[-1] in lines[j] for o in symbols if o != s) and any(k in lines[j] for k in stops))
                out.append((s, i + 1, next(later, len(lines))))
                break
    return out


def windows(start, end, size=40, overlap=8):
    out, s = [], start
    while s <= end:
        e = min(end, s + size - 1)
        out.append((s, e))
        if e >= end:
            break
        s += size - overlap
    return out


def chunks_of(lines, symbols):
    spans = spans_of(lines, symbols)
    covered = {i for _, a, b in spans for i in range(a, b + 1)}
    out = [(a2, b2, s) for s, a, b in spans for a2, b2 in windows(a, b)]
    run = None
    for i in range(1, len(lines) + 2):
        free = i <= len(lines) and i not in covered
        if free and run is None:
            run = i
        if not free and run is not None:
            out += [(a, b, None) for a, b in windows(run, i - 1)]
            run = None
    return sorted(out, key=lambda c: (c[0], c[1], c[2] or ""))
