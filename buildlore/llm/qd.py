"""Singular values and right singular vectors of a small upper triangular matrix by qd algorithms.

Householder reflections from both sides make the matrix bidiagonal; dqds finds the singular values of each unreduced block, to high relative
accuracy, since it only adds, multiplies and divides positive numbers but for its shifts; and a vector comes from the twisted factorisation of
B'B less the value's square, at the twist where the factorisation is closest to singular. Vectors of values that nearly agree come from inverse
iteration, kept orthogonal, and Jacobi rotations of the matrix's own columns part them.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
TINY = 1e-290
CLOSE = 1e-5  # values this near to one another, relatively, are a cluster


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, V): r = U B V' with V orthogonal; U is not kept."""
    a = np.array(r, np.float64)
    n = a.shape[1]
    v = np.eye(n)
    for k in range(n):
        w = _reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= np.outer(w, 2.0 * (w @ a[k:, k:]))
        if k < n - 2:
            w = _reflector(a[k, k + 1 :])
            if w is not None:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ w, 2.0 * w)
                v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ w, 2.0 * w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector of the reflection that takes x to a multiple of its first axis."""
    top = np.abs(x).max(initial=0.0)
    if len(x) < 2 or not np.abs(x[1:]).max() > 0:
        return None
    w = x / top
    w[0] += np.copysign(np.linalg.norm(w), w[0])
    return w / np.linalg.norm(w)


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd step with a shift: the new q and e, and the d that tell whether the shift was too large."""
    d, qs, es, ds = q[0] - shift, [], [], [q[0] - shift]
    for k in range(len(q) - 1):
        new = d + e[k]
        if new == 0.0:
            new = TINY
        t = q[k + 1] / new
        qs.append(new)
        es.append(e[k] * t)
        d = d * t - shift
        ds.append(d)
    qs.append(d)
    return qs, es, ds


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    open_blocks = [(((diagonal / scale) ** 2).tolist(), ((upper / scale) ** 2).tolist(), 0.0)]
    while open_blocks:
        q, e, sigma = open_blocks.pop()
        for _ in range(100 * len(q) + 100):
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * (sigma + min(q[k], q[k + 1])) or e[k] < TINY), None)
            if cut is not None:
                open_blocks.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
            if len(q) == 1:
                found.append(sigma + max(q[0], 0.0))
                break
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            for shift in _shifts(q, e):
                qs, es, ds = _sweep(q, e, shift)
                if min(ds) >= 0.0:
                    break
            q, e, sigma = qs, es, sigma + shift
        else:
            raise ArithmeticError("the qd iteration does not end")
    return np.array(sorted(found, reverse=True)) * scale * scale


def _shifts(q: list[float], e: list[float]):
    """Shifts to try in turn: the smaller eigenvalue of the last corner, a sure lower bound of the smallest value, none."""
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), (q[-2] * e[-1]) ** 0.5, q[-1] + e[-1]
    half = 0.5 * (a - c)
    root = (half * half + b * b) ** 0.5
    corner = c - b * b / (half + root) if half >= 0 else c + half - root
    if corner > 0:
        yield corner * (1.0 - 4.0 * EPS) if corner < q[-1] else q[-1] * (1.0 - 1e-3)
    _, _, ds = _sweep(q, e, 0.0)
    if min(ds) > 0.0:
        yield 0.98 / sum(1.0 / d for d in ds)  # 1/d are the diagonal of the inverse
    yield 0.0


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """A vector of LDL' (low: L's lower diagonal) for an eigenvalue, and what the Rayleigh quotient adds to the value."""
    n = len(d)
    s, p = np.empty(n), np.empty(n)
    plus, minus = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        at = s[i] + d[i] or TINY
        plus[i] = d[i] * low[i] / at
        s[i + 1] = plus[i] * low[i] * s[i] - value
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        at = d[i] * low[i] * low[i] + p[i + 1] or TINY
        t = d[i] / at
        minus[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    k = int(np.nanargmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -minus[i] * z[i]
    size = z @ z
    return z / np.sqrt(size), float(gamma[k] / size)


def _vector(d: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    z, more = _twisted(d, low, value)
    if abs(more) < 1e-6 * value:
        again, _ = _twisted(d, low, value + more)
        if np.isfinite(again).all():
            z = again
    return z


def _cluster(d: np.ndarray, low: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthogonal vectors for eigenvalues that nearly agree, a column each: they span the right space, in no order."""
    n, draw = len(d), np.random.default_rng(7)
    main, side = d + np.r_[0.0, d[:-1] * low * low], d[:-1] * low
    out = np.zeros((n, len(values)))
    for k, value in enumerate(values):
        x = draw.standard_normal(n)
        for _ in range(4):
            for _ in range(2):
                x -= out[:, :k] @ (out[:, :k].T @ x)
            x = _solved(main - value * (1.0 + 2.0 * EPS), side, x / np.linalg.norm(x))
        for _ in range(2):
            x -= out[:, :k] @ (out[:, :k].T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def _solved(main: np.ndarray, side: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The solution of a symmetric tridiagonal system, by elimination with row exchanges."""
    n = len(main)
    low = [*side.tolist(), 0.0]
    rows = [[main[i], side[i] if i < n - 1 else 0.0, 0.0] for i in range(n)]
    y = x.tolist()
    for i in range(n - 1):
        below = [low[i], rows[i + 1][0], rows[i + 1][1]]
        if abs(below[0]) > abs(rows[i][0]):
            rows[i], below = below, rows[i]
            y[i], y[i + 1] = y[i + 1], y[i]
        t = below[0] / (rows[i][0] or EPS * EPS)
        rows[i + 1] = [below[1] - t * rows[i][1], below[2] - t * rows[i][2], 0.0]
        y[i + 1] -= t * y[i]
    for i in range(n - 1, -1, -1):
        rest = sum(rows[i][j] * y[i + j] for j in (1, 2) if i + j < n)
        y[i] = (y[i] - rest) / (rows[i][0] or EPS * EPS)
    out = np.array(y)
    return out / np.linalg.norm(out)


def _part(r: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rotations of the columns of `w` after which the columns of r w are orthogonal, the longest first."""
    m, w = r @ w, w.copy()
    for _ in range(30):
        moved = 0.0
        for i in range(w.shape[1]):
            for j in range(i + 1, w.shape[1]):
                a, b, c = m[:, i] @ m[:, i], m[:, j] @ m[:, j], m[:, i] @ m[:, j]
                if a == 0.0 or b == 0.0 or abs(c) <= EPS * np.sqrt(a * b):
                    continue
                moved = max(moved, abs(c) / np.sqrt(a * b))
                zeta = (b - a) / (2.0 * c)
                t = np.copysign(1.0, zeta) / (abs(zeta) + np.hypot(1.0, zeta))
                cos = 1.0 / np.hypot(1.0, t)
                sin = cos * t
                for x in (m, w):
                    x[:, i], x[:, j] = cos * x[:, i] - sin * x[:, j], sin * x[:, i] + cos * x[:, j]
        if moved <= 4 * EPS:
            break
    return w[:, np.argsort(-(m * m).sum(axis=0), kind="stable")]


def singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of the largest singular values, falling; their right singular vectors as rows): `most` at most, and none that is zero to rounding."""
    n = r.shape[1]
    top = np.abs(r).max(initial=0.0)
    if not n or top == 0.0:
        return np.zeros(0), np.zeros((0, n))
    r = np.vstack([r, np.zeros((max(0, n - len(r)), n))]) / top
    diagonal, upper, v = bidiagonal(r)
    large = max(np.abs(diagonal).max(), np.abs(upper).max(initial=0.0))
    cuts = [0, *(np.flatnonzero(np.abs(upper) <= EPS * (np.abs(diagonal[:-1]) + np.abs(diagonal[1:]))) + 1).tolist(), n]
    told = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        told += [(value, a, b) for value in dqds(diagonal[a:b], upper[a : b - 1])]
    told.sort(key=lambda t: -t[0])
    told = [t for t in told if t[0] > (8.0 * n * EPS) ** 2 * told[0][0]]
    # a cluster that the bound cuts is solved whole
    last = min(most, len(told))
    while 0 < last < len(told) and told[last][0] > told[last - 1][0] * (1.0 - CLOSE):
        last += 1
    told = told[:last]
    values, vectors = np.array([t[0] for t in told]), np.zeros((len(told), n))
    safe = np.where(np.abs(diagonal) < 1e-20 * large, 1e-20 * large, diagonal)
    done = set()
    for k, (value, a, b) in enumerate(told):
        if k in done:
            continue
        group, near = [k], value
        for j in range(k + 1, len(told)):
            if told[j][0] < near * (1.0 - CLOSE):
                break
            near = told[j][0]
            if told[j][1] == a:
                group.append(j)
        done.update(group)
        d, low = safe[a:b] ** 2, upper[a : b - 1] / safe[a : b - 1]
        z = _vector(d, low, value)[:, None] if len(group) == 1 else _cluster(d, low, values[group])
        vectors[group, a:b] = z.T
    vectors = vectors @ v.T
    start = 0
    while start < len(told):  # neighbours that nearly agree are parted by the matrix itself
        stop = start + 1
        while stop < len(told) and values[stop] > values[stop - 1] * (1.0 - CLOSE):
            stop += 1
        if stop - start > 1:
            vectors[start:stop] = _part(r, np.linalg.qr(vectors[start:stop].T)[0]).T
            values[start:stop] = ((r @ vectors[start:stop].T) ** 2).sum(axis=0)
        start = stop
    vectors = vectors[:most]
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return values[:most] * top * top, vectors * sign[:, None]
