"""FEAST: eigenpairs of a symmetric matrix by contour integration, with inertia counts.

The inertia of V - s*I (signs of the pivots of its symmetric indefinite factorisation) says how many
eigenvalues lie below s.  Bisection on these counts cuts the wanted top of the spectrum into intervals
of few eigenvalues.  For an interval, a quadrature over the circle around it of the complex shifted
solves (z*I - V)^-1 Y projects a random block Y onto its eigenvectors; Rayleigh-Ritz on the projected
block gives eigenpairs, which are the next Y until their residuals are at rounding level.  An interval
whose pairs are not as many as its inertia count is solved again with a larger block; none is missed.
"""

from __future__ import annotations

import numpy as np

#: Quadrature nodes of the half circle (the other half is conjugate).
NODES = 8
#: Eigenvalues of an interval, unless they cannot be told apart.
INTERVAL = 6
ROUNDS = 40


def below(v: np.ndarray, s: float) -> int:
    """Eigenvalues of ``v`` smaller than ``s``: negative pivots of a symmetric factorisation with
    1x1 and 2x2 pivots (Bunch and Kaufman)."""
    a = v - s * np.eye(len(v))
    count, alpha = 0, (1 + np.sqrt(17)) / 8
    while (n := len(a)) > 0:
        if n == 1:
            return count + int(a[0, 0] < 0)
        col = np.abs(a[1:, 0])
        r = 1 + int(col.argmax())
        lam = col[r - 1]
        size = 1
        if lam > 0 and abs(a[0, 0]) < alpha * lam:
            row = np.abs(a[:, r])
            row[r] = 0
            sigma = row.max()
            if abs(a[0, 0]) * sigma < alpha * lam * lam:
                if abs(a[r, r]) >= alpha * sigma:
                    a[[0, r]] = a[[r, 0]]
                    a[:, [0, r]] = a[:, [r, 0]]
                else:
                    a[[1, r]] = a[[r, 1]]
                    a[:, [1, r]] = a[:, [r, 1]]
                    size = 2
        if size == 1:
            d = a[0, 0]
            count += int(d < 0)
            a = a[1:, 1:] - (np.outer(a[1:, 0], a[0, 1:]) / d if d != 0 else 0)
        else:
            p = a[:2, :2]
            det = p[0, 0] * p[1, 1] - p[0, 1] * p[1, 0]
            count += 1 if det < 0 else 2 * int(p[0, 0] < 0)
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(p, a[:2, 2:])
    return count


def intervals(v: np.ndarray, k: int, most: int = INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, count) of adjoining intervals from the top on that hold the ``k`` largest
    eigenvalues, or more where some cannot be told apart; no border lies close to an eigenvalue
    where a gap is there to put it in."""
    n = len(v)
    reach = float(np.abs(v).sum(axis=1).max()) or 1.0
    floor = reach * 1e-14 * n

    def cut(target: int, low: float, high: float) -> tuple[float, int]:
        """A border above which at least ``target`` eigenvalues lie, as few as can be, amid a gap."""
        above = n
        while high - low > floor:
            mid = (low + high) / 2
            c = n - below(v, mid)
            if c >= target:
                low, above = mid, c
            else:
                high = mid
        # low: just below an eigenvalue; go down to the middle of the gap beneath it
        a, b = -reach * 1.01, low
        while b - a > floor and (b - a) > 1e-3 * abs(low - a):
            mid = (a + b) / 2
            if n - below(v, mid) > above:
                a = mid
            else:
                b = mid
        return (a + low) / 2 if n - below(v, (a + low) / 2) == above else low, above

    out, high, done = [], reach * 1.01, 0
    while done < min(k, n):
        low, above = cut(min(done + most, k, n), -reach * 1.01, high)
        out.append((low, high, above - done))
        high, done = low, above
    return out


def _project(v: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """The quadrature of the resolvent around [low, high], applied to ``y``."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    mid, r, eye, out = (low + high) / 2, (high - low) / 2, np.eye(len(v)), np.zeros_like(y)
    for t, g in zip(x, w, strict=True):
        turn = np.exp(1j * np.pi * (1 + t) / 2)
        out += (g / 2 * r * turn * np.linalg.solve((mid + r * turn) * eye - v, y.astype(complex))).real
    return out


def _interval(v: np.ndarray, low: float, high: float, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of [low, high]."""
    n, rng, scale = len(v), np.random.default_rng(seed), float(np.abs(v).sum(axis=1).max())
    m = min(n, count + max(4, count // 2))
    while True:
        y = rng.standard_normal((n, m))
        worst = np.inf
        for _ in range(ROUNDS):
            q, _ = np.linalg.qr(_project(v, y, low, high))
            e, u = np.linalg.eigh(q.T @ v @ q)
            y = q @ u
            inside = np.flatnonzero((e > low) & (e <= high))
            if len(inside) == count:
                res = np.linalg.norm(v @ y[:, inside] - y[:, inside] * e[inside], axis=0).max(initial=0)
                if res <= 1e-14 * scale * np.sqrt(n) or (res <= 1e-11 * scale and res >= worst / 2):
                    return e[inside], y[:, inside]
                worst = min(worst, res)
        if m == n:
            raise ArithmeticError(f"eigenvalues in [{low}, {high}] are missed: {len(inside)} found, inertia says {count}")
        m = min(n, 2 * m)


def largest(v: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``k`` largest eigenvalues, falling.  Signs:
    the entry largest in size is positive."""
    n = len(v)
    k = min(k, n)
    if not k or not np.any(v):
        return np.zeros(k), np.eye(n)[:, :k]
    scale = float(np.abs(v).max())
    w = v / scale
    found = [_interval(w, a, b, c, seed + i) for i, (a, b, c) in enumerate(intervals(w, k))]
    # one Rayleigh-Ritz over all of them: orthogonal across the borders, too
    q, _ = np.linalg.qr(np.concatenate([u for _, u in found], axis=1))
    e, u = np.linalg.eigh(q.T @ w @ q)
    order = np.argsort(-e, kind="stable")[:k]
    vec = (q @ u)[:, order]
    vec = vec / np.linalg.norm(vec, axis=0)
    big = np.abs(vec).argmax(axis=0)
    return e[order] * scale, vec * np.where(vec[big, np.arange(k)] < 0, -1.0, 1.0)


__all__ = ["below", "intervals", "largest"]
