"""Leading eigenpairs of a symmetric matrix that fits one machine (numpy only).

Householder reflections make it tridiagonal, Sturm counts bisect the leading eigenvalues, and
inverse iteration on the tridiagonal matrix finds their vectors; vectors of close eigenvalues are
made orthogonal to each other at every step. The reflections then carry them back.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Eigenvalues nearer than this share of the matrix's norm form a cluster.
CLUSTER = 1e-3
#: Solves for each vector; two bring it to double precision where eigenvalues are apart.
STEPS = 5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, unit vectors of the reflections) of a symmetric matrix.

    Reflection k leaves the first k + 1 places alone.
    """
    a = np.array(matrix, float)
    n, mirrors = len(a), []
    for k in range(n - 2):
        below = a[k + 1 :, k].copy()
        below[0] += np.copysign(np.linalg.norm(below), below[0])
        size = np.linalg.norm(below)
        u = below / size if size > 0 else below
        mirrors.append(u)
        if size > 0:  # (1 - 2uu') block (1 - 2uu') as one update of rank two
            p = a[k + 1 :, k + 1 :] @ u
            w = p - (u @ p) * u
            a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, w) + np.outer(w, u))
            a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
            a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def count_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``x``: the signs of its Sturm sequence."""
    least = np.finfo(float).tiny * max(1.0, float((e**2).max(initial=0.0)))
    below, q = np.zeros(len(x), int), None
    for i in range(len(d)):
        q = d[i] - x - (0.0 if q is None else e[i - 1] ** 2 / q)
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, each bisected until its interval can't be halved."""
    n = len(d)
    reach = np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    slack = 2 * EPS * n * float((np.abs(d) + reach).max()) + np.finfo(float).tiny
    low, high = np.full(k, float((d - reach).min()) - slack), np.full(k, float((d + reach).max()) + slack)
    rank = n - 1 - np.arange(k)  # so many eigenvalues lie below the one that is sought
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return low + (high - low) / 2
        above = count_below(d, e, middle) <= rank
        low, high = np.where(open_ & above, middle, low), np.where(open_ & ~above, middle, high)


def _solver(d: np.ndarray, e: np.ndarray, value: float):
    """Solves (T - value) y = b by elimination with row exchanges."""
    n, norm = len(d), float(np.abs(d).max() + 2 * np.abs(e).max(initial=0.0)) or 1.0
    main, upper, second = d - value, np.append(e, 0.0), np.zeros(n)
    factor, swapped = np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        below = e[i]
        if abs(below) > abs(main[i]):
            swapped[i] = True
            factor[i] = main[i] / below
            main[i], upper[i], second[i], main[i + 1], upper[i + 1] = below, main[i + 1], upper[i + 1], upper[i] - factor[i] * main[i + 1], -factor[i] * upper[i + 1]
        else:
            factor[i] = below / main[i] if main[i] else 0.0
            main[i + 1] -= factor[i] * upper[i]
    main = np.where(np.abs(main) < EPS * norm, np.copysign(EPS * norm, main), main)

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i] - factor[i] * y[i + 1]
            else:
                y[i + 1] -= factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            rest = (upper[i] * y[i + 1] if i + 1 < n else 0.0) + (second[i] * y[i + 2] if i + 2 < n else 0.0)
            y[i] = (y[i] - rest) / main[i]
        return y

    return solve


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as rows): the first ``k`` pairs, or all of a smaller matrix.

    Vectors of equal eigenvalues are some orthonormal basis of their space. The sign of a vector
    makes its largest entry positive. An empty matrix has no pairs.
    """
    n = len(matrix)
    k = min(k, n)
    if not k:
        return np.zeros(0), np.zeros((0, n))
    scale = float(np.abs(matrix).max()) or 1.0
    d, e, mirrors = tridiagonal(np.asarray(matrix, float) / scale)
    values = leading_values(d, e, k)
    norm = float(np.abs(d).max() + 2 * np.abs(e).max(initial=0.0)) or 1.0
    found = np.zeros((k, n))
    rng = np.random.default_rng(11)
    begin, shift = 0, float("inf")
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * norm:
            begin = j
        # solves at one and the same shift would return the same vector again
        shift = min(values[j], shift - 10 * EPS * norm) if j > begin else values[j]
        solve, y = _solver(d, e, shift), rng.standard_normal(n)
        for _ in range(STEPS):
            y = solve(y / np.linalg.norm(y))
            for _ in range(2):
                y -= found[begin:j].T @ (found[begin:j] @ y)
        found[j] = y / np.linalg.norm(y)
    for m in range(len(mirrors) - 1, -1, -1):
        found[:, m + 1 :] -= 2 * np.outer(found[:, m + 1 :] @ mirrors[m], mirrors[m])
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    found *= np.sign(found[np.arange(k), np.abs(found).argmax(axis=1)])[:, None]
    return values * scale, found
