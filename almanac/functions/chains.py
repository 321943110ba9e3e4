"""Chains of knots of a spline, shortened to their ends and filled in again.

The curvatures at the knots of a spline solve a symmetric tridiagonal system: two neighbours at a
distance h with a slope s between them add ``own`` h to both diagonals, h beside them, and ``by`` s and
-``by`` s to the right sides (2 and 6 for cubic pieces between the knots, 3 and 4 for quadratic ones
that meet midway). A chain of knots between two ends acts on the ends only through three
coefficients and two right sides:

    d0 * first + u * last = r0,    u * first + d1 * last = r1

Chains that share an end are joined by eliminating it, so a chain may be cut into blocks, each
block shortened alone, the blocks' ends solved, and each block filled in alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Chain(NamedTuple):
    """What is left of a chain, one value per chain, and what filling in again needs, one column per inner knot."""
    d0: np.ndarray
    u: np.ndarray
    d1: np.ndarray
    r0: np.ndarray
    r1: np.ndarray
    pivots: np.ndarray
    couplings: np.ndarray
    rights: np.ndarray


CUBIC = (2, 6)
QUADRATIC = (3, 4)


def shorten(t: np.ndarray, y: np.ndarray, n: np.ndarray, kind: tuple[int, int] = CUBIC) -> Chain:
    """Eliminate the inner knots of many chains at once: row i has ``n[i]`` knots, two at least, in its first columns."""
    rows, width = t.shape
    own, by = kind
    h = np.diff(t, axis=1)
    s = by * np.diff(y, axis=1) / np.where(h > 0, h, 1.0)
    d0, u, d1 = own * h[:, 0], h[:, 0].copy(), own * h[:, 0]
    r0, r1 = s[:, 0].copy(), -s[:, 0]
    pivots, couplings, rights = np.ones((rows, width)), np.zeros((rows, width)), np.zeros((rows, width))
    for j in range(1, width - 1):
        on = n > j + 1
        if not on.any():
            break
        gap, slope = h[:, j], s[:, j]
        pivot = np.where(on, d1 + own * gap, 1.0)
        right = r1 + slope
        pivots[:, j], couplings[:, j], rights[:, j] = pivot, np.where(on, u, 0.0), np.where(on, right, 0.0)
        d0 = np.where(on, d0 - u * u / pivot, d0)
        r0 = np.where(on, r0 - u * right / pivot, r0)
        r1 = np.where(on, -slope - gap * right / pivot, r1)
        d1 = np.where(on, own * gap - gap * gap / pivot, d1)
        u = np.where(on, -u * gap / pivot, u)
    return Chain(d0, u, d1, r0, r1, pivots, couplings, rights)


def fill(t: np.ndarray, n: np.ndarray, chain: Chain, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Curvatures at all knots, given those at both ends."""
    m = np.zeros(t.shape)
    rows = np.arange(len(t))
    m[:, 0] = first
    m[rows, n - 1] = last
    h = np.diff(t, axis=1)
    for j in range(t.shape[1] - 2, 0, -1):
        on = n > j + 1
        if on.any():
            inner = (chain.rights[:, j] - chain.couplings[:, j] * first - h[:, j] * m[:, j + 1]) / chain.pivots[:, j]
            m[:, j] = np.where(on, inner, m[:, j])
    return m


def solve_ends(k: int, links: list[tuple[float, float, float, float, float]], ends: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """Curvatures at the ``k`` knots of a series.

    ``links`` are the coefficients (d0, u, d1, r0, r1) of what lies between one knot and the next. ``ends`` are a
    diagonal and a right side added to the first and to the last knot; without them both curvatures are zero.
    """
    diagonal, right, upper = np.zeros(k), np.zeros(k), np.zeros(k)
    for i, (d0, u, d1, r0, r1) in enumerate(links):
        diagonal[i] += d0
        diagonal[i + 1] += d1
        right[i] += r0
        right[i + 1] += r1
        upper[i] = u
    lower = upper.copy()
    if ends is None:
        diagonal[[0, -1]], right[[0, -1]] = 1.0, 0.0
        upper[0] = lower[k - 2] = 0.0
    else:
        diagonal[0] += ends[0]
        right[0] += ends[1]
        diagonal[-1] += ends[2]
        right[-1] += ends[3]
    for i in range(1, k):
        factor = lower[i - 1] / diagonal[i - 1]
        diagonal[i] -= factor * upper[i - 1]
        right[i] -= factor * right[i - 1]
    m = np.zeros(k)
    m[-1] = right[-1] / diagonal[-1]
    for i in range(k - 2, -1, -1):
        m[i] = (right[i] - upper[i] * m[i + 1]) / diagonal[i]
    return m


def gap(t0: float, y0: float, t1: float, y1: float) -> tuple[float, float, float, float, float]:
    """The link of two neighbouring knots."""
    h, s = t1 - t0, 6 * (y1 - y0) / (t1 - t0)
    return 2 * h, h, 2 * h, s, -s


def spline(x: np.ndarray, t: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The cubic through the knots around every ``x``."""
    i = np.clip(np.searchsorted(t, x, side="right") - 1, 0, len(t) - 2)
    h = t[i + 1] - t[i]
    a, b = (t[i + 1] - x) / h, (x - t[i]) / h
    return a * y[i] + b * y[i + 1] + ((a ** 3 - a) * m[i] + (b ** 3 - b) * m[i + 1]) * h * h / 6
