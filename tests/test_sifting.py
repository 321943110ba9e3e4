"""Sifting by blocks against a plain sift of each whole series."""

import math
import random

import numpy as np
import pytest

from almanac.functions import chains
from almanac.operators import sifting

KEYS = ["station_code", "station"]


def envelope(x, t, y, start, stop):
    """A natural spline by a dense solve, two knots mirrored at either end."""
    t = np.r_[2 * start - t[1], 2 * start - t[0], t, 2 * stop - t[-1], 2 * stop - t[-2]]
    y = np.r_[y[1], y[0], y, y[-1], y[-2]]
    h = np.diff(t)
    a, b = np.eye(len(t)), np.zeros(len(t))
    for i in range(1, len(t) - 1):
        a[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    return chains.spline(x, t, y, np.linalg.solve(a, b))


def plain_modes(v, n, sifts):
    rest, out = np.array(v, float), []
    x = np.arange(1.0, len(v) + 1)
    for _ in range(n):
        h = rest.copy()
        for s in range(sifts):
            top = np.array([i for i in range(1, len(h) - 1) if h[i] > h[i - 1] and h[i] >= h[i + 1]], int)
            low = np.array([i for i in range(1, len(h) - 1) if h[i] < h[i - 1] and h[i] <= h[i + 1]], int)
            if len(top) < 2 or len(low) < 2:
                h = np.zeros(len(h)) if s == 0 else h
                break
            h = h - (envelope(x, x[top], h[top], 1, len(v)) + envelope(x, x[low], h[low], 1, len(v))) / 2
        out.append(h)
        rest = rest - h
    return [*out, rest]


def by_series(df):
    out = {}
    for r in df.orderBy("pos").collect():
        out.setdefault((r.station_code, r.component), []).append((r.pos, r.value, r.series_value))
    return out


@pytest.fixture(scope="module")
def walks():
    rnd = random.Random(1)
    walk = [0.0]
    for _ in range(400):
        walk.append(walk[-1] + rnd.gauss(0, 1))
    gaps = [None if 50 < i < 60 or i % 37 == 0 else v + math.sin(i) for i, v in enumerate(walk)]
    return {1: walk, 2: gaps, 3: [1.0, 2.0, 3.0], 4: [5.0], 5: [2.0] * 50, 6: list(range(40)), 7: [1.0, 3.0, 2.0, 4.0, 1.0, 5.0, 0.0, 2.0], 8: [None] * 4}


@pytest.mark.parametrize("size", [4096, 64, 7])
def test_blocks_of_any_size_give_a_plain_sift(make, walks, size):
    """Also blocks without an extremum, gaps, and series too short or too smooth for an envelope."""
    df = make({(k, "s"): v for k, v in walks.items()})
    got = by_series(sifting.sifted_components(df, n=3, sifts=3, pairs=0, size=size))
    for k, v in walks.items():
        known = [x for x in v if x is not None]
        if not known:
            assert (k, 1) not in got
            continue
        for c, want in enumerate(plain_modes(known, 3, 3), start=1):
            pos, value, own = map(np.array, zip(*got[k, c]))
            assert np.allclose(value, want, atol=1e-9), (k, c)
            assert own.tolist() == known
            assert pos.tolist() == [i + 1 for i, x in enumerate(v) if x is not None]


def test_two_tones_come_apart(make):
    fast = [math.sin(2 * math.pi * i / 8) for i in range(900)]
    slow = [2 * math.sin(2 * math.pi * i / 90 + 1) for i in range(900)]
    got = by_series(sifting.sifted_components(make({(1, "a"): [a + b for a, b in zip(fast, slow)]}), n=2, sifts=8, pairs=0, size=200))
    assert np.corrcoef([v for _, v, _ in got[1, 1]], fast)[0, 1] > 0.99
    assert np.corrcoef([v for _, v, _ in got[1, 2]], slow)[0, 1] > 0.99


def test_members_add_up_to_the_series(make, walks):
    df = make({(1, "a"): walks[1], (2, "b"): walks[2]})
    one = by_series(sifting.sifted_components(df, n=3, sifts=2, pairs=2, size=100))
    for k in (1, 2):
        total = sum(np.array([v for _, v, _ in one[k, c]]) for c in (1, 2, 3, 4))
        assert np.allclose(total, [s for _, _, s in one[k, 1]], atol=1e-9)
    again = by_series(sifting.sifted_components(df.repartition(3), n=3, sifts=2, pairs=2, size=33))
    assert all(np.allclose([v for _, v, _ in one[k]], [v for _, v, _ in again[k]], atol=1e-9) for k in one)


def test_chains_shorten_and_fill_like_one_solve():
    rng = np.random.default_rng(3)
    t, y = np.cumsum(rng.uniform(0.5, 3, 41)), rng.standard_normal(41)
    h = np.diff(t)
    a, b = np.eye(41), np.zeros(41)
    for i in range(1, 40):
        a[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    want = np.linalg.solve(a, b)
    for size in (2, 5, 20, 41):
        cuts = [*range(0, 40, size - 1), 40]
        parts = [(t[i:j + 1], y[i:j + 1]) for i, j in zip(cuts, cuts[1:])]
        tt, yy, n = sifting._padded(parts)
        chain = chains.shorten(tt, yy, n)
        ends = chains.solve_ends(len(cuts), list(zip(chain.d0, chain.u, chain.d1, chain.r0, chain.r1)))
        m = chains.fill(tt, n, chain, ends[:-1], ends[1:])
        got = np.concatenate([m[i, :n[i] - 1] for i in range(len(parts))] + [ends[-1:]])
        assert np.allclose(got, want, atol=1e-10)
