"""Orders on simulated series, and the two regressions against direct ones."""

import random

import numpy as np
import pytest

from almanac.operators import arma


def simulated(rnd, n, ar=(), ma=()):
    x, e = [0.0] * 5, [0.0] * 5
    for _ in range(n + 200):
        e.append(rnd.gauss(0, 1))
        x.append(sum(a * x[-1 - i] for i, a in enumerate(ar)) + e[-1] + sum(b * e[-2 - i] for i, b in enumerate(ma)))
    return [10 + v for v in x[-n:]]


MODELS = {(0, 0): {}, (1, 0): {"ar": (0.7,)}, (2, 0): {"ar": (0.5, -0.4)}, (0, 1): {"ma": (0.7,)}, (1, 1): {"ar": (0.8,), "ma": (0.6,)},
          (3, 0): {"ar": (0.3, -0.3, 0.5)}, (0, 2): {"ma": (0.5, 0.6)}}


def test_the_right_order_is_found(make):
    rnd = random.Random(12)
    series = {(1000 * i + k, "s"): simulated(rnd, 2500, **spec) for i, spec in enumerate(MODELS.values()) for k in range(8)}
    got = arma.arma_order_selection(make(series)).collect()
    right = sum(list(MODELS)[r.station_code // 1000] == (r.p, r.q) for r in got)
    assert len(got) == len(series) and all(r.tried == 16 for r in got)
    assert right >= 0.9 * len(series), right


def test_sums_give_the_regressions(make):
    """Also where the series is longer than a block, and coefficients come near those simulated."""
    rnd = random.Random(2)
    v = simulated(rnd, 5000, ar=(0.8,), ma=(0.5,))
    got = {(r.p, r.q): r for r in arma.arma_orders(make({(1, "a"): v})).collect()}
    x = np.array(v) - np.mean(v)
    g = np.array([(x[k:] * x[:len(x) - k]).sum() / len(x) for k in range(arma.LONG + 1)])
    toeplitz = g[np.abs(np.subtract.outer(range(arma.LONG), range(arma.LONG)))]
    a = np.linalg.solve(toeplitz, g[1:])
    assert np.allclose(arma.levinson(g[None])[0], a, atol=1e-9)
    e = np.full(len(x), np.nan)
    for t in range(arma.LONG, len(x)):
        e[t] = x[t] - a @ x[t - arma.LONG:t][::-1]
    at = np.arange(arma.LONG + 3, len(x))
    for p in range(4):
        for q in range(4):
            design = np.stack([x[at - k] for k in range(1, p + 1)] + [e[at - k] for k in range(1, q + 1)] or [np.zeros(len(at))], axis=1)
            beta = np.linalg.lstsq(design, x[at], rcond=None)[0]
            assert got[p, q].sigma2 == pytest.approx(((x[at] - design @ beta) ** 2).mean(), rel=1e-8)
            assert got[p, q].n == len(at)
    assert np.allclose([*got[1, 1].ar, *got[1, 1].ma], [0.8, 0.5], atol=0.06)


def test_short_and_flat_series(make):
    got = arma.arma_orders(make({(1, "short"): [1.0, 2.0] * 5, (2, "flat"): [3.0] * 80, (3, "ok"): [float(i % 7) for i in range(90)]})).collect()
    assert {r.station_code for r in got} == {2, 3} and len(got) == 32
    assert all(np.isfinite(r.aic) for r in got)
