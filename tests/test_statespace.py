"""Scans by blocks against a plain filter and smoother, day by day."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import statespace as ss

KEYS = ["station_code", "station"]


def plain_filter(y, phi, ratio):
    """Means and variances for sigma2 = 1, best sigma2 and log likelihood."""
    m, p, out, logs, squares, n = 0.0, 1 / (1 - phi * phi), [], 0.0, 0.0, 0
    for v in y:
        m, p = phi * m, phi * phi * p + 1
        if v is not None:
            f = p + ratio
            logs, squares, n = logs - math.log(f) / 2, squares + (v - m) ** 2 / f, n + 1
            m, p = m + p / f * (v - m), p - p * p / f
        out.append((m, p))
    sigma2 = max(squares / max(n, 1), 1e-300)
    return out, sigma2, logs - n / 2 * (math.log(2 * math.pi * sigma2) + 1)


def plain_smoother(y, phi, ratio):
    f, _, _ = plain_filter(y, phi, ratio)
    out = [f[-1]]
    for m, p in reversed(f[:-1]):
        g = p * phi / (phi * phi * p + 1)
        ahead, spread = out[-1]
        out.append((m + g * (ahead - phi * m), p + g * g * (spread - phi * phi * p - 1)))
    return out[::-1]


def process(rnd, n, phi, noise, gaps=()):
    x, out = 0.0, []
    for i in range(n):
        x = phi * x + rnd.gauss(0, 1)
        out.append(None if any(a <= i < b for a, b in gaps) else x + rnd.gauss(0, noise))
    return out


@pytest.fixture(scope="module")
def known():
    rnd = random.Random(4)
    return {1: process(rnd, 700, 0.8, 0.0, [(100, 160), (0, 3), (690, 700)]), 2: process(rnd, 700, 0.5, 1.0, [(300, 500)]), 3: [2.0], 4: [None, 1.5, None],
            5: [None] * 9, 6: process(rnd, 90, -0.6, 0.3)}


@pytest.fixture(scope="module")
def table(make, known):
    return make({(k, "s"): v for k, v in known.items()})


def params(days, phi, ratio):
    return days.select(*KEYS).distinct().select(*KEYS, F.lit(phi).alias("phi"), F.lit(ratio).alias("ratio"))


def collected(df):
    out = {}
    for r in df.orderBy("pos").collect():
        out.setdefault(r.station_code, []).append((r.m, r.p))
    return out


@pytest.mark.parametrize("size, fan", [(4096, 64), (50, 64), (7, 3)])
def test_filter_and_smoother(table, known, size, fan):
    """One block a series, many, and a tree of several levels."""
    days = ss.day_blocks(table, size=size)
    for phi, ratio in ((0.8, 0.0), (0.6, 2.0), (-0.7, 0.4)):
        f = collected(ss.filtered(days, params(days, phi, ratio), fan=fan))
        s = collected(ss.smoothed(days, params(days, phi, ratio), fan=fan))
        for k, y in known.items():
            assert np.allclose(f[k], plain_filter(y, phi, ratio)[0], atol=1e-8), (k, phi)
            assert np.allclose(s[k], plain_smoother(y, phi, ratio), atol=1e-8), (k, phi)


@pytest.mark.parametrize("size, fan", [(4096, 64), (11, 4)])
def test_likelihoods_of_many_pairs(table, known, size, fan):
    pairs = [(0.9, 0.0), (0.0, 1.0), (-0.95, 5.0), (0.5, 0.2)]
    days = ss.day_blocks(table, size=size)
    asked = days.select(*KEYS).distinct().select(
        *KEYS, F.array(*[F.lit(a) for a, _ in pairs]).alias("phi"), F.array(*[F.lit(b) for _, b in pairs]).alias("ratio"))
    got = {r.station_code: r for r in ss.log_likelihoods(days, asked, fan=fan).collect()}
    for k, y in known.items():
        n = sum(v is not None for v in y)
        assert got[k].n == n
        for i, (phi, ratio) in enumerate(pairs if n else []):
            _, sigma2, want = plain_filter(y, phi, ratio)
            assert got[k].log_likelihood[i] == pytest.approx(want, abs=1e-8 * max(1, abs(want)))
            assert got[k].sigma2[i] == pytest.approx(sigma2, rel=1e-9)


def test_fit_reaches_the_largest_likelihood(make):
    rnd = random.Random(9)
    truth = {1: (0.9, 0.0), 2: (0.6, 1.0), 3: (-0.5, 0.0)}
    series = {k: process(rnd, 1500, phi, math.sqrt(r), [(200, 260)]) for k, (phi, r) in truth.items()}
    days = ss.day_blocks(make({(k, "s"): v for k, v in series.items()}), size=400).cache()
    got = {r.station_code: r for r in ss.likelihood_fit(days).collect()}
    for k, y in series.items():
        best = max(plain_filter(y, phi, ratio)[2] for phi in np.linspace(-0.98, 0.98, 99) for ratio in (0, 0.02, 0.1, 0.5, 0.8, 1, 1.2, 2))
        assert got[k].log_likelihood >= best - 1e-6
        assert got[k].log_likelihood == pytest.approx(plain_filter(y, got[k].phi, got[k].ratio)[2], abs=1e-6)
        assert abs(got[k].phi - truth[k][0]) < 0.12
    alone = {r.station_code: r for r in ss.likelihood_fit(days, noisy=False).collect()}
    assert all(alone[k].ratio == 0 for k in series) and alone[2].log_likelihood < got[2].log_likelihood
    empty = ss.likelihood_fit(ss.day_blocks(make({(9, "x"): [None] * 5}))).first()
    assert (empty.n, empty.phi, empty.sigma2) == (0, 0.0, None)


def test_a_fill_is_the_bridge_between_the_edges(make):
    """The closed form of a first-order process between two known days; towards an open end it fades."""
    rnd = random.Random(6)
    series = process(rnd, 900, 0.85, 0.0, [(200, 230), (600, 601), (890, 900)])
    got = ss.impute_smoothed(make({(1, "a"): series}), period=1, size=64).orderBy("pos").collect()
    assert [r.value for r in got if not r.imputed] == [v for v in series if v is not None]
    days = ss.day_blocks(make({(1, "a"): [None if v is None else v - np.mean([x for x in series if x is not None]) for v in series]}))
    fit = ss.likelihood_fit(days, noisy=False).first()
    mean = np.mean([v for v in series if v is not None])
    a = fit.phi
    for first, last in ((200, 230), (600, 601)):
        u, v, length = series[first - 1] - mean, series[last] - mean, last - first + 1
        for i in range(1, length):
            weight = 1 - a ** (2 * length)
            want = (u * a ** i * (1 - a ** (2 * (length - i))) + v * a ** (length - i) * (1 - a ** (2 * i))) / weight
            spread = fit.sigma2 * (1 - a ** (2 * i)) * (1 - a ** (2 * (length - i))) / weight / (1 - a * a)
            row = got[first - 1 + i]
            assert row.imputed and row.value == pytest.approx(mean + want, abs=1e-6)
            assert row.spread == pytest.approx(math.sqrt(spread), abs=1e-6)
    assert got[895].value == pytest.approx(mean + (series[889] - mean) * a ** 6, abs=1e-6)
    empty = ss.impute_smoothed(make({(1, "a"): [None] * 4, (2, "b"): [1.0, None, 3.0]}), period=1).collect()
    assert all((r.value is None) == (r.station_code == 1) for r in empty)
