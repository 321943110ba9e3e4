"""Fits with a free location against a plain search, and the series against their definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import located
from almanac.operators.precip import fit_distribution


def log_likelihood(kind, v, loc, scale, shape):
    x = np.array(v) - loc
    if kind == "gamma":
        return ((shape - 1) * np.log(x) - x / scale).sum() - len(x) * (shape * math.log(scale) + math.lgamma(shape))
    if kind == "exponential":
        return -len(x) * math.log(scale) - (x / scale).sum()
    z = (np.log(x) - math.log(scale)) / shape
    return (-np.log(x) - math.log(shape) - 0.5 * math.log(2 * math.pi) - z * z / 2).sum()


def plain_shape(gap):
    """ln a - digamma(a) = gap, by bisection on a numeric derivative of lgamma."""
    lo, hi = 1e-3, 1e6
    for _ in range(200):
        a = math.sqrt(lo * hi)
        h = 1e-4 * a
        if math.log(a) - (math.lgamma(a + h) - math.lgamma(a - h)) / (2 * h) > gap:
            lo = a
        else:
            hi = a
    return a


def plain_profile(kind, v):
    best = -math.inf
    for share in np.linspace(0, located.NEAREST, 400):
        loc = share * min(v)
        x = np.array(v) - loc
        if kind == "gamma":
            a = plain_shape(math.log(x.mean()) - np.log(x).mean())
            best = max(best, log_likelihood(kind, v, loc, x.mean() / a, a))
        else:
            best = max(best, log_likelihood(kind, v, loc, math.exp(np.log(x).mean()), np.log(x).std()))
    return best


@pytest.fixture(scope="module")
def series():
    rnd = random.Random(5)
    return {1: [3 + rnd.gammavariate(2.5, 2) for _ in range(400)], 2: [rnd.gammavariate(0.6, 5) + 0.05 for _ in range(300)],
            3: [20 + math.exp(rnd.gauss(1, 0.4)) for _ in range(300)], 4: [2 + rnd.expovariate(0.3) for _ in range(300)],
            5: [1.0, 2.0, 0.0], 6: [4.0] * 30, 7: [0.0] * 12}


@pytest.fixture(scope="module")
def fits(make, series):
    return {r.station_code: r for r in located.fit_located(make({(k, "s"): [*v, 0.0, None] for k, v in series.items()})).collect()}


def test_likelihood_is_the_profile_s_best(fits, series):
    for k in (1, 2, 3, 4):
        r = fits[k]
        for kind in ("gamma", "lognormal"):
            found = [r[f"{kind}_{c}"] for c in ("loc", "scale", "shape")]
            value = log_likelihood(kind, series[k], *found)
            assert r[f"{kind}_aic"] == pytest.approx(6 - 2 * value, abs=1e-5)
            assert value >= plain_profile(kind, series[k]) - 1e-3
        assert r.exponential_aic == pytest.approx(4 - 2 * log_likelihood("exponential", series[k], r.exponential_loc, r.exponential_scale, None), abs=1e-6)


def test_it_is_never_below_the_closed_form(make, fits, series):
    closed = {r.station_code: r for r in fit_distribution(make({(k, "s"): v for k, v in series.items()})).collect()}
    for k in (1, 2, 3, 4):
        assert all(fits[k][f"{d}_aic"] <= closed[k][f"aic_{d}"] + 1e-6 for d in ("gamma", "lognormal", "exponential"))


def test_parameters_and_families(fits):
    assert fits[1].gamma_loc == pytest.approx(3, abs=0.5) and fits[1].gamma_shape == pytest.approx(2.5, abs=0.8)
    for k in (1, 2, 3, 4):
        assert fits[k].best == min(("gamma", "exponential", "lognormal"), key=lambda d: fits[k][f"{d}_aic"])
    assert fits[4].exponential_loc == pytest.approx(2, abs=0.1) and fits[3].lognormal_loc > 15
    assert fits[5].best == "insufficient_data" and fits[5].gamma_aic is None
    assert fits[6].best == "fitting_failed" and 7 not in fits


def test_shapes_solve_their_equation(spark):
    gaps = [1e-6, 1e-3, 0.05, 0.5, 2.0, 10.0]
    rows = spark.createDataFrame([(g,) for g in gaps], "gap double").withColumn("a", located.gamma_shape(F.col("gap"))).withColumn(
        "left", F.ln("a") - located.digamma(F.col("a"))).collect()
    for r in rows:
        assert r.left == pytest.approx(r.gap, rel=1e-6, abs=1e-9)
        if r.gap > 1e-3:
            assert r.a == pytest.approx(plain_shape(r.gap), rel=1e-3)
