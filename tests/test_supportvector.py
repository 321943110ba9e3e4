"""The shared scans against a plain minimisation, and against the dual bound of the same problem."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import models
from almanac.operators import supportvector as sv

CKEYS = ["station_code", "station", "component"]


@pytest.fixture(scope="module")
def comp(make):
    rnd = random.Random(3)
    wave = [10 + 3 * math.sin(i / 5) + rnd.gauss(0, 0.5) for i in range(1400)]
    jumps = [100 * (i // 40 % 2) + rnd.gauss(0, 9) for i in range(500)]
    return make({(1, "wave"): wave, (2, "jumps"): jumps, (3, "flat"): [4.0] * 60, (4, "short"): [1.0, 2.0]}).withColumn(
        "component", F.lit(1)).withColumn("series_value", F.col("value")).cache()


def problem(comp, code):
    rows = models.lag_design(comp).where(F.col("station_code") == code).orderBy("pos").collect()
    x, y, w = (np.array([r[c] for r in rows]) for c in ("x", "y", "weight"))
    train = np.array([r.part == "train" for r in rows])
    scale = lambda v: (v - v[train].mean(0)) / np.where(v[train].std(0) > 1e-12, v[train].std(0), 1)
    return scale(x), scale(y), w, train, y


def objective(z, y, w, cost, epsilon, beta):
    return beta[1:] @ beta[1:] / 2 + cost * (w * np.maximum(np.abs(y - z @ beta) - epsilon, 0)).sum()


def dual_bound(z, y, w, cost, epsilon, beta, delta=3e-3):
    """A value no coefficients can go below: the dual objective of multipliers made feasible."""
    u = y - z @ least(z, y, w, cost, epsilon, beta, delta)
    a = cost * w * ((u - epsilon) / np.hypot(u - epsilon, delta) + (u + epsilon) / np.hypot(u + epsilon, delta)) / 2
    up, down = a[a > 0].sum(), -a[a < 0].sum()
    a = np.where(a > 0, a * min(1, down / max(up, 1e-300)), a * min(1, up / max(down, 1e-300)))
    return a @ y - epsilon * np.abs(a).sum() - ((a @ z[:, 1:]) ** 2).sum() / 2


def least(z, y, w, cost, epsilon, beta, smallest=1e-6):
    """A plain minimisation, many more steps from ``beta`` on."""
    penalty = np.eye(z.shape[1])
    penalty[0, 0] = 1e-9
    for k in range(600):
        delta, u = max(1e-2 * 0.98 ** k, smallest), y - z @ beta
        up, down = 0.5 / np.hypot(u - epsilon, delta), 0.5 / np.hypot(u + epsilon, delta)
        a = penalty + cost * (z * (w * (up + down))[:, None]).T @ z
        beta = np.linalg.solve(a, cost * z.T @ (w * (up * (y - epsilon) + down * (y + epsilon))))
    return beta


def test_objective_is_within_two_percent_of_the_least(comp):
    cells = sv.grid((0.1, 1.0, 10.0), (0.5, 2.0), (0.05, 0.2))
    got = sv.support_vector_grid(comp, cells=cells).collect()
    assert {(r.station_code, r.cost, r.gamma, r.epsilon) for r in got if r.station_code < 3} == {(k, *c) for k in (1, 2) for c in cells}
    for r in got:
        if r.station_code not in (1, 2):
            continue
        x, y, w, train, raw = problem(comp, r.station_code)
        z, beta = sv.features(x, r.gamma, sv.FEATURES), np.array(r.coefficients)
        value = objective(z[train], y[train], w[train], r.cost, r.epsilon, beta)
        assert r.objective == pytest.approx(value, rel=1e-9)
        args = z[train], y[train], w[train], r.cost, r.epsilon
        best = least(*args, beta)
        assert dual_bound(*args, best) >= 0.985 * objective(*args, best), "nothing is far below it"
        assert value <= 1.005 * objective(*args, best)
        outside = np.abs(y - z @ beta)[train] >= r.epsilon - 1e-3
        assert (r.n_train, r.support) == (train.sum(), outside.sum())
        assert r.test_mse == pytest.approx(((y - z @ beta)[~train] ** 2).mean() * raw[train].var(), rel=1e-6)


def test_support_shrinks_with_the_tube_and_rows_outside_it_decide(comp):
    got = {r.epsilon: r for r in sv.support_vector_grid(comp.where("station_code = 1"), cells=sv.grid((1.0,), (0.5,), (0.05, 0.5))).collect()}
    assert got[0.5].support < got[0.05].support <= got[0.05].n_train


def test_cosines_stand_for_the_kernel():
    x = np.random.default_rng(0).standard_normal((60, 9))
    z = sv.features(x, 0.1, 20_000)[:, 1:]
    kernel = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_best_cell_and_its_rows(comp):
    every = sv.support_vector_grid(comp).collect()
    best = sv.support_vector_fit(comp).cache()
    for r in best.collect():
        own = [o for o in every if o.station_code == r.station_code]
        assert r.tried == len(own) == len(sv.grid())
        assert r.test_mse == pytest.approx(min(o.test_mse for o in own), rel=1e-9)
    assert {r.station_code for r in best.collect()} == {1, 2, 3}
    rows = sv.support_vector_rows(comp, best).where("station_code = 1").orderBy("pos").collect()
    design = models.lag_design(comp).where("station_code = 1").orderBy("pos").collect()
    assert [(r.pos, r.part) for r in rows] == [(d.pos, d.part) for d in design]
    assert np.allclose([r.y for r in rows], [d.y for d in design])
    held = [(r.y - r.predicted) ** 2 for r in rows if r.part == "test"]
    assert np.mean(held) == pytest.approx(next(r.test_mse for r in best.collect() if r.station_code == 1), rel=1e-6)


def test_properties_shift_the_cost(comp):
    props = comp.select(*CKEYS).distinct().withColumn("dominant_frequency", F.lit(0.2)).withColumn("variance", F.lit(5.0))
    got = sv.support_vector_grid(comp.where("station_code = 1"), props, cells=sv.grid((0.1, 10.0), (1.0,), (0.1,))).collect()
    assert sorted(r.cost for r in got) == [0.1, 3.5]
    assert sv.support_vector_grid(comp.where("false")).count() == 0
