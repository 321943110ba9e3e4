"""Fits and draws against brute force on small series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.functions.betainc import student_p
from almanac.operators import components as co
from almanac.operators import features as fe
from almanac.operators import forecast as fo
from almanac.operators import models as mo
from almanac.operators import precip as pr

KEYS = ["station_code", "station"]
CKEYS = [*KEYS, "component"]


@pytest.fixture(scope="module")
def wave():
    rnd = random.Random(3)
    return [10 + 3 * math.sin(i / 5) + rnd.gauss(0, 1) for i in range(500)]


@pytest.fixture(scope="module")
def comp(make, wave):
    return make({(1, "a"): wave}).withColumn("component", F.lit(1)).withColumn("series_value", F.col("value")).cache()


def design(v, lags=7):
    x, y = [], []
    for i in range(lags, len(v)):
        past = v[i - lags:i][::-1]
        x.append([*past, np.mean(past), np.std(past)])
        y.append(v[i])
    return np.array(x), np.array(y)


def test_ridge_by_sums_equals_direct_solution(comp, wave):
    x, y = design(wave)
    cut = int(len(x) * 0.8)
    raw = np.exp(-0.1 * (len(x) - 1 - np.arange(len(x))))
    w = (0.5 + 0.5 * raw / raw.mean())[:cut]
    xt, yt = x[:cut], y[:cut]
    mx, my = np.average(xt, axis=0, weights=w), np.average(yt, weights=w)
    sd = np.sqrt(np.average((xt - mx) ** 2, axis=0, weights=w))
    z = (xt - mx) / sd
    beta = np.linalg.solve((z * w[:, None]).T @ z + np.eye(9), (z * w[:, None]).T @ (yt - my)) / sd
    got = mo.lag_model_fit(comp, 1.0).first()
    assert np.allclose(got.coefficients[1:], beta, atol=1e-6)
    pred = my + (x[cut:] - mx) @ beta
    assert got.test_mse == pytest.approx(np.mean((y[cut:] - pred) ** 2), rel=1e-6)
    rows = mo.predict_rows(mo.lag_design(comp).filter("part = 'test'"), mo.lag_model_fit(comp, 1.0))
    assert np.allclose([r.predicted for r in rows.orderBy("pos").collect()], pred, atol=1e-6)


def test_grid_takes_the_best_hold_out(comp):
    best = mo.lag_model_grid(comp).first()
    each = [mo.lag_model_fit(comp, a).first().test_mse for a in mo.GRID]
    assert best.tried == 3 and best.test_mse == pytest.approx(min(each))


def test_recursive_forecast(comp, wave):
    model = mo.lag_model_fit(comp)
    b = model.first().coefficients
    v = list(wave)
    for _ in range(21):
        past = v[-7:][::-1]
        v.append(b[0] + np.dot(b[1:8], past) + b[8] * np.mean(past) + b[9] * np.std(past))
    got = [r.value for r in fo.forecast_lag(comp, model).orderBy("days_ahead").collect()]
    assert np.allclose(got, v[-21:])


def test_order_selection(comp, wave):
    v = np.array(wave)
    aics = []
    y = v[3:]
    for p in range(4):
        x = np.column_stack([np.ones(len(y)), *[v[3 - k:len(v) - k] for k in range(1, p + 1)]])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        aics.append(len(y) * math.log(np.mean((y - x @ beta) ** 2)) + 2 * (p + 1))
    got = mo.order_selection(comp).first()
    assert got.p == int(np.argmin(aics)) and got.aic == pytest.approx(min(aics), abs=1e-4)


def test_student_p():
    def brute(t, df):
        # both tails of the density on a fine grid, far out
        x = np.linspace(t, t + 4000, 8_000_001)
        log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
        return 2 * np.trapezoid(np.exp(log_c - (df + 1) / 2 * np.log1p(x * x / df)), x)
    pairs = [(2.228139, 10.0), (1.959964, 1e6), (0.0, 5.0), (2.0, 30.0), (4.5, 12.0)]
    got = student_p(np.array([t for t, _ in pairs]), np.array([d for _, d in pairs]))
    assert np.allclose(got, [brute(t, d) for t, d in pairs], atol=1e-6)
    # one degree of freedom has a closed form
    assert student_p(np.array([12.706205]), np.array([1.0]))[0] == pytest.approx(1 - 2 / math.pi * math.atan(12.706205), abs=1e-9)


def test_components_add_up(make, wave):
    df = make({(1, "a"): wave, (2, "b"): wave[:30]})
    total = co.decompose(df).groupBy("station_code", "pos").agg(
        F.sum("value").alias("s"), F.first("series_value").alias("v"))
    assert total.filter(F.abs(F.col("s") - F.col("v")) > 1e-9).count() == 0


def test_exactly_one_seasonal_component(make, wave):
    comp = co.decompose(make({(1, "a"): wave * 2, (2, "b"): wave[::-1] * 2}))
    got = co.classify_components(co.seasonal_model_score(co.score_inputs(comp)))
    counts = got.groupBy("station_code").agg(F.sum(F.when(F.col("model_class") == "seasonal", 1).otherwise(0)).alias("n"))
    assert [r.n for r in counts.collect()] == [1, 1]


def test_recency_sampling_shares(make):
    out = fe.recency_sampling(make({(1, "a"): range(365)})).groupBy("band").count().collect()
    assert {r.band: r["count"] for r in out} == {"recent": 30, "medium": 24, "far": 18, "distant": 36, "very_distant": 37}


def test_stratified_sample_size(make, wave):
    df = make({(1, "a"): wave, (2, "short"): wave[:40]})
    got = {r.station: r["count"] for r in fe.stratified_sample(df, 200).groupBy("station").count().collect()}
    assert got == {"a": 200, "short": 40}


def test_rain_transform_is_repeatable_and_has_dry_days(make):
    rnd = random.Random(5)
    hist = make({(1, "r"): [0.0 if rnd.random() < 0.5 else rnd.expovariate(0.2) for _ in range(900)]})
    fc = fo.reconstruct_forecast(fo.simple_components(co.decompose(hist)), hist)
    def run():
        return sorted((r.date, r.value) for r in pr.precip_transform(fc, hist).collect())
    a = run()
    assert a == run() and all(v >= 0 for _, v in a)
    assert 0 < sum(v == 0 for _, v in a) < len(a)


def test_feature_row_matches_frames(make, wave):
    df = make({(1, "a"): wave, (2, "short"): wave[:40]})
    row = {r.station: r for r in fe.feature_row(df).collect()}
    assert row["a"].rolling_mean_90 == pytest.approx(np.mean(wave[-90:]))
    assert row["a"].rolling_p25_30 == pytest.approx(np.percentile(wave[-30:], 25))
    assert row["short"].rolling_mean_90 == 0.0
    assert row["a"].momentum_roc_14 == pytest.approx((wave[-1] - wave[-15]) / wave[-15])
    assert row["a"].lag_1 == pytest.approx(wave[-2])
