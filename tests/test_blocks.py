"""Splitting a station over blocks changes nothing but the layout."""

import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import components as co
from almanac.operators import features as fe
from almanac.operators import impute as im
from almanac.plans import blocks
from almanac.plans.quantiles import exact_quantiles, series_quantiles

KEYS = ["station_code", "station"]


@pytest.fixture(scope="module")
def gappy(make):
    rnd = random.Random(7)
    return make({
        (1, "hot"): [rnd.gauss(20, 5) if rnd.random() > 0.4 else None for _ in range(900)],
        (2, "b"): [rnd.gauss(10, 2) if rnd.random() > 0.2 else None for _ in range(130)],
        (3, "empty"): [None] * 40,
    }).cache()


def rows(df, *cols):
    return sorted(map(tuple, df.select("station_code", "pos", *cols).collect()))


@pytest.mark.parametrize("fill", [im.impute_linear, im.impute_linear_forward, im.impute_ffill, im.impute_bfill, im.impute_polynomial])
def test_fills_do_not_depend_on_blocks(gappy, fill, monkeypatch):
    whole = rows(fill(gappy), "value", "imputed")
    monkeypatch.setattr(blocks, "BLOCK", 16)
    assert rows(fill(gappy, split=True), "value", "imputed") == whole


def test_missing_blocks_split(gappy, monkeypatch):
    def out(df):
        return sorted(map(tuple, df.collect()))
    whole = out(im.missing_blocks(gappy))
    monkeypatch.setattr(blocks, "BLOCK", 16)
    assert out(im.missing_blocks(gappy, split=True)) == whole


def test_numbering_and_sums_split(gappy):
    known = gappy.filter("value is not null").drop("pos")
    a = rows(blocks.number_rows(known, KEYS), "date", "n")
    b = rows(blocks.number_rows(known, KEYS, size=32, split=True), "date", "n")
    assert a == b
    sums = {"s": F.lit(1)}
    assert rows(blocks.running_sums(gappy, KEYS, sums), "s") == rows(blocks.running_sums(gappy, KEYS, sums, 16, True), "s")


@pytest.mark.parametrize("size", [50, 64, 4096])
def test_frames_do_not_depend_on_blocks(gappy, size, monkeypatch):
    filled = im.impute_linear(gappy).filter("value is not null").select(*KEYS, "date", "pos", "value").cache()
    expected = {}
    for s in (100000, size):
        monkeypatch.setattr(blocks, "BLOCK", s)
        got = {
            "momentum": rows(fe.momentum(filled), F.round("roc_7", 9), F.round("accel_14", 9)),
            "trend": rows(fe.trend_window(filled), F.round("slope_30", 9), F.round("quad_a_30", 9)),
            "decompose": rows(co.decompose(filled), "component", F.round("value", 8)),
            "cyclical": sorted(map(tuple, co.lag_products(co.decompose(filled), 40).withColumn(
                "product", F.round("product", 5)).collect())),
        }
        expected = expected or got
        assert got == expected


@pytest.mark.parametrize("rows_in, accuracy", [(20000, 100), (20000, 1000), (900, 1000), (12, 1000)])
def test_exact_quantiles_equal_percentile(spark, rows_in, accuracy):
    df = spark.range(rows_in).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("k"),
        F.when(F.col("id") % 11 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(5003)) / 7.0).alias("value"))
    probs = {"lo": 0.0, "q1": 0.25, "med": 0.5, "p95": 0.95, "hi": 1.0}
    a = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in series_quantiles(df, ["k"], probs).collect())
    b = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in exact_quantiles(df, ["k"], probs, accuracy=accuracy).collect())
    assert a == b
