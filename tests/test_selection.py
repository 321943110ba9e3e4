"""Order statistics by counted pivots against sorting, and samples drawn with them."""

import random

import numpy as np
import pytest

from almanac.operators import features
from almanac.plans import selection
from almanac.plans.quantiles import exact_quantiles

KEYS = ["station_code", "station"]


@pytest.fixture(scope="module")
def groups():
    rnd = random.Random(8)
    return {"even": list(range(3000)), "one value": [7.0] * 2500, "two": [1.0] * 1500 + [2.0] * 900, "steep": [10.0 ** rnd.uniform(-300, 300) for _ in range(1500)],
            "signs": [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-3, 308) for _ in range(1500)], "hot": [5.0] * 4000 + [rnd.gauss(5, 1e-9) for _ in range(900)],
            "few": [3.0, 1.0, 2.0], "single": [9.0], "tiny": [5e-324 * rnd.randrange(3) for _ in range(300)]}


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("even", None), ("few", float("nan")), ("gone", None)]
    return spark.createDataFrame(rows, "k string, value double").repartition(5).cache()


@pytest.mark.parametrize("limit, pieces", [(2000, 256), (40, 64)])
def test_any_rank_is_found(spark, table, groups, limit, pieces):
    ranks = {k: sorted({0, len(v) - 1, len(v) // 2, len(v) // 3, len(v), -1}) for k, v in groups.items()}
    wanted = spark.createDataFrame([(k, str(i), i) for k, own in ranks.items() for i in own] + [("gone", "0", 0), ("absent", "0", 0)], "k string, name string, rank_at long")
    got = selection.order_statistics(table, ["k"], wanted, "value", limit, pieces)
    want = {(k, str(i)): sorted(map(float, groups[k]))[i] for k, own in ranks.items() for i in own if 0 <= i < len(groups[k])}
    assert {(r.k, r.name): r.v for r in got.collect()} == want


def test_quantiles_of_hard_groups(table, groups):
    rows = table.where("not isnan(value)")
    got = {r.k: r for r in exact_quantiles(rows, ["k"], {"a": 0.1, "b": 0.77}, limit=10).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert np.allclose([got[k].a, got[k].b], np.quantile(v, [0.1, 0.77]), rtol=1e-9, atol=0)


def test_sizes_of_samples_are_exact(make):
    df = make({(1, "a"): [float(i % 50) for i in range(900)], (2, "b"): [1.0] * 40})
    kept = features.recency_sampling(df)
    again = features.recency_sampling(df.repartition(7))
    rows = lambda d: sorted(map(tuple, d.select("station_code", "date", "band").collect()))
    assert rows(kept) == rows(again)
    sizes = {(r.station_code, r.band): r["count"] for r in kept.groupBy("station_code", "band").count().collect()}
    assert sizes == {(1, "recent"): 30, (1, "medium"): 24, (1, "far"): 18, (1, "distant"): 36, (1, "very_distant"): 144, (2, "recent"): 30, (2, "medium"): 8}
    sample = features.stratified_sample(df, 200)
    assert sample.where("station_code = 1").count() == 200 and sample.where("station_code = 2").count() == 40
    assert features.recency_sampling(df.where("false")).count() == 0 and features.stratified_sample(df.where("false")).count() == 0
