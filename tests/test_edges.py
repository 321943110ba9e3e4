"""Hand-made edge cases: impossible dates, duplicates, constant and tiny series, odd names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.operators import alerts as al
from almanac.operators import components as co
from almanac.operators import impute as im
from almanac.operators import precip as pr
from almanac.operators import quality as qu
from almanac.operators import reshape as rs
from almanac.operators import stats as st
from almanac.plans import job
from almanac.sources import readers, writers

KEYS = ["station_code", "station"]


@pytest.fixture(scope="module")
def wide(spark):
    days = [f"Día{d:02d}" for d in range(1, 32)]
    rows = [(123, "A", 2020, m, *[("*" if d == 5 else "nan" if d == 6 else str(20.0 + d)) for d in range(1, 32)])
            for m in (1, 2)]
    return spark.createDataFrame(rows, "`Código` int, `Estación` string, `Año` int, `Mes` int, " + ", ".join(f"`{c}` string" for c in days))


def test_impossible_dates_and_markers_drop_out(wide):
    long = rs.unpivot_days(wide, readers.DAY_COLUMNS, "Código", "Estación", "Año", "Mes")
    dates = {r.date for r in long.collect()}
    assert len(dates) == (31 - 2) + (29 - 2)
    assert dt.date(2020, 2, 29) in dates and max(dates).month == 2
    assert dt.date(2020, 1, 5) not in dates


def test_dedupe_keeps_first_arrival(spark):
    df = spark.createDataFrame([(1, "a", dt.date(2020, 1, 1), 5.0, 2), (1, "a", dt.date(2020, 1, 1), 7.0, 1)],
                               "station_code int, station string, date date, value double, arrival int")
    assert [r.value for r in rs.dedupe_dates(df, "arrival").collect()] == [7.0]


def test_spine_of_other_frequencies(spark):
    df = spark.createDataFrame([(1, "a", dt.date(2020, 1, 31), 1.0), (1, "a", dt.date(2020, 4, 30), 2.0)],
                               "station_code int, station string, date date, value double")
    got = [(r.pos, r.date, r.value) for r in rs.calendar_spine(df, frequency="M").orderBy("pos").collect()]
    assert got[0] == (1, dt.date(2020, 1, 31), 1.0) and got[-1][0] == len(got) == 4


def test_edges_of_fills(make):
    df = make({(1, "a"): [None, 2, None, 4, None], (2, "none"): [None, None], (3, "one"): [5]})
    def values(out):
        return {k: [r.value for r in sorted(out.filter(F.col("station_code") == k).collect(), key=lambda r: r.pos)] for k in (1, 2, 3)}
    assert values(im.impute_linear(df)) == {1: [2, 2, 3, 4, 4], 2: [None, None], 3: [5]}
    assert values(im.impute_linear_forward(df))[1] == [None, 2, 3, 4, 4]
    assert values(im.impute_auto(df)) == {1: [2, 2, 3, 4, 4], 2: [None, None], 3: [5]}
    blocks = im.missing_blocks(df).collect()
    assert sorted((b.station_code, b.start_pos, b.end_pos, b.length) for b in blocks) == [(1, 1, 1, 1), (1, 3, 3, 1), (1, 5, 5, 1), (2, 1, 2, 2)]


def test_auto_fill_keeps_known_values(make):
    import math
    vs = [None if 300 <= i < 345 or i % 9 == 0 else 10 + math.sin(i / 58.1) for i in range(1200)]
    df = make({(1, "a"): vs})
    out = im.impute_auto(df).orderBy("pos").collect()
    assert all(r.value is not None for r in out)
    assert all(r.value == v for r, v in zip(out, vs) if v is not None)
    assert {r.fill_class for r in out if r.imputed} == {"small", "large"}
    # the long gap follows the season, not far from the truth
    assert max(abs(out[i].value - (10 + math.sin(i / 58.1))) for i in range(300, 345)) < 0.5


def test_constant_series(make):
    df = make({(1, "flat"): [3.0] * 400})
    assert qu.series_validity(df).first().verdict == "constant"
    comp = co.decompose(df)
    assert comp.filter("component < 5 and abs(value) > 1e-9").count() == 0
    assert co.component_correlation(comp).filter("correlation is not null").count() == 0
    t = st.trend_analysis(df).first()
    assert t.direction == "no_significant_trend" and t.r2 is None
    assert im.impute_median(df).filter("value <> 3").count() == 0


def test_short_series_is_insufficient(make):
    t = st.trend_analysis(make({(1, "s"): range(9)})).first()
    assert t.direction == "insufficient_data" and t.slope is None


def test_infinite_values_are_reported(make):
    g = qu.quality_gate(make({(1, "i"): [1.0, float("inf")] * 60})).first()
    assert g.infinite == 60 and not g.passed and "infinite_values" in g.findings


def test_names(spark):
    df = spark.createDataFrame([("86011_Some Place, X./Ñ",), ("none",)], "n string")
    got = df.select(rs.extract_station_code(F.col("n")), rs.sanitize_name(F.col("n"), 20)).collect()
    assert tuple(got[0]) == ("86011", "86011_Some_Place_X_Ñ"[:20]) and got[1][0] is None


def test_limit_stations_orders_by_code(spark):
    df = spark.createDataFrame([("12", "b"), ("x", "A 7"), ("3", "c"), ("y", "none")], "station_code string, station string")
    assert {r.station for r in rs.limit_stations(df, 2).collect()} == {"c", "A 7"}


def test_threshold_boundary_goes_to_the_extreme(spark):
    pred = spark.createDataFrame([(1, "1_a", dt.date(2024, 1, 1), v, "temp_max", 1) for v in (9.0, 10.0, 19.9, 20.0)],
                                 "station_code int, station string, date date, value double, variable string, days_ahead int")
    limits = spark.createDataFrame([(1, "a", 1.0, 1.0, 2.0, 2.0, 10.0, 10.0, 20.0, 20.0)],
                                   "station_code int, station string, p5_tmax double, p5_tmin double, p10_tmax double, p10_tmin double, "
                                   "p90_tmax double, p90_tmin double, p95_tmax double, p95_tmin double")
    got = {r.predicted_value: r.severity for r in al.heat_alerts(al.alert_threshold_join(pred, limits)).collect()}
    assert got == {10.0: "warning", 19.9: "warning", 20.0: "critical"}


def test_dry_runs(spark):
    rows = [(1, "a", dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate([0.0, 0.0, 1.0, 2.0, 3.0, 0.0])]
    df = spark.createDataFrame(rows, "station_code int, station string, date date, value double")
    assert tuple(pr.longest_runs(df).first())[2:] == (3, 2)


def test_model_table_versions(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1, "lag", [1.0]), (2, "b", 1, "lag", [2.0])],
                                 "station_code int, station string, component int, model_class string, coefficients array<double>")
    path = str(tmp_path / "models")
    writers.save_models(base, path, "temp_max", 1, "2024-01-01")
    writers.save_models(base.filter("station_code = 1").withColumn("coefficients", F.array(F.lit(9.0))), path, "temp_max", 2, "2024-02-01")
    writers.delete_models(spark, path, base.filter("station_code = 2"), "temp_max", 3, "2024-03-01")
    left = writers.load_models(spark, path).collect()
    assert [(r.station_code, r.coefficients, r.version) for r in left] == [(1, [9.0], 2)]


def test_bad_station_does_not_stop_the_run(make):
    import math
    good = [20 + 5 * math.sin(i / 58.1) + (i % 7) for i in range(800)]
    df = make({(1, "good"): good, (2, "short"): [1.0, 2.0, 3.0]})
    out = job.run(df, "temp_max")
    status = {r.station: (r.status, r.predicted_rows) for r in out["status"].collect()}
    assert status["good"] == ("success", 21) and status["short"] == ("failed", 0)
    lo, hi = min(good), max(good)
    slack = (hi - lo) * 0.1 + 1e-9
    assert all(lo - slack <= r.value <= hi + slack for r in out["forecast"].collect())
    with pytest.raises(ValueError):
        job.run(df, stage="nothing")
