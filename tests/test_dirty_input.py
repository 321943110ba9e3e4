"""Dirty input: finer and coarser steps, long horizons, gaps at the ends, repeated codes, a missing shared folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.operators import alerts, forecast, impute, reshape
from almanac.plans import lineage


def test_hourly_readings_stay_hourly_and_weekly_ones_weekly(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [(1, "h", start + dt.timedelta(hours=i), float(i)) for i in range(24) if i != 5]
    rows += [(2, "w", start + dt.timedelta(days=7 * i + (i == 3)), float(i)) for i in range(10)]
    rows += [(3, "m", dt.datetime(2020 + i // 12, i % 12 + 1, 1), float(i)) for i in range(15)] + [(4, "one", start, 1.0)]
    got = reshape.frequency_calendar(spark.createDataFrame(rows, "station_code int, station string, date timestamp, value double"))
    by = {c: got.where(F.col("station_code") == c).orderBy("pos").collect() for c in (1, 2, 3, 4)}
    assert [len(by[c]) for c in (1, 2, 3, 4)] == [24, 10, 15, 1]
    assert [r.merged for r in by[1]] == [int(i != 5) for i in range(24)] and by[1][5].value is None
    assert {r.frequency for r in by[2]} == {"W"} and [r.value for r in by[2]] == [float(i) for i in range(10)]
    assert by[3][-1].date == dt.datetime(2021, 3, 1)


def test_a_horizon_gives_what_is_asked(make):
    df = make({(1, "a"): [1.0] * 50})
    assert forecast.horizon(df, 90).first().steps == 90
    limited = forecast.horizon(df, 90, max_share=0.1, max_steps=60).first()
    assert (limited.requested, limited.steps) == (90, 5)


def test_gaps_at_the_ends_are_classed_by_their_length(make):
    df = make({(1, "short"): [1.0] * 60 + [None] * 2, (2, "long"): [1.0] * 60 + [None] * 60})
    kinds = {(r.station_code, r.fill_class) for r in impute.impute_auto(df).where("fill_class is not null").collect()}
    assert kinds == {(1, "small"), (2, "large")}


def test_a_code_twice_in_the_sheet_alerts_once(spark):
    sheet = spark.createDataFrame([(1, "a", 5.0), (1, "a", 6.0)], "station_code int, station string, p90_tmax double")
    days = spark.createDataFrame([(1, "a", 7.0)], "station_code int, station string, value double")
    assert alerts.alert_threshold_join(days, sheet).count() == 1


def test_cells_without_a_finite_number_are_empty(spark):
    cells = spark.createDataFrame([("Infinity",), ("-inf",), ("NaN",), ("1e999",), ("2.5",)], "c string")
    assert [r[0] for r in cells.select(reshape.clean_cell(F.col("c"))).collect()] == [None, None, None, None, 2.5]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        lineage.shared_dir(Session())
    Context.getCheckpointDir = lambda self: "hdfs://folder"
    assert lineage.shared_dir(Session()) == "hdfs://folder"
