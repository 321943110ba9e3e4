"""The run keeps history, serves short stations, honours arrival and leaves its tables where it was told to."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from almanac.operators import precip, reshape
from almanac.plans import job
from almanac.plans.lineage import scratch_path
from almanac.sources import writers


def season(n, start=0):
    return [20 + 5 * math.sin((start + i) / 58.1) + (i % 7) for i in range(n)]


@pytest.fixture(scope="module")
def delivered(spark, make):
    long_gap = season(900) + [None] * 600 + season(690, 1500)
    raw = make({(1, "gap"): long_gap, (2, "short"): season(40), (3, "tiny"): [1.0, 2.0, 3.0], (4, "full"): season(800)})
    limits = spark.createDataFrame([(c, n, 0.0, 1.0, 21.0, 22.0) for c, n in ((1, "gap"), (4, "full"))],
                                   "station_code int, station string, p5_tmax double, p10_tmax double, p90_tmax double, p95_tmax double")
    path = scratch_path(spark, "job")
    return path, job.run(raw, "temp_max", thresholds=limits.withColumns({f"{p}_tmin": F.col(f"{p}_tmax") for p in ("p5", "p10", "p90", "p95")}), sink=path)


def test_history_before_a_long_gap_is_kept(delivered):
    _, out = delivered
    rows = out["filled"].where("station_code = 1")
    assert rows.where("not imputed").count() == 1590 and rows.count() == 2190
    assert rows.where("long_gap").count() == rows.where("imputed").count() == 600
    status = {r.station: r for r in out["status"].collect()}
    assert status["gap"].status == "success" and status["gap"].predicted_rows == 21


def test_history_can_still_be_trimmed(make):
    done, _ = job.impute(job.preprocess(make({(1, "gap"): season(300) + [None] * 600 + season(200)})), max_block=548)
    assert done.count() == 200 and done.where("long_gap").count() == 0


def test_short_stations_get_the_trend(delivered):
    _, out = delivered
    status = {r.station: (r.status, r.reason, r.predicted_rows) for r in out["status"].collect()}
    assert status["short"] == ("success", "trend_only", 21) and status["full"] == ("success", None, 21)
    assert status["tiny"] == ("failed", "too_few_rows_for_models", 0)
    ahead = out["forecast"].where("station = 'short'").collect()
    assert len(ahead) == 21 and all(r.lower_ci < r.value < r.upper_ci for r in ahead)
    assert {r.method for r in out["parts"].where("station = 'short'").collect()} == {"trend"}


def test_gates_are_reported(delivered):
    _, out = delivered
    checks = out["checks"].collect()
    assert {r.station for r in checks} == {"gap", "full"} and all(r.kept is not None and r.eligible is not None for r in checks)
    assert {r.station: r.model_ready for r in out["gate"].collect()} == {"gap": True, "short": False, "tiny": False, "full": True}
    assert out["acceptance"].count() == 2


def test_sinks_hold_the_run(spark, delivered):
    path, out = delivered
    table = spark.read.option("header", True).csv(f"{path}/predictions")
    kept = out["status"].where("status = 'success'").select("station_code")
    assert table.count() == out["predictions"].join(kept, "station_code").count() > 0
    assert spark.read.option("header", True).csv(f"{path}/series").count() == out["filled"].count()
    models = {r.station: r.n_models for r in writers.list_models(spark, f"{path}/models").collect()}
    assert models == {"gap": 5, "full": 5}
    assert spark.read.parquet(f"{path}/components/components").count() == out["components"].count()
    assert spark.read.json(f"{path}/reports/station_reports").count() == 4
    assert spark.read.json(f"{path}/alerts/alerts_summary").count() >= 1


def test_the_first_reading_of_a_day_counts(spark):
    """Every date comes twice, the second reading being another."""
    days = [dt.date(2022, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    rows = [(7, "twice", d, float(i) + 100 * k, 2 * i + k) for i, d in enumerate(days) for k in (1, 0)]
    raw = spark.createDataFrame(rows, "station_code int, station string, date date, value double, read_at int")
    first = job.run(raw, stage="preprocess", arrival="read_at")["daily"].orderBy("date").collect()
    assert [r.value for r in first] == [float(i) for i in range(60)]
    mean = job.run(raw, stage="preprocess")["daily"].orderBy("date").collect()
    assert [r.value for r in mean] == [i + 50.0 for i in range(60)]


def test_short_stations_have_monthly_patterns(make):
    got = precip.monthly_wet_pattern(make({(1, "a"): [float(i % 3) for i in range(300)]})).collect()
    assert sum(r.n for r in got) == 300 and len(got) == 10


def test_impossible_dates_are_counted(spark):
    rows = [(1, "a", "2021", "2", "1.5", "2.5", "*"), (1, "a", "2020", "2", "1", "2", "3"), (1, "a", "2021", "x", "1", "nan", ""), (2, "b", "2021", "4", "", "", "")]
    df = spark.createDataFrame(rows, "station_code int, station string, year string, month string, d28 string, d29 string, d31 string")
    got = {r.station_code: (r.cells, r.impossible) for r in reshape.impossible_dates(df, ["d28", "d29", "d31"]).collect()}
    assert got == {1: (6, 3), 2: (0, 0)}
    kept = reshape.unpivot_days(df, ["d28", "d29", "d31"])
    assert kept.count() == 3
