"""Queries for threshold alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.registry import query
from almanac.catalog.sql import FILLED, THRESHOLDS, r
from almanac.functions.expr import rnd, shown
from almanac.operators import alerts as ops
from almanac.operators.impute import impute_linear
from almanac.operators.reshape import calendar_spine
from almanac.sources import tables as src


def predictions(spark, sf, of=None):
    """The filled series read as predictions from the station's first day on; even codes as
    maximum, odd ones as minimum temperature. Every third station only has its code in its name."""
    code = F.col("station_code")
    filled = src.filled(spark, sf) if of is None else impute_linear(calendar_spine(of))
    return filled.select(
        F.when(code % 3 != 2, code).alias("station_code"),
        F.concat(code.cast("string"), F.lit("_"), F.col("station")).alias("station"), "date", "value",
        F.when(code % 2 == 0, "temp_max").otherwise("temp_min").alias("variable"),
        (F.col("pos") - 1).cast("int").alias("days_ahead"))


def limits(spark, sf, of=None):
    """Thresholds of all stations but every fifth."""
    return src.thresholds(spark, sf, of).filter(F.col("station_code") % 5 != 4)


def joined(spark, sf):
    s = src.series_table(spark, sf)
    return ops.alert_threshold_join(predictions(spark, sf, s), limits(spark, sf, s))


def all_alerts(spark, sf):
    return ops.detect_alerts(joined(spark, sf))


ALERTS = f"""{FILLED}, {THRESHOLDS},
  pred AS (SELECT CASE WHEN station_code % 3 <> 2 THEN station_code END AS station_code, station_code AS code, station_code || '_' || station AS station, date, value,
    CASE WHEN station_code % 2 = 0 THEN 'temp_max' ELSE 'temp_min' END AS variable, CAST(pos - 1 AS INTEGER) AS days_ahead FROM filled),
  lim AS (SELECT station_code AS code, station AS threshold_station, p5, p10, p90, p95 FROM thresholds WHERE station_code % 5 <> 4),
  jn AS MATERIALIZED (SELECT pred.*, threshold_station, p5, p10, p90, p95 FROM pred JOIN lim ON pred.code = lim.code),
  alerts AS MATERIALIZED (SELECT code AS station_code, station AS station_name,
     CASE WHEN variable = 'temp_max' THEN CASE WHEN value >= p95 THEN 'heat_wave_extreme' ELSE 'heat_wave' END
      ELSE CASE WHEN value <= p5 THEN 'cold_wave_extreme' ELSE 'cold_wave' END END AS alert_type,
     CASE WHEN variable = 'temp_max' AND value >= p95 OR variable = 'temp_min' AND value <= p5 THEN 'critical' ELSE 'warning' END AS severity,
     date, value AS predicted_value, CASE WHEN variable = 'temp_max' THEN CASE WHEN value >= p95 THEN p95 ELSE p90 END
      ELSE CASE WHEN value <= p5 THEN p5 ELSE p10 END END AS threshold_value, variable AS variable_type, days_ahead
    FROM jn WHERE variable = 'temp_max' AND value >= p90 OR variable = 'temp_min' AND value <= p10)"""
_A = ["station_code", "station_name", "alert_type", "severity", "date", "variable_type", "days_ahead"]
_AS = f"{', '.join(_A)}, {r('predicted_value')} AS predicted_value, {r('threshold_value')} AS threshold_value"


def _shown(df, *extra):
    return shown(df, [*_A, *extra], ["predicted_value", "threshold_value"])


@query("alert_threshold_join", f"""WITH {ALERTS} SELECT code, station_code, station, date, {r('value')} AS value, variable, days_ahead, threshold_station,
  {r('p95')} AS p95_tmax, {r('p5')} AS p5_tmin FROM jn""")
def _(spark, sf):
    return shown(joined(spark, sf), ["code", "station_code", "station", "date", "variable", "days_ahead", "threshold_station"],
                 ["value", "p95_tmax", "p5_tmin"])


@query("stations_without_thresholds", f"WITH {ALERTS} SELECT DISTINCT code, station FROM pred WHERE code NOT IN (SELECT code FROM lim)")
def _(spark, sf):
    s = src.series_table(spark, sf)
    return ops.stations_without_thresholds(predictions(spark, sf, s), limits(spark, sf, s))


@query("heat_alerts", f"WITH {ALERTS} SELECT {_AS} FROM alerts WHERE alert_type LIKE 'heat%'")
def _(spark, sf):
    return _shown(ops.heat_alerts(joined(spark, sf)))


@query("cold_alerts", f"WITH {ALERTS} SELECT {_AS} FROM alerts WHERE alert_type LIKE 'cold%'")
def _(spark, sf):
    return _shown(ops.cold_alerts(joined(spark, sf)))


_TEXT = "CASE alert_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ops.MESSAGES.items()) + " END"
MESSAGE = f"""{_TEXT} || ' (' || variable_type || ' = ' || CAST(CAST({r('predicted_value', 1)} AS DECIMAL(20,1)) AS VARCHAR) || '°C, umbral: '
  || CAST(CAST({r('threshold_value', 1)} AS DECIMAL(20,1)) AS VARCHAR) || '°C) en ' || strftime(date, '%Y-%m-%d') || ' (+' || days_ahead || ' días)'"""


@query("alert_message", f"WITH {ALERTS} SELECT station_code, date, alert_type, {MESSAGE} AS message FROM alerts")
def _(spark, sf):
    return ops.alert_message(all_alerts(spark, sf)).select("station_code", "date", "alert_type", "message")


@query("alert_summary", f"""WITH {ALERTS} SELECT 'total' AS level, 'all' AS name, count(*) AS n FROM alerts UNION ALL SELECT 'alert_type', alert_type, count(*) FROM alerts GROUP BY 2
  UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY 2 UNION ALL SELECT 'station', station_name, count(*) FROM alerts GROUP BY 2""")
def _(spark, sf):
    return ops.alert_summary(all_alerts(spark, sf))


@query("critical_alerts_topk", f"""WITH {ALERTS}, k AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY date, alert_type) AS rk FROM alerts WHERE severity = 'critical')
  SELECT {_AS}, CAST(rk AS INTEGER) AS rank FROM k WHERE rk <= 3""")
def _(spark, sf):
    return _shown(ops.critical_alerts_topk(all_alerts(spark, sf)), "rank")


@query("alert_threshold_lines", f"""WITH {ALERTS}, k AS (SELECT *, row_number() OVER (PARTITION BY alert_type, variable_type ORDER BY date, station_code) AS rk FROM alerts)
  SELECT alert_type, variable_type, {r('threshold_value')} AS threshold_value, date AS first_date FROM k WHERE rk = 1""")
def _(spark, sf):
    d = ops.alert_threshold_lines(all_alerts(spark, sf))
    return d.withColumn("threshold_value", rnd("threshold_value"))
