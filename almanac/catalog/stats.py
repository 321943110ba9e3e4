"""Queries for aggregations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.impute import REPORT, _report
from almanac.catalog.registry import query
from almanac.catalog.sql import DAILY, DAILY_SPARSE, FILLED, linear, r
from almanac.functions.expr import rnd, shown
from almanac.operators import stats as ops
from almanac.operators.impute import impute_linear
from almanac.plans.lineage import cut
from almanac.sources import tables as src

KEYS = ["station_code", "station"]


@query("value_statistics", f"""WITH {DAILY} SELECT min(value) AS min_value, max(value) AS max_value, {r('avg(value)')} AS mean_value,
  count(*) - count(value) AS missing, count(*) AS total, {r('avg(CASE WHEN value IS NULL THEN 0.0 ELSE 100.0 END)', 2)} AS completeness,
  min(date) AS first_date, max(date) AS last_date, count(DISTINCT station_code) AS stations FROM daily""")
def _(spark, sf):
    d = ops.value_statistics(src.daily(spark, sf))
    return d.withColumns({"mean_value": rnd("mean_value"), "completeness": rnd("completeness", 2)})


@query("station_statistics", f"""WITH {DAILY} SELECT station_code, station, min(value) AS min_value, max(value) AS max_value,
  {r('avg(value)')} AS mean_value, {r('stddev_samp(value)')} AS std_value, count(value) AS known,
  count(*) - count(value) AS missing FROM daily GROUP BY 1, 2""")
def _(spark, sf):
    d = ops.station_statistics(src.daily(spark, sf))
    return d.withColumns({"mean_value": rnd("mean_value"), "std_value": rnd("std_value")})


@query("missing_by_column", f"WITH {DAILY} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, count(*) AS total,
    {r(f'CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100')} AS missing_pct FROM daily"""
    for c in ("station_code", "station", "date", "pos", "value")))
def _(spark, sf):
    return ops.missing_by_column(src.daily(spark, sf)).withColumn("missing_pct", rnd("missing_pct"))


BASIC = f"""count(value) AS n, {r('avg(value)', 3)} AS mean, {r('stddev_samp(value)', 3)} AS std, {r('min(value)', 3)} AS min,
  {r('max(value)', 3)} AS max, {r('skewness(value)', 3)} AS skew, {r('kurtosis(value)', 3)} AS kurtosis,
  {r('quantile_cont(value, 0.25)', 3)} AS q25, {r('quantile_cont(value, 0.5)', 3)} AS median,
  {r('quantile_cont(value, 0.75)', 3)} AS q75"""


@query("basic_statistics", f"WITH {FILLED} SELECT station_code, station, {BASIC} FROM filled GROUP BY 1, 2")
def _(spark, sf):
    return ops.basic_statistics(src.filled(spark, sf))


def fit_sql(src_name, keys):
    return f"""num AS (SELECT {keys}, value AS y, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS x
      FROM {src_name} WHERE value IS NOT NULL),
    fit AS MATERIALIZED (SELECT *, sign(slope) * sqrt(r2 * (n - 2) / nullif(1 - r2, 0)) AS t FROM (
      SELECT {keys}, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2
      FROM num GROUP BY ALL))"""


# two-sided 5% point of Student's t, by its expansion around the normal one
TCRIT = """(1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4.0 * (n - 2))
  + (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / (96.0 * pow(n - 2, 2)))"""
DIRECTION = f"""CASE WHEN n < 10 THEN 'insufficient_data' WHEN abs(t) > {TCRIT} AND slope > 0 THEN 'increasing'
  WHEN abs(t) > {TCRIT} THEN 'decreasing' ELSE 'no_significant_trend' END"""


@query("trend_analysis", f"""WITH {FILLED}, {fit_sql('filled', 'station_code, station')}
  SELECT station_code, station, n, {r('slope', 6)} AS slope, {r('intercept', 3)} AS intercept, {r('r2', 3)} AS r2,
   {r('t')} AS t, {DIRECTION} AS direction,
   CASE WHEN n < 10 THEN 'insufficient_data' WHEN abs(t) > {TCRIT} THEN
    CASE WHEN r2 > 0.7 THEN 'strong' WHEN r2 > 0.3 THEN 'moderate' ELSE 'weak' END ELSE 'no_significant_trend' END AS strength
  FROM fit""")
def _(spark, sf):
    t = ops.trend_analysis(src.filled(spark, sf))
    return t.select(*KEYS, "n", rnd("slope", 6).alias("slope"), rnd("intercept", 3).alias("intercept"),
                    rnd("r2", 3).alias("r2"), rnd("t").alias("t"), "direction", "strength")


@query("trend_p_value")
def _(spark, sf):
    return shown(ops.trend_analysis(src.filled(spark, sf)), [*KEYS, "n"], ["t", "p_value"], 6)


OUT = """value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""


def outliers_sql(src_name, keys):
    return f"""q AS (SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {src_name} GROUP BY ALL),
    o AS MATERIALIZED (SELECT {keys}, any_value(q1) AS q1, any_value(q3) AS q3, count(value) AS n, count(*) FILTER ({OUT}) AS outliers
     FROM {src_name} JOIN q USING ({keys}) GROUP BY ALL)"""


@query("iqr_outliers", f"""WITH {FILLED}, {outliers_sql('filled', 'station_code, station')} SELECT station_code, station,
  {r('q1')} AS q1, {r('q3')} AS q3, n, outliers, {r('CAST(outliers AS DOUBLE) / n * 100')} AS outlier_pct FROM o""")
def _(spark, sf):
    return shown(ops.outlier_counts(src.filled(spark, sf)), [*KEYS, "n", "outliers"], ["q1", "q3", "outlier_pct"])


@query("iqr_outliers_events", f"""WITH {outliers_sql('events', 'event_type')} SELECT event_type,
  {r('q1')} AS q1, {r('q3')} AS q3, n, outliers, {r('CAST(outliers AS DOUBLE) / n * 100')} AS outlier_pct FROM o""")
def _(spark, sf):
    ev = src.table(spark, sf, "events").select("event_type", "value")
    d = ops.outlier_counts(ev, ["event_type"], bounded=False)
    return shown(d, ["event_type", "n", "outliers"], ["q1", "q3", "outlier_pct"])


BOTH = f"""{DAILY}, {linear('daily', 'filled')},
  ver AS MATERIALIZED (SELECT station_code, station, date, value, 'original' AS version FROM daily
    UNION ALL SELECT station_code, station, date, value, 'imputed' FROM filled)"""


def _both(spark, sf):
    """Both states of the series, written once: the reports read them several times."""
    daily = src.daily(spark, sf)
    return cut(ops.versions(daily, impute_linear(daily)))


def _piv(c):
    return f"max(CASE WHEN version = 'original' THEN {c} END) AS original_{c}, max(CASE WHEN version = 'imputed' THEN {c} END) AS imputed_{c}"


@query("quality_metrics", f"""WITH {BOTH}, {outliers_sql('ver', 'station_code, station, version')},
  b AS (SELECT station_code, station, version, avg(CASE WHEN value IS NULL THEN 0.0 ELSE 1.0 END) AS completeness,
    coalesce(stddev_samp(value) / nullif(avg(value), 0), 0.0) AS cv FROM ver GROUP BY 1, 2, 3),
  j AS (SELECT station_code, station, {_piv('completeness')}, {_piv('cv')}, {_piv('outliers')}, {_piv('outlier_pct')}
    FROM (SELECT b.*, o.outliers, CAST(o.outliers AS DOUBLE) / o.n * 100 AS outlier_pct
      FROM b JOIN o USING (station_code, station, version)) GROUP BY 1, 2)
  SELECT station_code, station, original_outliers, imputed_outliers, {', '.join(f"{r(c, 3)} AS {c}" for c in
    ('original_completeness', 'imputed_completeness', 'original_cv', 'imputed_cv', 'original_outlier_pct', 'imputed_outlier_pct'))},
   {r('imputed_completeness - original_completeness', 3)} AS improvement, {r('imputed_cv - original_cv', 3)} AS cv_change FROM j""")
def _(spark, sf):
    return shown(ops.quality_metrics(_both(spark, sf)), [*KEYS, "original_outliers", "imputed_outliers"],
                 ["original_completeness", "imputed_completeness", "original_cv", "imputed_cv",
                  "original_outlier_pct", "imputed_outlier_pct", "improvement", "cv_change"], 3)


MISSING = """mc AS (SELECT station_code, station,
    count(*) FILTER (version = 'original' AND value IS NULL) AS original_missing,
    count(*) FILTER (version = 'imputed' AND value IS NULL) AS imputed_missing,
    count(*) FILTER (version = 'original') AS ot, count(*) FILTER (version = 'imputed') AS it FROM ver GROUP BY 1, 2),
  mis AS MATERIALIZED (SELECT station_code, station, original_missing, imputed_missing, ot AS original_records, it AS imputed_records,
    CAST(original_missing AS DOUBLE) / ot * 100 AS original_missing_pct, CAST(imputed_missing AS DOUBLE) / it * 100 AS imputed_missing_pct,
    original_missing - imputed_missing AS imputed_values,
    coalesce(CAST(original_missing - imputed_missing AS DOUBLE) / nullif(original_missing, 0) * 100, 0.0) AS imputation_rate FROM mc)"""


@query("missing_comparison", f"""WITH {BOTH}, {MISSING} SELECT station_code, station, original_missing, imputed_missing, imputed_values,
  {r('original_missing_pct', 2)} AS original_missing_pct, {r('imputed_missing_pct', 2)} AS imputed_missing_pct,
  {r('imputation_rate', 2)} AS imputation_rate FROM mis""")
def _(spark, sf):
    return shown(ops.missing_comparison(_both(spark, sf)),
                 [*KEYS, "original_missing", "imputed_missing", "imputed_values"],
                 ["original_missing_pct", "imputed_missing_pct", "imputation_rate"], 2)


_N = ("mean", "std", "min", "max", "r2")
CHANGES = f"""{fit_sql('ver', 'station_code, station, version')},
  bs AS (SELECT station_code, station, version, {BASIC} FROM ver GROUP BY 1, 2, 3),
  pv AS MATERIALIZED (SELECT station_code, station, {', '.join(_piv(c) for c in ('n', *_N))}
    FROM (SELECT bs.*, {r('f.r2', 3)} AS r2 FROM bs JOIN fit f USING (station_code, station, version)) GROUP BY 1, 2),
  ba AS MATERIALIZED (SELECT *, {', '.join(f"(imputed_{c} - original_{c}) / nullif(original_{c}, 0) * 100 AS {c}_change_pct" for c in _N)},
    imputed_n > original_n AS completeness_improved,
    coalesce(original_std <> 0, false) AND abs(imputed_std - original_std) < original_std * 0.1 AS variance_preserved,
    coalesce(original_std <> 0, false) AND abs(imputed_min - original_min) < original_std * 0.5
      AND abs(imputed_max - original_max) < original_std * 0.5 AS range_preserved FROM pv)"""
_BA_PLAIN = [*KEYS, "original_n", "imputed_n", *[c for k in _N for c in (f"original_{k}", f"imputed_{k}")],
             "completeness_improved", "variance_preserved", "range_preserved"]
_BA_ROUND = [f"{c}_change_pct" for c in _N]
_BA_SQL = ", ".join([*_BA_PLAIN, *[f"{r(c, 2)} AS {c}" for c in _BA_ROUND]])


@query("before_after", f"WITH {BOTH}, {CHANGES} SELECT {_BA_SQL} FROM ba")
def _(spark, sf):
    return shown(ops.before_after(_both(spark, sf)), _BA_PLAIN, _BA_ROUND, 2)


_METRICS = ["original_n", "imputed_n", *[c for k in _N for c in (f"original_{k}", f"imputed_{k}")], *_BA_ROUND]


@query("report_long", f"WITH {BOTH}, {CHANGES} " + " UNION ALL ".join(
    f"SELECT station_code, station, '{m}' AS metric, {r(m, 3)} AS metric_value FROM ba" for m in _METRICS))
def _(spark, sf):
    return ops.report_long(ops.before_after(_both(spark, sf))).withColumn("metric_value", rnd("metric_value", 3))


@query("stations_summary", f"""WITH {BOTH}, {MISSING}, {CHANGES},
  tr AS (SELECT station_code, station, version, {DIRECTION} AS trend FROM fit),
  tp AS (SELECT station_code, station, {_piv('trend')} FROM tr GROUP BY 1, 2)
  SELECT station_code, station, original_records, imputed_records, original_mean, imputed_mean, original_std, imputed_std,
   completeness_improved, variance_preserved, range_preserved, original_missing, imputed_values,
   {r('imputation_rate', 2)} AS imputation_rate, original_trend, imputed_trend
  FROM mis JOIN ba USING (station_code, station) JOIN tp USING (station_code, station)""")
def _(spark, sf):
    return ops.stations_summary(_both(spark, sf)).withColumn("imputation_rate", rnd("imputation_rate", 2))


@query("overall_summary", f"""WITH {BOTH}, {MISSING}, {CHANGES}
  SELECT count(*) AS total_stations, {r('avg(imputation_rate)')} AS average_imputation_rate,
   {r('avg(mean_change_pct)')} AS mean_change_pct, {r('avg(std_change_pct)')} AS std_change_pct
  FROM mis JOIN ba USING (station_code, station)""")
def _(spark, sf):
    return shown(ops.overall_summary(_both(spark, sf)), ["total_stations"],
                 ["average_imputation_rate", "mean_change_pct", "std_change_pct"])


@query("run_summary", f"""WITH {DAILY_SPARSE}, {REPORT} SELECT count(*) AS stations_total,
  count(*) FILTER (status <> 'failed') AS stations_ok, count(*) FILTER (status = 'failed') AS stations_failed,
  CAST(sum(total_count) AS BIGINT) AS rows_in, CAST(sum(cleaned_count) AS BIGINT) AS rows_out,
  {r("CAST(count(*) FILTER (status <> 'failed') AS DOUBLE) / count(*) * 100", 2)} AS success_rate,
  {r('CAST(sum(cleaned_count) AS DOUBLE) / CAST(sum(total_count) AS DOUBLE) * 100', 2)} AS row_efficiency FROM report""")
def _(spark, sf):
    d = ops.run_summary(_report(spark, sf))
    return d.withColumns({"success_rate": rnd("success_rate", 2), "row_efficiency": rnd("row_efficiency", 2)})


@query("histogram", f"""WITH {FILLED}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM filled)
  SELECT CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin,
   {r('any_value(lo) + least(floor((value - lo) / ((hi - lo) / 30)), 29) * ((any_value(hi) - any_value(lo)) / 30)')} AS bin_start,
   count(*) AS n FROM filled, b GROUP BY least(floor((value - lo) / ((hi - lo) / 30)), 29)""")
def _(spark, sf):
    return ops.histogram(src.filled(spark, sf)).withColumn("bin_start", rnd("bin_start"))


@query("boxplot_stats", f"""SELECT o_orderpriority, {', '.join(f"{r(f'quantile_cont(o_totalprice, {p})', 3)} AS {n}" for n, p in
  (('min', 0.0), ('q1', 0.25), ('median', 0.5), ('q3', 0.75), ('max', 1.0)))} FROM orders GROUP BY 1""")
def _(spark, sf):
    o = src.table(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").alias("value"))
    return shown(ops.boxplot_stats(o, ["o_orderpriority"]), ["o_orderpriority"], ["min", "q1", "median", "q3", "max"], 3)
