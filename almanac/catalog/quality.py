"""Queries for schema detection and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.registry import query
from almanac.catalog.sql import DAILY, DAILY_SPARSE, FILLED, SERIES, WIDE, r
from almanac.functions.expr import long, rnd
from almanac.operators import quality as ops
from almanac.sources import tables as src

_OK = "count(*) FILTER (\"Día{d:02d}\" NOT IN ('*','nan','NaN',''))"


@query("detect_day_columns", f"WITH {WIDE} " + " UNION ALL ".join(
    f"""SELECT 'Día{d:02d}' AS "column", 'Día' AS prefix, {d} AS day, 31 AS max_day, {_OK.format(d=d)} AS measured,
    count(*) AS total FROM wide""" for d in range(1, 32)))
def _(spark, sf):
    return ops.detect_day_columns(src.wide(spark, sf))


@query("structure_confidence", f"WITH {WIDE}, c AS (SELECT count(*) AS rows_seen, CAST(" + " + ".join(
    _OK.format(d=d) for d in range(1, 32)) + f""" AS DOUBLE) / (count(*) * 31) AS completeness FROM wide)
  SELECT 'monthly_station_data' AS structure_type, 31 AS day_columns, rows_seen, {r('completeness')} AS completeness,
  {r('least(1.0 + 0.1 * completeness, 1.0)')} AS confidence, true AS accepted FROM c""")
def _(spark, sf):
    d = ops.structure_confidence(src.wide(spark, sf))
    return d.withColumns({"completeness": rnd("completeness"), "confidence": rnd("confidence")})


@query("detect_columns", f"""WITH {WIDE}
  SELECT 'date' AS "role", 'Fecha' AS "column", false AS "exists", CAST(0 AS BIGINT) AS non_null UNION ALL
  SELECT 'value', 'Temperatura', false, 0 UNION ALL
  SELECT 'station', 'Estación', true, count("Estación") FROM wide UNION ALL
  SELECT 'year', 'Año', true, count("Año") FROM wide UNION ALL
  SELECT 'month', 'Mes', true, count("Mes") FROM wide UNION ALL
  SELECT 'code', 'Código', true, count("Código") FROM wide""")
def _(spark, sf):
    return ops.detect_columns(src.wide(spark, sf))


@query("required_columns", f"""WITH {SERIES}, e AS (SELECT least(count(*), 100) AS n FROM series)
  SELECT c AS "column", x AS expected, a AS actual, a <> 'missing' AS present, a = x AS type_ok, n >= 100 AS enough_rows
  FROM e, (VALUES ('station_code', 'int', 'int'), ('station', 'string', 'string'), ('date', 'date', 'date'),
   ('value', 'float', 'double'), ('unit', 'string', 'missing')) v(c, x, a)""")
def _(spark, sf):
    return ops.required_columns(
        src.series(spark, sf),
        {"station_code": "int", "station": "string", "date": "date", "value": "float", "unit": "string"}, 100)


_VAR = "CASE station_code % 4 WHEN 0 THEN 'temp_min' WHEN 1 THEN 'temp_max' WHEN 2 THEN 'precipitation' ELSE 'humidity' END"


# quantities run from 1 to 50; three times that leaves every range but the rain one
@query("range_violations", f"""WITH {SERIES}, v AS (SELECT station_code, station, date, value * 3 AS value, {_VAR} AS variable FROM series),
  k AS (SELECT *, CASE WHEN value < CASE variable WHEN 'temp_min' THEN -50 WHEN 'temp_max' THEN -30 ELSE 0 END THEN 'below'
   WHEN value > CASE variable WHEN 'temp_min' THEN 60 WHEN 'temp_max' THEN 70 WHEN 'precipitation' THEN 1000 ELSE 100 END
   THEN 'above' END AS side FROM v)
  SELECT station_code, station, date, {r('value')} AS value, variable, side FROM k WHERE side IS NOT NULL""")
def _(spark, sf):
    m = F.col("station_code") % 4
    variable = (F.when(m == 0, "temp_min").when(m == 1, "temp_max").when(m == 2, "precipitation").otherwise("humidity"))
    s = src.series(spark, sf).withColumn("value", F.col("value") * 3)
    return long(ops.range_violations(s, variable), "variable", "side")


@query("missing_ratio_check", f"""WITH {DAILY}
  SELECT station_code, station, {r('avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_ratio,
    CAST(0.4 AS DOUBLE) AS missing_limit FROM daily GROUP BY 1, 2
  HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) > 0.4""")
def _(spark, sf):
    d = ops.missing_ratio_check(src.daily(spark, sf), "precipitation")
    return d.withColumn("missing_ratio", rnd("missing_ratio"))


@query("date_range_violations", f"""WITH {SERIES} SELECT station_code, station, date, {r('value')} AS value,
  CASE WHEN date < DATE '1995-06-01' THEN 'before' ELSE 'after' END AS side FROM series
  WHERE date < DATE '1995-06-01' OR date > DATE '2001-06-30'""")
def _(spark, sf):
    return long(ops.date_range_violations(src.series(spark, sf), "1995-06-01", "2001-06-30"), "side")


@query("value_validation", f"""WITH {DAILY}, s AS (SELECT station_code, station, count(*) - count(value) AS missing_count,
   avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_share, min(value) AS lo, max(value) AS hi,
   avg(value) AS mean_value, stddev_samp(value) AS std_value FROM daily GROUP BY 1, 2)
  SELECT station_code, station, missing_count, {r('missing_share')} AS missing_share, lo AS min_value, hi AS max_value,
   {r('mean_value')} AS mean_value, {r('std_value')} AS std_value,
   concat_ws(',', CASE WHEN missing_share > 0.3 THEN 'high_missing' END, CASE WHEN lo < 0 THEN 'below_minimum' END,
     CASE WHEN hi > 100 THEN 'above_maximum' END) AS warnings FROM s""")
def _(spark, sf):
    d = ops.value_validation(src.daily(spark, sf), "humidity")
    return d.withColumns({c: rnd(c) for c in ("missing_share", "mean_value", "std_value")})


@query("structure_validation", f"""WITH {WIDE} SELECT CAST(0 AS BIGINT) AS non_numeric_year, CAST(0 AS BIGINT) AS non_numeric_month,
  CAST(min("Año") AS INTEGER) AS min_year, CAST(max("Año") AS INTEGER) AS max_year, '' AS missing_columns, true AS valid FROM wide""")
def _(spark, sf):
    return ops.structure_validation(src.wide(spark, sf), ["Código", "Estación", "Año", "Mes"], "Año", "Mes")


@query("series_validity", f"""WITH {DAILY} SELECT station_code, station, count(*) AS n, count(value) AS n_known,
  CASE WHEN count(*) < 10 THEN 'too_short' WHEN count(value) = 0 THEN 'all_null' WHEN count(value) < 5 THEN 'too_few_values'
   WHEN var_pop(value) = 0 THEN 'constant' ELSE 'valid' END AS verdict FROM daily GROUP BY 1, 2""")
def _(spark, sf):
    return ops.series_validity(src.daily(spark, sf))


@query("station_input_report", f"""WITH {DAILY_SPARSE},
  e AS (SELECT station_code, station, count(*) AS n, avg(CASE WHEN value IS NULL THEN 100.0 ELSE 0.0 END) AS m,
    count(value) AS k, min(value) AS lo, max(value) AS hi FROM daily GROUP BY 1, 2),
  g AS (SELECT count(DISTINCT station) AS s, count(*) AS n, avg(CASE WHEN value IS NULL THEN 100.0 ELSE 0.0 END) AS m,
    datediff('day', min(date), max(date)) AS days FROM daily)
  SELECT station_code, station, n, {r('m')} AS missing_pct, concat_ws(',', CASE WHEN n < 10 THEN 'few_rows' END,
    CASE WHEN m > 80 THEN 'high_missing' END, CASE WHEN k > 1 AND lo = hi THEN 'constant' END) AS findings FROM e
  UNION ALL SELECT NULL, NULL, n, {r('m')}, concat_ws(',', CASE WHEN n = 0 THEN 'error_empty' END,
    CASE WHEN s = 0 THEN 'error_no_stations' END, CASE WHEN s = 1 THEN 'one_station' END,
    CASE WHEN m < 1 THEN 'few_missing' END, CASE WHEN m > 90 THEN 'error_too_many_missing' END,
    CASE WHEN days < 30 THEN 'short_range' END) FROM g""")
def _(spark, sf):
    d = ops.station_input_report(src.daily_sparse(spark, sf))
    return d.withColumn("missing_pct", rnd("missing_pct"))


@query("processed_report", f"""WITH {DAILY_SPARSE},
  g AS (SELECT count(DISTINCT station) AS n_stations, count(*) AS n_rows,
    avg(CASE WHEN value IS NULL THEN 100.0 ELSE 0.0 END) AS m,
    CAST(datediff('day', min(date), max(date)) AS INTEGER) AS range_days FROM daily)
  SELECT n_stations, n_rows, {r('m')} AS missing_pct, range_days, concat_ws(',', CASE WHEN n_rows = 0 THEN 'error_empty' END,
    CASE WHEN n_stations = 0 THEN 'error_no_stations' END, CASE WHEN n_stations = 1 THEN 'one_station' END,
    CASE WHEN m > 80 THEN 'error_too_many_missing' WHEN m > 50 THEN 'high_missing' END,
    CASE WHEN range_days < 30 THEN 'short_range' END) AS findings, n_rows > 0 AND n_stations > 0 AND m <= 80 AS passed FROM g""")
def _(spark, sf):
    d = ops.processed_report(src.daily_sparse(spark, sf))
    return d.withColumn("missing_pct", rnd("missing_pct"))


@query("quality_gate", f"""WITH {DAILY}, s AS (SELECT station_code, station, count(*) AS n,
   avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS m, min(value) AS lo, max(value) AS hi FROM daily GROUP BY 1, 2)
  SELECT station_code, station, n, {r('m')} AS missing_ratio, CAST(0 AS BIGINT) AS infinite, CAST(0 AS BIGINT) AS out_of_order,
   concat_ws(',', CASE WHEN n < 100 THEN 'too_few_rows' END, CASE WHEN n > 50000 THEN 'too_many_rows' END,
    CASE WHEN m > 0.5 THEN 'high_missing' END, CASE WHEN coalesce(lo = hi, true) THEN 'no_variation' END) AS findings,
   NOT (n < 100 OR n > 50000 OR m > 0.5 OR coalesce(lo = hi, true)) AS passed, n >= 100 AND m <= 0.3 AS model_ready FROM s""")
def _(spark, sf):
    d = ops.quality_gate(src.daily(spark, sf))
    return d.withColumn("missing_ratio", rnd("missing_ratio"))


@query("quality_gate_dirty", f"""WITH {SERIES},
  a AS (SELECT *, (station_code * 7919 + datediff('day', DATE '1970-01-01', date) * 31) % 997 AS arrival,
    CASE WHEN datediff('day', DATE '1970-01-01', date) % 50 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS v FROM series WHERE station_code % 2 = 0
    UNION ALL SELECT *, datediff('day', DATE '1970-01-01', date) AS arrival, value AS v FROM series WHERE station_code % 2 = 1),
  b AS (SELECT *, lag(date) OVER (PARTITION BY station_code ORDER BY arrival, date) > date AS back FROM a),
  s AS (SELECT station_code, station, count(*) AS n, count(*) FILTER (isinf(v)) AS infinite, count(*) FILTER (back) AS out_of_order,
    min(v) FILTER (isfinite(v)) AS lo, max(v) FILTER (isfinite(v)) AS hi FROM b GROUP BY 1, 2)
  SELECT station_code, station, n, 0.0::DOUBLE AS missing_ratio, infinite, out_of_order,
   concat_ws(',', CASE WHEN n < 100 THEN 'too_few_rows' END, CASE WHEN infinite > 0 THEN 'infinite_values' END,
    CASE WHEN coalesce(lo = hi, true) THEN 'no_variation' END, CASE WHEN out_of_order > 0 THEN 'dates_not_sorted' END) AS findings,
   NOT (n < 100 OR infinite > 0 OR coalesce(lo = hi, true) OR out_of_order > 0) AS passed, n >= 100 AS model_ready FROM s""")
def _(spark, sf):
    """Half of the stations arrive unsorted and hold infinities; the order of arrival is what is tested."""
    s = src.series(spark, sf)
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("bigint")
    even = F.col("station_code") % 2 == 0
    dirty = s.withColumns({
        "arrival": F.struct(F.when(even, (F.col("station_code") * 7919 + day * 31) % 997).otherwise(day).alias("a"), F.col("date")),
        "value": F.when(even & (day % 50 == 0), F.lit(float("inf"))).otherwise(F.col("value"))})
    d = ops.quality_gate(dirty, order="arrival")
    return d.withColumn("missing_ratio", rnd("missing_ratio"))
