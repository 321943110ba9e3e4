"""Queries for scans, sinks and the whole run. Each writes below the shared scratch folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.alerts import ALERTS, _A, _AS, all_alerts
from almanac.catalog.components import CK, CKS, COMP, VAR, comp_cut, sel
from almanac.catalog.registry import query
from almanac.catalog.sql import DAILY, FILLED, LONG2, SERIES, THRESHOLDS, WIDE, r
from almanac.catalog.stats import BOTH, CHANGES, _METRICS, _both
from almanac.functions.expr import long, rnd, shown
from almanac.operators import alerts as alert_ops
from almanac.operators import components as cops
from almanac.operators import models
from almanac.operators import stats as stat_ops
from almanac.plans import job
from almanac.plans.lineage import cut, scratch_path
from almanac.sources import readers, tables as src, writers

KEYS = ["station_code", "station"]
DAYS = [f"Día{d:02d}" for d in range(1, 32)]


@query("scan_monthly_csv", f"""WITH {WIDE} SELECT CAST("Código" AS INTEGER) AS code, "Estación" AS station, CAST("Año" AS INTEGER) AS year, CAST("Mes" AS INTEGER) AS month,
  {', '.join(f'''nullif("{c}", '') AS "{c}"''' for c in DAYS)} FROM wide""")
def _(spark, sf):
    path = scratch_path(spark, "monthly")
    src.wide(spark, sf).write.option("header", True).csv(path)
    return readers.scan_monthly_csv(spark, path).select(
        F.col("Código").alias("code"), F.col("Estación").alias("station"), F.col("Año").alias("year"),
        F.col("Mes").alias("month"), *DAYS)


@query("scan_station_files", f"""WITH {FILLED} SELECT station_code, station_code || '_' || station || '_Imputed' AS station, date, {r('value')} AS value FROM filled""")
def _(spark, sf):
    path = scratch_path(spark, "stations")
    filled = src.filled(spark, sf).select(*KEYS, "date", "value")
    writers.write_series(filled, path)
    return long(readers.scan_station_files(spark, path))


@query("scan_station_tables", f"""WITH {FILLED} SELECT station_code, station, date, {r('value')} AS value FROM filled""")
def _(spark, sf):
    """Three layouts in one tree: other orders, names and date formats, with columns of no interest between."""
    path = scratch_path(spark, "tables")
    rows = cut(src.filled(spark, sf))
    m = F.col("station_code") % 3
    text = F.col("value").cast("string")
    layouts = [
        rows.where(m == 0).select(F.date_format("date", "dd/MM/yyyy").alias("Fecha"), F.lit("x").alias("Nota"), text.alias("Temperatura"),
                                  F.col("station").alias("Estación"), F.col("station_code").alias("Código")),
        rows.where(m == 1).select(F.col("station_code").alias("code"), text.alias("value"), F.date_format("date", "yyyy-MM-dd").alias("measured_date"),
                                  F.col("station").alias("STATION")),
        rows.where(m == 2).select(F.lit(1).alias("row"), F.col("station").alias("station"), F.col("station_code").alias("codigo"), F.lit(None).cast("string").alias("gap"),
                                  text.alias("Tmax"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))]
    for i, layout in enumerate(layouts):
        layout.write.option("header", True).csv(f"{path}/layout{i}")
    return long(readers.scan_station_tables(spark, path))


@query("parse_date_column", f"""WITH {SERIES} SELECT station_code, station, date, {r('value')} AS value FROM series""")
def _(spark, sf):
    m = F.col("station_code") % 3
    text = (F.when(m == 0, F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")).when(m == 1, F.date_format("date", "yyyy-MM-dd"))
            .otherwise(F.date_format("date", "dd/MM/yyyy")))
    raw = src.series(spark, sf).select(*KEYS, text.alias("Fecha_medicion"), "value")
    return long(readers.parse_date_column(raw))


# rows with unequal codes, a missing number, or no name, as they occur in sheets
@query("load_thresholds", f"""WITH {SERIES}, {THRESHOLDS} SELECT station_code, CASE WHEN station_code % 7 = 2 THEN 'Estación_' || station_code ELSE station END AS station,
  {', '.join(f"{r(p)} AS {p}_{v}" for p in ('p5', 'p10', 'p90', 'p95') for v in ('tmax', 'tmin'))} FROM thresholds WHERE station_code % 7 NOT IN (3, 5)""")
def _(spark, sf):
    t = src.thresholds(spark, sf)
    code, m = F.col("station_code"), F.col("station_code") % 7
    name = F.when(m != 2, F.col("station"))
    sheet = t.select(
        code.cast("string").alias("code_c"), name.alias("name_c"), "p5_tmax", F.when(m != 5, F.col("p5_tmin")).alias("p5_tmin"),
        "p10_tmax", "p10_tmin", F.lit(None).cast("string").alias("gap"),
        F.when(m == 3, code + 1).otherwise(code).cast("string").alias("code_h"), name.alias("name_h"),
        "p95_tmax", "p95_tmin", "p90_tmax", "p90_tmin")
    path = scratch_path(spark, "sheet")
    sheet.write.csv(path)
    # three heading rows, as a sheet exports them
    heading = spark.range(3).select(*[F.lit(c).alias(c) for c in readers.SHEET_COLUMNS])
    heading.write.mode("append").csv(path)
    d = readers.load_thresholds(readers.scan_sheet(spark, path))
    return shown(d, KEYS, [f"{p}_{v}" for p in ("p5", "p10", "p90", "p95") for v in ("tmax", "tmin")])


@query("source_profile", f"""WITH {SERIES}, h AS (SELECT * FROM series)
  SELECT count(*) AS n_rows, 4 AS n_columns, 'station_code,station,date,value' AS column_names, min(date) AS first_date, max(date) AS last_date,
   array_to_string(list_sort(list_distinct(list(station)))[1:10], ',') AS stations, min(value) AS min_value, max(value) AS max_value,
   {r('avg(value)')} AS mean_value, {r('stddev_samp(value)')} AS std_value FROM h""")
def _(spark, sf):
    d = readers.source_profile(src.series(spark, sf))
    return d.withColumns({"mean_value": rnd("mean_value"), "std_value": rnd("std_value")})


_FILES = ("temp_min_2020", "maxima_diaria", "Precip_total", "humedad_rel", "otros")
_VARS = ("temp_min", "temp_max", "precipitation", "humidity", "temperature")


@query("variable_from_path", f"""WITH {SERIES} SELECT station_code, station, date, {r('value')} AS value,
  CASE station_code % 5 {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_VARS))} END AS variable,
  CASE station_code % 5 WHEN 2 THEN 'mm' WHEN 3 THEN '%' ELSE '°C' END AS unit FROM series""")
def _(spark, sf):
    path = scratch_path(spark, "variables")
    name = F.element_at(F.array(*[F.lit(f"{f}.csv") for f in _FILES]), F.col("station_code") % 5 + 1)
    src.series(spark, sf).withColumn("file", name).write.option("header", True).partitionBy("file").csv(path)
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).schema(
        "station_code INT, station STRING, date DATE, value DOUBLE").csv(path)
    return long(readers.variable_from_path(rows, F.col("_metadata.file_path")), "variable", "unit")


_LINEAR = f"WITH {FILLED} SELECT station_code, station, date, {r('value')} AS value FROM filled"
_LONG_SCHEMA = "station_code INT, station STRING, date DATE, value DOUBLE"


@query("write_series", _LINEAR)
def _(spark, sf):
    path = scratch_path(spark, "series")
    writers.write_series(src.filled(spark, sf).select(*KEYS, "date", "value"), path, "parquet")
    return long(spark.read.option("recursiveFileLookup", True).parquet(path))


@query("write_consolidated", _LINEAR + " WHERE station_code % 4 <> 1")
def _(spark, sf):
    path = scratch_path(spark, "all_stations")
    status = F.when(F.col("station_code") % 4 == 1, "failed").otherwise("success")
    writers.write_consolidated(src.filled(spark, sf).select(*KEYS, "date", "value", status.alias("status")), path)
    return long(spark.read.option("header", True).schema(_LONG_SCHEMA).csv(path))


@query("write_reports", f"WITH {BOTH}, {CHANGES} " + " UNION ALL ".join(
    f"SELECT station_code, station, '{m}' AS metric, {r(m, 3)} AS metric_value FROM ba" for m in _METRICS))
def _(spark, sf):
    path = scratch_path(spark, "reports")
    report = stat_ops.before_after(_both(spark, sf))
    writers.write_reports(report, stat_ops.report_long(report), path)
    back = spark.read.option("header", True).schema(
        "station_code INT, station STRING, metric STRING, metric_value DOUBLE").csv(f"{path}/metrics")
    return back.withColumn("metric_value", rnd("metric_value", 3))


@query("write_components", f"""WITH {COMP}, {VAR}, n AS (SELECT {CKS}, count(*) AS n, {r('avg(value)')} AS mean_value FROM comp GROUP BY 1, 2, 3)
  SELECT {CKS}, n, mean_value, {r('explained_ratio')} AS explained_ratio FROM n JOIN p_var USING ({CKS})""")
def _(spark, sf):
    path = scratch_path(spark, "components")
    c = comp_cut(spark, sf)
    writers.write_components(c, cops.variance_explained(c), cops.component_correlation(c), cops.component_quality(c), path)
    rows = spark.read.parquet(f"{path}/components").groupBy(*CK).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("mean_value"))
    var = spark.read.parquet(f"{path}/variance").select(*CK, rnd("explained_ratio").alias("explained_ratio"))
    return rows.join(var, CK)


@query("write_alerts", f"WITH {ALERTS} SELECT {_AS} FROM alerts")
def _(spark, sf):
    path = scratch_path(spark, "alerts")
    a = all_alerts(spark, sf)
    writers.write_alerts(a, alert_ops.alert_summary(a), path)
    schema = ("station_name STRING, alert_type STRING, severity STRING, date DATE, predicted_value DOUBLE, "
              "threshold_value DOUBLE, variable_type STRING, days_ahead INT, station_code INT")
    return shown(spark.read.schema(schema).json(f"{path}/alerts_json"), _A, ["predicted_value", "threshold_value"])


# two saves and a delete: stations under 5 end on version 3, codes divisible by 6 are gone
@query("model_table", f"""WITH {SERIES}, s AS (SELECT DISTINCT station_code, station FROM series)
  SELECT 'temp_max' AS variable, station_code, station, CASE WHEN station_code < 5 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS saved_on,
   CAST(5 AS BIGINT) AS n_models, 'lag' AS classes FROM s WHERE station_code % 6 <> 0""")
def _(spark, sf):
    path = scratch_path(spark, "models")
    fitted = models.lag_model_fit(comp_cut(spark, sf)).withColumn("model_class", F.lit("lag"))
    writers.save_models(fitted, path, "temp_max", 1, "2024-01-01")
    saved = spark.read.parquet(path)
    writers.save_models(saved.filter(F.col("station_code") < 5), path, "temp_max", 2, "2024-02-01")
    gone = saved.select("station_code").filter(F.col("station_code") % 6 == 0).distinct()
    writers.delete_models(spark, path, gone, "temp_max", 3, "2024-03-01")
    return writers.list_models(spark, path)


@query("full_run")
def _(spark, sf):
    out = job.run(src.wide(spark, sf), "temp_max", thresholds=src.thresholds(spark, sf))
    return out["predictions"].join(out["status"].select(*KEYS, "status"), KEYS).select(
        *KEYS, "date", "type", "status", *[rnd(c).alias(c) for c in ("value", "lower_ci", "upper_ci")])


@query("full_run_rain")
def _(spark, sf):
    out = job.run(src.rain(spark, sf), "precipitation")
    return out["predictions"].filter(F.col("type") == "prediction").select(
        *KEYS, "date", *[rnd(c).alias(c) for c in ("value", "lower_ci", "upper_ci")])


# the run's first stages are exact: calendar from the wide table, and the station report
@query("full_run_preprocess", f"""WITH {LONG2.replace('series AS MATERIALIZED', 'series0 AS MATERIALIZED').replace('FROM series)', 'FROM series0)').replace('long2 AS', 'series AS')},
  {DAILY[DAILY.index('daily AS MATERIALIZED'):]} SELECT station_code, station, date, pos, value FROM daily""")
def _(spark, sf):
    return job.run(src.wide(spark, sf), stage="preprocess")["daily"].select(*KEYS, "date", "pos", "value")


@query("full_run_status", f"""WITH {DAILY} SELECT station_code, station, count(*) AS total_count, count(*) - count(value) AS original_missing,
  count(*) AS cleaned_count, count(*) - count(value) AS imputed_count, CAST(0 AS BIGINT) AS remaining_missing, 'success' AS status FROM daily GROUP BY 1, 2""")
def _(spark, sf):
    rep = job.run(src.series(spark, sf), stage="imputation")["report"]
    return rep.select(*KEYS, "total_count", "original_missing", "cleaned_count", "imputed_count", "remaining_missing", "status")


@query("full_run_delivered")
def _(spark, sf):
    """The run's sinks, read back: predictions with their status, and the saved models of their station."""
    path = scratch_path(spark, "delivered")
    job.run(src.wide(spark, sf), "temp_max", thresholds=src.thresholds(spark, sf), sink=path)
    table = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/predictions")
    models = writers.list_models(spark, f"{path}/models").select("station_code", "n_models")
    series = spark.read.option("header", True).csv(f"{path}/series").groupBy(F.col("station_code").cast("int").alias("station_code")).agg(
        F.count(F.lit(1)).alias("series_rows"))
    return table.where("type = 'prediction'").join(models, "station_code").join(series, "station_code").select(
        *KEYS, "date", "n_models", "series_rows", *[rnd(c).alias(c) for c in ("value", "lower_ci", "upper_ci")])


@query("full_run_checks")
def _(spark, sf):
    """Which components the filter keeps, which may be modelled, and whether the station's decomposition passes."""
    out = job.run(src.wide(spark, sf), "temp_max")
    return out["checks"].join(out["acceptance"], KEYS).join(out["gate"].select(*KEYS, "model_ready"), KEYS).select(
        *KEYS, "component", "kept", "eligible", "accepted", "checks_passed", "model_ready", *[rnd(c).alias(c) for c in ("explained_ratio", "quality")])
