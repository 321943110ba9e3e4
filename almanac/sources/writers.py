"""Sinks. Files are partitioned by station; consolidated tables are one dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators.reshape import sanitize_name

KEYS = ["station_code", "station"]


def write_series(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Long series, one folder per station named like an imputed station file.

    Rows are first brought together by station, so a station becomes few files and not one
    per task; a station over the size limit is split by adaptive execution.
    """
    name = F.concat_ws("_", F.col("station_code").cast("string"), sanitize_name(F.col("station")), F.lit("Imputed.csv"))
    out = df.withColumn("station_file", name).hint("rebalance", "station_file")
    out.write.mode("errorifexists").option("header", True).partitionBy("station_file").format(fmt).save(path)


def write_consolidated(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Rows of the successful stations as one dataset."""
    kept = df.filter(F.col("status") == "success").drop("status") if "status" in df.columns else df
    kept.write.mode("errorifexists").option("header", True).format(fmt).save(path)


def write_reports(report: DataFrame, metrics: DataFrame, path: str) -> None:
    """Station reports as JSON lines, metric/value rows and the station summary as CSV."""
    rest = [c for c in report.columns if c not in KEYS]
    report.select(*KEYS, F.to_json(F.struct(*rest)).alias("report")).write.json(f"{path}/station_reports")
    metrics.write.option("header", True).csv(f"{path}/metrics")
    report.write.option("header", True).csv(f"{path}/stations_summary")


def write_components(comp: DataFrame, variance: DataFrame, correlation: DataFrame, quality: DataFrame, path: str) -> None:
    """Components by station, and one table each for variance, correlation and quality."""
    comp.hint("rebalance", "station_code").write.partitionBy("station_code").parquet(f"{path}/components")
    for name, table in (("variance", variance), ("correlation", correlation), ("quality", quality)):
        table.write.parquet(f"{path}/{name}")


def write_alerts(alerts: DataFrame, summary: DataFrame, path: str) -> None:
    """Alerts as JSON and CSV by station, and their summary as JSON."""
    by_station = alerts.hint("rebalance", "station_code")
    by_station.write.partitionBy("station_code").json(f"{path}/alerts_json")
    by_station.write.partitionBy("station_code").option("header", True).csv(f"{path}/alerts_csv")
    summary.write.json(f"{path}/alerts_summary")


# -- models as rows ------------------------------------------------------------
# The table only grows: a save appends a version, a delete appends tombstones, and reading
# takes the newest version per key. No file is ever replaced, so a lost job cannot leave a
# half-written model, and readers need no lock.

MODEL_KEYS = ["variable", "station_code", "station", "component"]


def save_models(models: DataFrame, path: str, variable: str, version: int, saved_on: str) -> None:
    models.select(
        F.lit(variable).alias("variable"), "station_code", "station", "component", "model_class", "coefficients",
        F.lit(saved_on).cast("date").alias("saved_on"), F.lit(version).alias("version"), F.lit(False).alias("deleted"),
    ).write.mode("append").parquet(path)


def delete_models(spark: SparkSession, path: str, stations: DataFrame, variable: str, version: int, saved_on: str) -> None:
    """Tombstones for all models of the given stations."""
    gone = load_models(spark, path).filter(F.col("variable") == variable).join(
        stations.select("station_code"), "station_code", "left_semi")
    gone.select(
        *MODEL_KEYS, "model_class", "coefficients", F.lit(saved_on).cast("date").alias("saved_on"),
        F.lit(version).alias("version"), F.lit(True).alias("deleted"),
    ).write.mode("append").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    rest = ["model_class", "coefficients", "saved_on", "version", "deleted"]
    newest = spark.read.parquet(path).groupBy(*MODEL_KEYS).agg(
        F.max_by(F.struct(*rest), "version").alias("m"))
    return newest.select(*MODEL_KEYS, "m.*").filter(~F.col("deleted")).drop("deleted")


def list_models(spark: SparkSession, path: str) -> DataFrame:
    """Saved stations with variable, date and the classes of their components."""
    return load_models(spark, path).groupBy("variable", "station_code", "station").agg(
        F.max("saved_on").alias("saved_on"), F.count(F.lit(1)).alias("n_models"),
        F.concat_ws(",", F.array_sort(F.collect_set("model_class"))).alias("classes"))
