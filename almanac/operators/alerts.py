"""Heat and cold alerts from predictions and station thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.expr import rnd

# Alert names by direction and strength.
HEAT, HEAT_EXTREME = "heat_wave", "heat_wave_extreme"
COLD, COLD_EXTREME = "cold_wave", "cold_wave_extreme"
CRITICAL, WARNING = "critical", "warning"

# Message texts; value, threshold, date and days are filled in.
MESSAGES = {
    HEAT_EXTREME: "[CRITICAL] ALERTA CRÍTICA: Ola de calor extrema detectada",
    HEAT: "[WARNING] ALERTA: Ola de calor moderada detectada",
    COLD_EXTREME: "⚠️ ALERTA CRÍTICA: Ola de frío extrema detectada",
    COLD: "[WARNING] ALERTA: Ola de frío moderada detectada",
}


def normal_code(code: Column, name: Column) -> Column:
    """The code as a number, else the leading digits of the station name."""
    lead = F.regexp_extract(name, r"^(\d+)", 1).try_cast("int")
    return F.coalesce(code.cast("string").try_cast("int"), lead)


def alert_threshold_join(predictions: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Predictions with their station's thresholds; stations without thresholds are skipped.

    Both sides meet on the code, so Spark broadcasts the thresholds where its size check allows.
    """
    rest = [c for c in thresholds.columns if c != "station_code"]
    limits = (thresholds.groupBy(F.col("station_code").alias("code")).agg(F.min(F.struct(*rest)).alias("r"))  # a code once
              .select("code", "r.*").withColumnRenamed("station", "threshold_station"))
    return predictions.withColumn("code", normal_code(F.col("station_code"), F.col("station"))).join(limits, "code")


def stations_without_thresholds(predictions: DataFrame, thresholds: DataFrame) -> DataFrame:
    stations = predictions.select(
        normal_code(F.col("station_code"), F.col("station")).alias("code"), "station").distinct()
    return stations.join(thresholds.select(F.col("station_code").alias("code")), "code", "left_anti")


def detect_alerts(joined: DataFrame) -> DataFrame:
    """Heat and cold alerts in one pass; the extreme limit is tested first.

    Maximum temperature at or over the 95th percentile is critical, over the 90th a warning;
    minimum temperature at or under the 5th is critical, under the 10th a warning.
    """
    v, hot, cold = F.col("value"), F.col("variable") == "temp_max", F.col("variable") == "temp_min"
    rules = (
        (hot & (v >= F.col("p95_tmax")), HEAT_EXTREME, CRITICAL, "p95_tmax"),
        (hot & (v >= F.col("p90_tmax")), HEAT, WARNING, "p90_tmax"),
        (cold & (v <= F.col("p5_tmin")), COLD_EXTREME, CRITICAL, "p5_tmin"),
        (cold & (v <= F.col("p10_tmin")), COLD, WARNING, "p10_tmin"),
    )
    hit = F.lit(None)
    for cond, kind, severity, limit in reversed(rules):
        found = F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col(limit).alias("threshold"))
        hit = F.when(cond, found).otherwise(hit)
    return joined.withColumn("hit", hit).filter(F.col("hit").isNotNull()).select(
        F.col("code").alias("station_code"), F.col("station").alias("station_name"), F.col("hit.kind").alias("alert_type"),
        F.col("hit.severity").alias("severity"), "date", v.alias("predicted_value"),
        F.col("hit.threshold").alias("threshold_value"), F.col("variable").alias("variable_type"), "days_ahead")


def heat_alerts(joined: DataFrame) -> DataFrame:
    return detect_alerts(joined.filter(F.col("variable") == "temp_max"))


def cold_alerts(joined: DataFrame) -> DataFrame:
    return detect_alerts(joined.filter(F.col("variable") == "temp_min"))


def alert_message(alerts: DataFrame) -> DataFrame:
    head = F.lit(None).cast("string")
    for kind, text in MESSAGES.items():
        head = F.when(F.col("alert_type") == kind, F.lit(text)).otherwise(head)
    one = lambda c: rnd(c, 1).cast("decimal(20,1)").cast("string")
    return alerts.withColumn("message", F.concat(
        head, F.lit(" ("), F.col("variable_type"), F.lit(" = "), one("predicted_value"), F.lit("°C, umbral: "),
        one("threshold_value"), F.lit("°C) en "), F.date_format("date", "yyyy-MM-dd"), F.lit(" (+"),
        F.col("days_ahead").cast("string"), F.lit(" días)")))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Counts in total, by type, by severity and by station (its code and name), in one pass of grouping sets."""
    counted = alerts.groupingSets(
        [[], ["alert_type"], ["severity"], ["station_code", "station_name"]],
        "alert_type", "severity", "station_code", "station_name",
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.grouping("alert_type").alias("gt"), F.grouping("severity").alias("gs"), F.grouping("station_name").alias("gn"))
    level = (F.when(F.col("gt") == 0, "alert_type").when(F.col("gs") == 0, "severity")
             .when(F.col("gn") == 0, "station").otherwise("total"))
    return counted.select(
        level.alias("level"), F.coalesce("alert_type", "severity", "station_name", F.lit("all")).alias("name"), "n")


def critical_alerts_topk(alerts: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` critical alerts per station; the rank filter runs before the shuffle as a group limit."""
    w = Window.partitionBy("station_code").orderBy("date", "alert_type")
    return alerts.filter(F.col("severity") == CRITICAL).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def alert_threshold_lines(alerts: DataFrame) -> DataFrame:
    """One threshold per alert type and variable: the first seen, of the family that fits the variable."""
    fits = (
        (F.col("alert_type").startswith("heat") & (F.col("variable_type") == "temp_max"))
        | (F.col("alert_type").startswith("cold") & (F.col("variable_type") == "temp_min")))
    return alerts.filter(fits).groupBy("alert_type", "variable_type").agg(
        F.min_by("threshold_value", F.struct("date", "station_code")).alias("threshold_value"),
        F.min("date").alias("first_date"))
