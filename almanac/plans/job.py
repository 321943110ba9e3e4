"""The whole run as one job: preprocess, imputation, prediction. Each stage includes those before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators import alerts as al
from almanac.operators import components as co
from almanac.operators import forecast as fo
from almanac.operators import impute as im
from almanac.operators import models as mo
from almanac.operators import precip as pr
from almanac.operators import quality as qu
from almanac.operators import reshape as re_
from almanac.plans.lineage import cut
from almanac.sources import writers

KEYS = ["station_code", "station"]
CKEYS = [*KEYS, "component"]
STAGES = ("preprocess", "imputation", "prediction")
MIN_MODEL_ROWS = 100
MIN_TREND_ROWS = 10

# Variables that take the rain path.
RAIN_NAMES = ("precip", "lluvia", "rain")


def preprocess(raw: DataFrame, max_stations: int | None = None, arrival: str | None = None) -> DataFrame:
    """Monthly-wide or long rows to a complete daily calendar.

    Of readings of one day the first by the column ``arrival`` counts where one is named; a table has
    no order of its own, so without it their mean does. ``frequency_calendar`` keeps finer steps.
    """
    _, days = qu.find_day_columns(raw.columns)
    if days:
        names = [qu.find_column(raw.columns, *qu.COLUMN_NAMES[r]) for r in ("code", "station", "year", "month")]
        long = re_.unpivot_days(raw, [c for c, _ in days], *names)
    else:
        long = raw.select(*KEYS, F.to_date("date").alias("date"), "value", *([arrival] if arrival else []))
    if arrival and arrival in long.columns:
        once = re_.dedupe_dates(long, arrival).select(*KEYS, "date", "value")
    else:
        once = long.groupBy(*KEYS, "date").agg(F.avg("value").alias("value"))
    if max_stations is not None:
        once = re_.limit_stations(once, max_stations)
    return re_.calendar_spine(cut(once))


def impute(daily: DataFrame, max_block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Filled series and the station report.

    Nothing is dropped, unless ``max_block`` asks to drop all history up to the last gap longer than that. ``long_gap``
    marks filled rows of gaps over ``impute.LARGE_TRIM`` days.
    """
    kept = daily if max_block is None else cut(im.trim_large_blocks(daily, max_block).drop("blocks_removed"))
    gaps = im.missing_blocks(kept).where(F.col("length") > im.LARGE_TRIM).select(*KEYS, F.struct("start_pos", "end_pos").alias("gap"))
    # A station has few such gaps: each is over a year long.
    of_station = gaps.groupBy(*KEYS).agg(F.collect_list("gap").alias("gaps"))
    inside = F.exists("gaps", lambda g: (F.col("pos") >= g["start_pos"]) & (F.col("pos") <= g["end_pos"]))
    done = cut(im.impute_auto(kept).join(of_station, KEYS, "left").withColumn("long_gap", F.coalesce(inside, F.lit(False))).drop("gaps"))
    return done, im.imputation_report(daily, kept, done, "auto")


def short_forecast(history: DataFrame, days: int) -> DataFrame:
    """The trend forecast of stations too short for models, with the spread of their values as bounds."""
    spread = history.groupBy(*KEYS).agg(F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("spread"))
    return fo.forecast_trend(history, days, KEYS).join(spread, KEYS).select(
        *KEYS, "date", "days_ahead", "value", (F.col("value") - fo.Z95 * F.col("spread")).alias("lower_ci"),
        (F.col("value") + fo.Z95 * F.col("spread")).alias("upper_ci"))


def predict(filled: DataFrame, variable: str, days: int = fo.DEFAULT_DAYS) -> dict[str, DataFrame]:
    """Components, classes, fitted models and the forecast of every station with ``MIN_TREND_ROWS`` values or more.

    Stations under ``MIN_MODEL_ROWS`` have no components: their forecast is the trend (:func:`short_forecast`). ``checks``
    has, per component, whether the filter keeps it and a model may be fitted to it; ``acceptance`` whether the station's decomposition passes.
    """
    known = filled.groupBy(*KEYS).agg(F.count("value").alias("known"))
    every = cut(filled.join(known, KEYS).where(F.col("known") >= MIN_TREND_ROWS).select(*KEYS, "date", "pos", "value", "known"))
    history = every.where(F.col("known") >= MIN_MODEL_ROWS).drop("known")
    short = every.where(F.col("known") < MIN_MODEL_ROWS).drop("known")
    comp = cut(co.decompose(history))
    classes = cut(co.classify_components(co.seasonal_model_score(co.score_inputs(comp))))
    models = cut(mo.lag_model_fit(comp))
    parts = cut(fo.predict_components(comp, classes, models, days))
    if any(n in variable.lower() for n in RAIN_NAMES):
        profile = pr.wet_dry_profile(history)
        forecast = pr.precip_interval(cut(pr.precip_forecast(parts, history)), profile)
    else:
        forecast = fo.confidence_interval(fo.reconstruct_forecast(parts, history), parts)
    trend = cut(short_forecast(short, days))
    forecast = cut(forecast.select(*KEYS, "date", "days_ahead", "value", "lower_ci", "upper_ci").unionByName(trend))
    parts = parts.unionByName(trend.select(
        *KEYS, F.lit(1).alias("component"), "date", "days_ahead", F.lit("extrapolation").alias("model_class"),
        F.lit("trend").alias("method"), "value"))
    quality = fo.forecast_quality(forecast, every, parts)
    table = fo.predictions_table(every, forecast, parts, quality, variable)
    eligible = co.model_eligibility(co.model_input_checks(comp), F.lit(False))
    checks = co.filter_components(comp).select(*CKEYS, "explained_ratio", "quality", "kept").join(eligible, CKEYS, "left")
    return {"history": every.drop("known"), "components": comp, "classes": classes, "models": models, "parts": parts, "checks": checks,
            "acceptance": co.decomposition_acceptance(co.decomposition_quality(comp)), "forecast": forecast, "predictions": cut(table)}


def deliver(out: dict[str, DataFrame], path: str, variable: str, version: int = 1, saved_on: str | None = None) -> dict[str, str]:
    """Write what a run gave below ``path`` and name the places. The model table, in ``path/models``, only grows.

    Series and components by station, the consolidated predictions, station reports and metrics, alerts, and the models with
    the day ``saved_on`` (today, if None).
    """
    places = {}
    spark = out["status"].sparkSession
    day = saved_on or str(spark.sql("SELECT current_date()").first()[0])
    if "filled" in out:
        places["series"] = f"{path}/series"
        writers.write_series(out["filled"].select(*KEYS, "date", "value", "imputed", "long_gap"), places["series"])
        metrics = out["report"].groupBy("status").agg(F.count(F.lit(1)).alias("stations"))
        places["reports"] = f"{path}/reports"
        writers.write_reports(out["report"], metrics, places["reports"])
    if "predictions" in out:
        places["predictions"] = f"{path}/predictions"
        writers.write_consolidated(out["predictions"].join(out["status"].select(*KEYS, "status"), KEYS), places["predictions"])
        places["components"] = f"{path}/components"
        comp = out["components"]
        writers.write_components(comp, co.variance_explained(comp), co.component_correlation(comp), co.component_quality(comp), places["components"])
        places["models"] = f"{path}/models"
        writers.save_models(out["models"].join(out["classes"].select(*CKEYS, "model_class"), CKEYS), places["models"], variable, version, day)
    if "alerts" in out:
        places["alerts"] = f"{path}/alerts"
        writers.write_alerts(out["alerts"], al.alert_summary(out["alerts"]), places["alerts"])
    return places


def run(
    raw: DataFrame, variable: str = "temp_max", stage: str = "prediction", max_stations: int | None = None,
    days: int = fo.DEFAULT_DAYS, thresholds: DataFrame | None = None, arrival: str | None = None,
    max_block: int | None = None, sink: str | None = None, version: int = 1,
) -> dict[str, DataFrame]:
    """Tables of the chosen stage and those before it, with one status row per station.

    A station that cannot be processed has status ``failed`` and a reason; the others go on. ``gate`` has the quality
    gate's findings about every station's calendar. ``arrival`` names the column that tells which of several readings of a
    day came first, ``max_block`` the longest gap whose history is kept (None: all is kept). With
    ``sink`` the tables are also written, by :func:`deliver`.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}, expected one of {STAGES}")
    daily = cut(preprocess(raw, max_stations, arrival))
    out = {"daily": daily, "gate": qu.quality_gate(daily), "status": qu.series_validity(daily).select(
        *KEYS, F.when(F.col("verdict") == "valid", "success").otherwise("failed").alias("status"),
        F.when(F.col("verdict") != "valid", F.col("verdict")).alias("reason"))}
    if stage == "preprocess":
        return out
    filled, report = impute(daily, max_block)
    report = cut(report)
    out |= {"filled": filled, "report": report, "status": report.select(
        *KEYS, "status", F.when(F.col("status") == "failed", "nothing_left_after_trimming").alias("reason"))}
    if stage == "imputation":
        if sink is not None:
            deliver(out, sink, variable, version)
        return out
    out |= predict(filled, variable, days)
    done = out["predictions"].filter(F.col("type") == "prediction").groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("predicted_rows"))
    modelled = out["classes"].select(*KEYS).distinct().withColumn("modelled", F.lit(True))
    with_done = out["status"].join(done, KEYS, "left").join(modelled, KEYS, "left").withColumn("modelled", F.coalesce("modelled", F.lit(False)))
    out["status"] = with_done.withColumns({
        "reason": F.coalesce("reason", F.when(F.col("predicted_rows").isNull(), "too_few_rows_for_models"),
                             F.when(~F.col("modelled"), "trend_only")),
        "status": F.when(F.col("predicted_rows").isNull(), "failed").otherwise(F.col("status")),
        "predicted_rows": F.coalesce("predicted_rows", F.lit(0).cast("bigint"))}).drop("modelled")
    if thresholds is not None:
        joined = al.alert_threshold_join(out["forecast"].withColumn("variable", F.lit(variable)), thresholds)
        out["alerts"] = al.alert_message(al.detect_alerts(joined))
    if sink is not None:
        deliver(out, sink, variable, version)
    return out
