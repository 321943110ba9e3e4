"""Horizons, component forecasts, their reconstruction, intervals and quality.

A forecast is a long table: keys, ``date``, ``days_ahead`` and ``value``; one station has as
many rows as days are asked for, so windows over it are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.expr import div
from almanac.operators.models import N_LAGS, day_means, seasonal_ar_fit
from almanac.operators.reshape import tail_rows

KEYS = ["station_code", "station"]
CKEYS = [*KEYS, "component"]

# Default horizon in days, its limits, and the normal 95% factor.
DEFAULT_DAYS = 21
MAX_HORIZON = 60
MAX_SHARE = 0.1
LEGACY_SHARE = 0.2
Z95 = 1.96
EPS = 1e-8


def horizon_steps(n: Column, days: int = DEFAULT_DAYS, max_share: float | None = None, max_steps: int | None = None) -> Column:
    """The days asked for; a share of the rows or a number of steps limits them only where given. At least one."""
    limits = [F.lit(days)]
    if max_share is not None:
        limits.append(F.floor(n * max_share + 1e-9))
    if max_steps is not None:
        limits.append(F.lit(max_steps))
    return F.greatest(F.lit(1), F.least(*limits) if len(limits) > 1 else limits[0]).cast("int")


def horizon(df: DataFrame, days: int = DEFAULT_DAYS, keys: list[str] = KEYS, max_share: float | None = None,
            max_steps: int | None = None) -> DataFrame:
    """Steps asked for and given, per key."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date"))
    return n.withColumns({
        "requested": F.lit(days), "steps": horizon_steps(F.col("n"), days, max_share, max_steps),
        "legacy_steps": F.greatest(F.lit(1), F.floor(F.col("n") * LEGACY_SHARE + 1e-9)).cast("int")})


def future_dates(df: DataFrame, days: int = DEFAULT_DAYS, keys: list[str] = KEYS) -> DataFrame:
    """last date + 1 .. + steps per key."""
    return horizon(df, days, keys).select(
        *keys, "n", F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("days_ahead"), "last_date",
    ).select(*keys, "n", F.date_add("last_date", F.col("days_ahead")).alias("date"), "days_ahead")


def forecast_ar(comp: DataFrame, days: int = DEFAULT_DAYS, keys: list[str] = CKEYS) -> DataFrame:
    """Closed form of the seasonal AR(1) on differences."""
    fit, season = seasonal_ar_fit(comp, keys=keys)
    ahead = future_dates(comp, days, keys).join(fit.drop("n"), keys).withColumn("doy", F.dayofyear("date"))
    drift = F.col("last_diff") * F.col("phi") * div(1 - F.pow("phi", "days_ahead"), 1 - F.col("phi"))
    return ahead.join(season, [*keys, "doy"], "left").select(
        *keys, "date", "days_ahead",
        (F.col("last_level") + drift + F.coalesce("seasonal", F.lit(0.0))).alias("value"))


def forecast_trend(comp: DataFrame, days: int = DEFAULT_DAYS, keys: list[str] = CKEYS) -> DataFrame:
    """Line extended over the horizon and rescaled to the historical range; the mean where nothing varies.

    A line that is flat but for rounding noise is not stretched.
    """
    hist = comp.groupBy(*keys).agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.regr_slope("value", F.col("pos").cast("double")).alias("slope"),
        F.regr_intercept("value", F.col("pos").cast("double")).alias("intercept"))
    line = F.when(F.col("s") < 0.01, F.col("m")).otherwise(
        F.col("intercept") + F.col("slope") * (F.col("n") + F.col("days_ahead")))
    rows = future_dates(comp, days, keys).join(hist, keys).withColumn("p", line)
    w = Window.partitionBy(*keys)
    low, high = F.min("p").over(w), F.max("p").over(w)
    spread = F.col("hi") - F.col("lo")
    scaled = F.when(
        high - low > 1e-9 * spread, (F.col("p") - low) / (high - low) * spread + F.col("lo")).otherwise(F.col("p"))
    return rows.select(*keys, "date", "days_ahead", scaled.alias("value"))


def forecast_lag(
    comp: DataFrame, models: DataFrame, days: int = DEFAULT_DAYS, keys: list[str] = CKEYS
) -> DataFrame:
    """Each step feeds the next: a fold over the steps with the last values as its state."""
    last = tail_rows(comp, N_LAGS, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("age", "value"))).alias("tail"))
    h = horizon(comp, days, keys)
    rows = h.join(last, keys).join(models.select(*keys, "coefficients"), keys).filter(F.size("tail") == N_LAGS)
    start = F.struct(F.transform("tail", lambda t: t["value"]).alias("lags"), F.array().cast("array<double>").alias("out"))
    b = F.col("coefficients")

    def step(state, _i):
        lags = state["lags"]
        mean = F.aggregate(lags, F.lit(0.0), lambda a, x: a + x) / N_LAGS
        var = F.aggregate(lags, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / N_LAGS
        dot = F.aggregate(F.zip_with(lags, F.slice(b, 2, N_LAGS), lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
        nxt = b[0] + dot + b[N_LAGS + 1] * mean + b[N_LAGS + 2] * F.sqrt(var)
        one = F.array(nxt)
        return F.struct(F.concat(one, F.slice(lags, 1, N_LAGS - 1)).alias("lags"), F.concat(state["out"], one).alias("out"))

    done = rows.withColumn("out", F.aggregate(F.sequence(F.lit(1), F.col("steps")), start, step, lambda s: s["out"]))
    return done.select(*keys, "last_date", F.posexplode("out").alias("i", "value")).select(
        *keys, F.date_add("last_date", F.col("i") + 1).alias("date"), (F.col("i") + 1).alias("days_ahead"), "value")


def predict_components(
    comp: DataFrame, classes: DataFrame, models: DataFrame, days: int = DEFAULT_DAYS
) -> DataFrame:
    """Each component by its class; the trend forecast stands in where a model gives nothing."""
    routed = comp.join(classes.select(*CKEYS, "model_class"), CKEYS)
    seasonal = forecast_ar(routed.filter(F.col("model_class") == "seasonal"), days)
    lag = forecast_lag(routed.filter(F.col("model_class") == "lag"), models, days)
    own = seasonal.unionByName(lag).select(*CKEYS, "date", F.col("value").alias("own"))
    base = forecast_trend(comp, days).join(classes.select(*CKEYS, "model_class"), CKEYS)
    usable = F.when(~F.isnan("own"), F.col("own"))
    return base.join(own, [*CKEYS, "date"], "left").select(
        *CKEYS, "date", "days_ahead", "model_class",
        F.when(usable.isNull(), "trend").otherwise(F.col("model_class")).alias("method"),
        F.coalesce(usable, F.col("value")).alias("value"))


def simple_components(comp: DataFrame, seasonal_component: int = 4, days: int = DEFAULT_DAYS) -> DataFrame:
    """Fixed routing without fitted lags: one component by the seasonal model, the rest by trend."""
    is_seasonal = F.col("component") == seasonal_component
    return forecast_ar(comp.filter(is_seasonal), days).unionByName(forecast_trend(comp.filter(~is_seasonal), days))


def history_stats(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg("value").alias("h_mean"), F.stddev_samp("value").alias("h_std"), F.min("value").alias("h_min"),
        F.max("value").alias("h_max"), F.max_by("value", "pos").alias("h_last"),
        div(F.max_by("value", "pos") - F.min_by("value", "pos"), F.count("value") - 1).alias("h_trend"))


def reconstruct_forecast(parts: DataFrame, history: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Sum of the components, rescaled if far off, tied to the last value, kept near the historical range."""
    total = parts.groupBy(*keys, "date", "days_ahead").agg(F.sum("value").alias("v"))
    w = Window.partitionBy(*keys)  # one horizon
    p_mean, p_std = F.avg("v").over(w), F.stddev_pop("v").over(w)
    rows = total.join(history_stats(history, keys), keys).withColumns({"p_mean": p_mean, "p_std": p_std})
    off = (
        (F.abs(F.col("p_mean") - F.col("h_mean")) / (F.abs("h_mean") + EPS) > 0.5)
        | (F.abs(F.col("p_std") - F.col("h_std")) / (F.abs("h_std") + EPS) > 0.5))
    scaled = F.when(off & (F.col("p_std") > 0),
                    (F.col("v") - F.col("p_mean")) * (F.col("h_std") / (F.col("p_std") + EPS)) + F.col("h_mean")) \
        .when(off, F.col("h_mean")).otherwise(F.col("v"))
    rows = rows.withColumn("s", scaled)
    jump = F.abs(F.col("s") - F.col("h_last")) > 2 * F.greatest(F.col("h_std"), F.lit(1.0))
    tied = F.when((F.col("days_ahead") == 1) & jump, 0.7 * F.col("h_last") + 0.3 * F.col("s")).otherwise(F.col("s"))
    slack = (F.col("h_max") - F.col("h_min")) * 0.1
    return rows.select(
        *keys, "date", "days_ahead", off.alias("rescaled"),
        F.greatest(F.least(tied, F.col("h_max") + slack), F.col("h_min") - slack).alias("value"))


def weighted_reconstruction(parts: DataFrame, comp: DataFrame) -> DataFrame:
    """Sum of components weighted by the inverse of their historical spread, weights adding to one."""
    inv = comp.groupBy(*CKEYS).agg((1 / F.greatest(F.stddev_pop("value"), F.lit(1e-8))).alias("inv"))
    share = inv.select(*CKEYS, (F.col("inv") / F.sum("inv").over(Window.partitionBy(*KEYS))).alias("share"))
    return parts.join(share, CKEYS).groupBy(*KEYS, "date", "days_ahead").agg(
        F.sum(F.col("value") * F.col("share")).alias("value"))


def confidence_interval(forecast: DataFrame, parts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Prediction plus and minus 1.96 times the root of the summed component forecast variances."""
    var = parts.groupBy(*keys, "component").agg(F.var_pop("value").alias("v"))
    spread = var.groupBy(*keys).agg(F.sqrt(F.sum("v")).alias("spread"))
    return forecast.join(spread, keys).withColumns({
        "lower_ci": F.col("value") - Z95 * F.col("spread"), "upper_ci": F.col("value") + Z95 * F.col("spread")}).drop("spread")


def forecast_quality(
    forecast: DataFrame, history: DataFrame, parts: DataFrame, keys: list[str] = KEYS
) -> DataFrame:
    """Consistency with the history, relative and scaled by its spread."""
    p = forecast.groupBy(*keys).agg(
        F.avg("value").alias("p_mean"), F.stddev_pop("value").alias("p_std"), F.stddev_samp("value").alias("p_std_s"),
        F.count(F.lit(1)).alias("prediction_length"),
        div(F.max_by("value", "days_ahead") - F.min_by("value", "days_ahead"), F.count("value") - 1).alias("p_trend"))
    used = parts.groupBy(*keys).agg(F.count_distinct("component").alias("num_components"))
    j = p.join(history_stats(history, keys), keys).join(used, keys)
    near = lambda a, b: 1 - F.abs(F.col(a) - F.col(b)) / (F.abs(b) + EPS)
    mean_c, std_c, trend_c = near("p_mean", "h_mean"), near("p_std", "h_std"), near("p_trend", "h_trend")
    mean_s = F.abs(F.col("p_mean") - F.col("h_mean")) / F.col("h_std")
    trend_s = F.coalesce(div(F.abs(F.col("p_trend") - F.col("h_trend")), F.abs("h_trend")), F.lit(0.0))
    return j.select(
        *keys, mean_c.alias("mean_consistency"), std_c.alias("std_consistency"), trend_c.alias("trend_consistency"),
        (F.col("p_std") / (F.col("h_std") + EPS)).alias("diversity_score"),
        ((mean_c + std_c + trend_c) / 3).alias("overall_quality"),
        mean_s.alias("scaled_mean_distance"), trend_s.alias("scaled_trend_distance"),
        (F.col("p_std_s") / F.col("h_std")).alias("scaled_diversity"),
        F.greatest(F.lit(0.0), 1 - (mean_s + trend_s) / 2).alias("scaled_quality"),
        "num_components", "prediction_length")


def predictions_table(
    history: DataFrame, forecast: DataFrame, parts: DataFrame, quality: DataFrame, variable: str, context: int = 30,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Last rows of history and the forecast, components in columns imf_1..imf_8, bounds, quality and run columns."""
    numbers = list(range(1, 9))
    side = parts.groupBy(*keys, "date").pivot("component", numbers).agg(F.first("value"))
    side = side.select(*keys, "date", *[F.col(str(i)).alias(f"imf_{i}") for i in numbers])
    future = forecast.join(side, [*keys, "date"], "left").select(
        *keys, "date", F.lit("prediction").alias("type"), "value", *[f"imf_{i}" for i in numbers],
        "lower_ci", "upper_ci", F.lit(0.95).alias("confidence_level"))
    past = tail_rows(history, context, keys).select(*keys, "date", F.lit("historical").alias("type"), "value")
    return past.unionByName(future, allowMissingColumns=True).join(
        quality.select(*keys, "mean_consistency", "trend_consistency", "diversity_score",
                       F.col("num_components").alias("num_imfs_used"), F.col("prediction_length").alias("prediction_steps")),
        keys, "left",
    ).withColumn("variable_type", F.lit(variable))


def overlap_residuals(history: DataFrame, forecast: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """History minus prediction on the dates both have."""
    return history.select(*keys, "date", F.col("value").alias("actual")).join(
        forecast.select(*keys, "date", F.col("value").alias("predicted")), [*keys, "date"]
    ).withColumn("residual", F.col("actual") - F.col("predicted"))
