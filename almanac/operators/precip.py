"""Zero-inflated series: wet and dry days, distributions, and the treatment of their forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.expr import count_where, div, hash_unit
from almanac.operators.forecast import Z95

KEYS = ["station_code", "station"]

# Regimes by share of dry days, and tolerances of the corrections.
VERY_DRY, WET = 0.8, 0.3
WET_SHARE = 0.1
BOUND = 1.5
DRY_TOLERANCE = 0.2
MIN_FIT = 10


def wet_dry_profile(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counts and shares of dry and wet days, moments of the wet ones, and the regime."""
    wet = F.when(F.col("value") > 0, F.col("value"))
    p = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_days"), count_where(F.col("value") == 0).alias("dry_days"),
        F.coalesce(F.avg(wet), F.lit(0.0)).alias("wet_mean"), F.coalesce(F.stddev_samp(wet), F.lit(0.0)).alias("wet_std"),
        F.coalesce(F.percentile(wet, 0.5), F.lit(0.0)).alias("wet_median"), F.coalesce(F.max(wet), F.lit(0.0)).alias("wet_max"))
    dry = div("dry_days", "total_days")
    return p.withColumns({
        "wet_days": F.col("total_days") - F.col("dry_days"), "dry_fraction": dry, "wet_fraction": 1 - dry,
        "regime": F.when(dry > VERY_DRY, "very_dry").when(dry < WET, "wet").otherwise("moderate")})


def monthly_wet_pattern(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Count, mean and wet share by calendar month; the count tells how much a station's month rests on."""
    return df.groupBy(*keys, F.month("date").alias("month")).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias("wet_fraction"))


def ln_gamma(a: Column) -> Column:
    """Log of the gamma function: Stirling's series at a + 8, carried back by the recurrence."""
    x = a + 8
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    product = a
    for i in range(1, 8):
        product = product * (a + i)
    return series - F.ln(product)


def fit_distribution(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Exponential, lognormal and gamma fitted to the wet values from sums; smallest AIC wins.

    Location is zero for all three. Parameters count as the location, scale and shape each has.
    """
    wet = df.filter(F.col("value") > 0)
    s = wet.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.avg(F.ln("value")).alias("ml"),
        F.stddev_pop(F.ln("value")).alias("sl"))
    n, m, ml, sl = (F.col(c) for c in ("n", "m", "ml", "sl"))
    gap = F.ln(m) - ml
    shape = F.try_divide(3 - gap + F.sqrt((gap - 3) * (gap - 3) + 24 * gap), 12 * gap)
    s = s.withColumn("shape", F.when(gap > 1e-12, shape)).withColumn("scale", div(m, F.col("shape")))
    ll_exp = -n * F.ln(m) - n
    ll_log = F.when(sl > 1e-12, -n * ml - n * F.ln(sl) - n * 0.5 * math.log(2 * math.pi) - n / 2)
    a, theta = F.col("shape"), F.col("scale")
    ll_gam = (a - 1) * n * ml - n * m / theta - n * (a * F.ln(theta) + ln_gamma(a))
    s = s.withColumns({"aic_exponential": 4 - 2 * ll_exp, "aic_lognormal": 6 - 2 * ll_log, "aic_gamma": 6 - 2 * ll_gam})
    inf = F.lit(float("inf"))
    e, lg, g = (F.coalesce(f"aic_{d}", inf) for d in ("exponential", "lognormal", "gamma"))
    best = F.when(n < MIN_FIT, "insufficient_data").when((g <= e) & (g <= lg), "gamma").when(e <= lg, "exponential").otherwise("lognormal")
    out = s.withColumn("best", best)
    fitted = n >= MIN_FIT
    return out.select(
        *keys, "n", "best",
        *[F.when(fitted, F.col(c)).alias(c) for c in ("aic_gamma", "aic_exponential", "aic_lognormal", "shape", "scale")],
        F.when(fitted, ml).alias("log_mean"), F.when(fitted, sl).alias("log_std"))


def precip_transform(forecast: DataFrame, history: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rescale to the history, keep the wet share of days wet, lift faint wet days to a drawn value.

    Draws are hashes of station and date, so a rerun gives the same rows.
    """
    profile = wet_dry_profile(history, keys).select(*keys, "wet_fraction", "wet_mean")
    hist = history.groupBy(*keys).agg(F.avg("value").alias("hm"), F.stddev_samp("value").alias("hs"))
    w = Window.partitionBy(*keys)  # one horizon
    rows = forecast.join(profile.join(hist, keys), keys).withColumns({
        "pm": F.avg("value").over(w), "ps": F.stddev_pop("value").over(w)})
    scaled = F.when(F.col("ps") > 0, (F.col("value") - F.col("pm")) * (F.col("hs") / F.col("ps")) + F.col("hm")).otherwise(F.col("hm"))
    rows = rows.withColumn("scaled", scaled)
    day = [*[F.col(k) for k in keys], F.col("date")]
    is_wet = hash_unit(F.lit("wet"), *day) < F.col("wet_fraction")
    faint = F.col("wet_mean") * WET_SHARE
    drawn = -F.col("wet_mean") * F.ln(hash_unit(F.lit("amount"), *day))
    value = (
        F.when(F.col("wet_fraction") <= 0, F.col("scaled")).when(~is_wet, 0.0)
        .when(F.col("scaled") < faint, drawn).otherwise(F.greatest("scaled", faint)))
    return rows.withColumn("value", value).drop("wet_fraction", "wet_mean", "hm", "hs", "pm", "ps", "scaled")


def precip_bounds(forecast: DataFrame, profile: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    top = profile.select(*keys, (F.col("wet_max") * BOUND).alias("top"))
    return forecast.join(top, keys).withColumn(
        "value", F.greatest(F.lit(0.0), F.least(F.col("value"), F.col("top")))).drop("top")


def dry_fraction_fix(forecast: DataFrame, profile: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """If the dry share is off by more than 0.2, dry the smallest wet days or wet some dry ones to reach it."""
    rows = forecast.join(profile.select(*keys, "dry_fraction", "wet_mean"), keys)
    whole = Window.partitionBy(*keys)  # one horizon
    rows = rows.withColumns({
        "n": F.count(F.lit(1)).over(whole), "n_wet": F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).over(whole)})
    off = F.abs((F.col("n") - F.col("n_wet")) / F.col("n") - F.col("dry_fraction")) > DRY_TOLERANCE
    target_wet = F.col("n") - F.floor(F.col("n") * F.col("dry_fraction") + 1e-9)
    is_wet = F.col("value") > 0
    smallest = Window.partitionBy(*keys, is_wet).orderBy("value", "date")
    drawn_order = Window.partitionBy(*keys, is_wet).orderBy(hash_unit(F.lit("pick"), *keys, "date"), "date")
    rows = rows.withColumns({"r": F.row_number().over(smallest), "pick": F.row_number().over(drawn_order)})
    drawn = -F.col("wet_mean") * F.ln(hash_unit(F.lit("fill"), *keys, "date"))
    value = (
        F.when(off & is_wet & (F.col("r") <= F.col("n_wet") - target_wet), 0.0)
        .when(off & ~is_wet & (F.col("pick") <= target_wet - F.col("n_wet")), drawn).otherwise(F.col("value")))
    return rows.withColumn("value", value).drop("dry_fraction", "wet_mean", "n", "n_wet", "r", "pick")


def precip_quality(forecast: DataFrame, profile: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """How alike the dry share and the wet mean of forecast and history are."""
    p = forecast.groupBy(*keys).agg(
        F.avg(F.when(F.col("value") == 0, 1.0).otherwise(0.0)).alias("predicted_dry_fraction"),
        F.coalesce(F.avg(F.when(F.col("value") > 0, F.col("value"))), F.lit(0.0)).alias("predicted_wet_mean"))
    j = p.join(profile.select(*keys, "dry_fraction", "wet_mean"), keys)
    dry = 1 - F.abs(F.col("dry_fraction") - F.col("predicted_dry_fraction"))
    wet = F.when(F.col("wet_mean") > 0, 1 - F.abs(F.col("predicted_wet_mean") - F.col("wet_mean")) / F.col("wet_mean")) \
        .when(F.col("predicted_wet_mean") == 0, 1.0).otherwise(0.0)
    return j.select(*keys, dry.alias("dry_fraction_similarity"), wet.alias("wet_mean_similarity"),
                    ((dry + wet) / 2).alias("overall_quality"), "predicted_dry_fraction", "predicted_wet_mean")


def longest_runs(forecast: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Longest wet and dry run per station (gaps and islands over one horizon)."""
    kind = F.when(F.col("value") > 0, "wet").when(F.col("value") == 0, "dry").otherwise("negative")
    w = Window.partitionBy(*keys).orderBy("date")
    by_kind = Window.partitionBy(*keys, "kind").orderBy("date")
    runs = forecast.withColumn("kind", kind).withColumn(
        "run", F.row_number().over(w) - F.row_number().over(by_kind)
    ).groupBy(*keys, "kind", "run").agg(F.count(F.lit(1)).alias("length"))
    return runs.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col("kind") == k, F.col("length"))), F.lit(0)).cast("bigint").alias(f"longest_{k}")
        for k in ("wet", "dry")])


def precip_realism(forecast: DataFrame, profile: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One minus penalties for negatives, values over twice the maximum, and endless runs."""
    e = forecast.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = e.join(profile.select(*keys, "wet_max"), keys).join(longest_runs(forecast, keys), keys)
    pen = lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = (1 - pen(F.col("lo") < 0, 0.3) - pen(F.col("hi") > 2 * F.col("wet_max"), 0.2)
             - pen(F.col("longest_wet") > 30, 0.2) - pen(F.col("longest_dry") > 365, 0.3))
    return j.select(*keys, "longest_wet", "longest_dry", F.greatest(F.lit(0.0), score).alias("realism"))


def precip_interval(forecast: DataFrame, profile: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Zero below; above the value plus 1.96 wet spreads, at most twice the wet maximum."""
    j = forecast.join(profile.select(*keys, "wet_std", "wet_max"), keys)
    return j.withColumns({
        "lower_ci": F.lit(0.0), "upper_ci": F.least(F.col("value") + Z95 * F.col("wet_std"), 2 * F.col("wet_max")),
    }).drop("wet_std", "wet_max")


def precip_forecast(parts: DataFrame, history: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The rain path from component forecasts to the final values."""
    base = parts.groupBy(*keys, "date", "days_ahead").agg(F.sum("value").alias("value"))
    profile = wet_dry_profile(history, keys)
    return dry_fraction_fix(precip_bounds(precip_transform(base, history, keys), profile, keys), profile, keys)
