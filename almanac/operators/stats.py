"""Aggregations and reports per station and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.betainc import t_p_value
from almanac.functions.expr import count_where, div, rnd
from almanac.plans import blocks
from almanac.plans.quantiles import exact_quantiles, series_quantiles

KEYS = ["station_code", "station"]


def value_statistics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"),
        count_where(F.col("value").isNull()).alias("missing"), F.count(F.lit(1)).alias("total"),
        (F.avg(F.when(F.col("value").isNotNull(), 100.0).otherwise(0.0))).alias("completeness"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_distinct("station_code").alias("stations"),
    )


def station_statistics(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("std_value"), F.count("value").alias("known"),
        count_where(F.col("value").isNull()).alias("missing"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("total__"), *[count_where(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing"), F.col("total__").alias("total")) for c in cols]
    return one.select(F.explode(F.array(*rows)).alias("e")).select("e.*").withColumn(
        "missing_pct", div("missing", "total") * 100)


def sample_skew(v: Column) -> Column:
    n = F.count(v).cast("double")
    return F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(v: Column) -> Column:
    n = F.count(v).cast("double")
    return F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * F.kurtosis(v) + 6), (n - 2) * (n - 3)))


def basic_statistics(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Count, moments with the sample corrections, and quartiles, to three digits."""
    v = F.col("value")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), q.alias("q"),
        sample_skew(v).alias("skew"), sample_kurtosis(v).alias("kurtosis"),
    )
    named = out.withColumns({"q25": F.col("q")[0], "median": F.col("q")[1], "q75": F.col("q")[2]}).drop("q")
    return named.select(*keys, "n", *[rnd(c, 3).alias(c) for c in named.columns if c not in (*keys, "n")])


def trend_fit(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Least squares on the index of the known values: n, slope, intercept, r2, t."""
    numbered = blocks.number_rows(df.filter(F.col("value").isNotNull()), keys)
    x, y = F.col("pos") - 1, F.col("value")
    fit = numbered.groupBy(*keys).agg(
        F.count(y).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.when(F.var_pop(y) > 0, F.regr_r2(y, x)).alias("r2"),
    )
    t = F.signum("slope") * F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))
    enough = F.col("n") >= 10
    return fit.select(
        *keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")],
        F.when(enough, t).alias("t"),
    )


def trend_analysis(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Trend with significance: direction by sign when p < .05, strength by r2."""
    fit = trend_fit(df, keys).withColumn("p_value", t_p_value(F.col("t"), (F.col("n") - 2).cast("double")))
    few, sig = F.col("n") < 10, F.col("p_value") < 0.05
    none = F.lit("no_significant_trend")
    return fit.withColumns({
        "direction": F.when(few, "insufficient_data").when(sig & (F.col("slope") > 0), "increasing")
        .when(sig, "decreasing").otherwise(none),
        "strength": F.when(few, "insufficient_data").when(sig & (F.col("r2") > 0.7), "strong")
        .when(sig & (F.col("r2") > 0.3), "moderate").when(sig, "weak").otherwise(none),
    })


def outlier_counts(df: DataFrame, keys: list[str] = KEYS, bounded: bool = True) -> DataFrame:
    """Values outside the quartiles by more than 1.5 interquartile ranges.

    ``bounded`` is for daily series; raw records take the quantiles without a group bound.
    """
    quantiles = series_quantiles if bounded else exact_quantiles
    q = quantiles(df, keys, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)
    return df.join(q, keys).groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("q3").alias("q3"),
        F.count("value").alias("n"), count_where(out).alias("outliers"),
    ).withColumn("outlier_pct", div("outliers", "n") * 100)


def versions(original: DataFrame, imputed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Both states of the series in one long table."""
    cols = [*keys, "date", "value"]
    return original.select(*cols, F.lit("original").alias("version")).unionByName(
        imputed.select(*cols, F.lit("imputed").alias("version")))


def _side(df: DataFrame, version: str, cols: list[str], keys: list[str]) -> DataFrame:
    return df.filter(F.col("version") == version).select(*keys, *[F.col(c).alias(f"{version}_{c}") for c in cols])


def quality_metrics(both: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Completeness, variation and outliers before and after, and their change."""
    vk = [*keys, "version"]
    base = both.groupBy(*vk).agg(
        F.avg(F.when(F.col("value").isNotNull(), 1.0).otherwise(0.0)).alias("completeness"),
        F.coalesce(div(F.stddev_samp("value"), F.avg("value")), F.lit(0.0)).alias("cv"),
    )
    joined = base.join(outlier_counts(both, vk).select(*vk, "outliers", "outlier_pct"), vk)
    pivoted = joined.groupBy(*keys).pivot("version", ["original", "imputed"]).agg(
        *[F.first(c).alias(c) for c in ("completeness", "cv", "outliers", "outlier_pct")])
    return pivoted.withColumns({
        "improvement": F.col("imputed_completeness") - F.col("original_completeness"),
        "cv_change": F.col("imputed_cv") - F.col("original_cv"),
    })


def missing_comparison(both: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    def missing(version):
        return count_where((F.col("version") == version) & F.col("value").isNull())

    def total(version):
        return count_where(F.col("version") == version)

    counts = both.groupBy(*keys).agg(
        missing("original").alias("original_missing"), missing("imputed").alias("imputed_missing"),
        total("original").alias("original_total"), total("imputed").alias("imputed_total"),
    )
    return counts.withColumns({
        "original_missing_pct": F.coalesce(div("original_missing", "original_total") * 100, F.lit(0.0)),
        "imputed_missing_pct": F.coalesce(div("imputed_missing", "imputed_total") * 100, F.lit(0.0)),
        "imputed_values": F.col("original_missing") - F.col("imputed_missing"),
    }).withColumn(
        "imputation_rate", F.coalesce(div("imputed_values", "original_missing") * 100, F.lit(0.0))
    ).drop("original_total", "imputed_total")


def _moments(both: DataFrame, keys: list[str]) -> DataFrame:
    """Rounded statistics per version, side by side in one row per station."""
    stats = basic_statistics(both, [*keys, "version"])
    r2 = trend_fit(both, [*keys, "version"]).select(*keys, "version", rnd("r2", 3).alias("r2"))
    rows = stats.join(r2, [*keys, "version"])
    names = ("n", "mean", "std", "min", "max", "r2")
    return rows.groupBy(*keys).pivot("version", ["original", "imputed"]).agg(
        *[F.first(c).alias(c) for c in names])


def change_pct(name: str) -> Column:
    o, i = F.col(f"original_{name}"), F.col(f"imputed_{name}")
    return div(i - o, o) * 100


def before_after(both: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Changes in percent, and flags for completeness, variance and range that held up."""
    m = _moments(both, keys)
    std = F.col("original_std")
    shift = lambda c: F.abs(F.col(f"imputed_{c}") - F.col(f"original_{c}"))
    some = F.coalesce(std != 0, F.lit(False))
    return m.select(
        *keys, "original_n", "imputed_n",
        *[c for k in ("mean", "std", "min", "max", "r2") for c in (f"original_{k}", f"imputed_{k}")],
        *[change_pct(c).alias(f"{c}_change_pct") for c in ("mean", "std", "min", "max", "r2")],
        (F.col("imputed_n") > F.col("original_n")).alias("completeness_improved"),
        (some & (shift("std") < std * 0.1)).alias("variance_preserved"),
        (some & (shift("min") < std * 0.5) & (shift("max") < std * 0.5)).alias("range_preserved"),
    )


def report_long(wide_report: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Metric/value rows of a one-row-per-station report."""
    metrics = [c for c, t in wide_report.dtypes if c not in keys and t not in ("boolean", "string")]
    return wide_report.select(*keys, *[F.col(c).cast("double").alias(c) for c in metrics]).unpivot(
        list(keys), metrics, "metric", "metric_value")


def stations_summary(both: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Wide row per station: records, moments, missing, rate, trends and flags."""
    vk = [*keys, "version"]
    records = both.groupBy(*keys).agg(
        count_where(F.col("version") == "original").alias("original_records"),
        count_where(F.col("version") == "imputed").alias("imputed_records"))
    trends = trend_analysis(both, vk).groupBy(*keys).pivot("version", ["original", "imputed"]).agg(
        F.first("direction"))
    trends = trends.select(
        *keys, F.col("original").alias("original_trend"), F.col("imputed").alias("imputed_trend"))
    flags = before_after(both, keys).select(
        *keys, "original_mean", "imputed_mean", "original_std", "imputed_std",
        "completeness_improved", "variance_preserved", "range_preserved")
    missing = missing_comparison(both, keys).select(*keys, "original_missing", "imputed_values", "imputation_rate")
    return records.join(flags, keys).join(missing, keys).join(trends, keys)


def overall_summary(both: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean imputation rate and mean change of mean and std over stations."""
    m = basic_statistics(both, [*keys, "version"]).groupBy(*keys).pivot("version", ["original", "imputed"]).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"))
    j = m.join(missing_comparison(both, keys), keys)
    return j.agg(
        F.count(F.lit(1)).alias("total_stations"), F.avg("imputation_rate").alias("average_imputation_rate"),
        F.avg(change_pct("mean")).alias("mean_change_pct"), F.avg(change_pct("std")).alias("std_change_pct"),
    )


def prediction_summary(predictions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per station: count, dates and moments of the rows of type prediction (at most one horizon each)."""
    return predictions.filter(F.col("type") == "prediction").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.percentile("value", 0.5).alias("median"),
    )


def run_summary(report: DataFrame) -> DataFrame:
    """Stations done and failed, success rate, and rows kept of the rows read."""
    return report.agg(
        F.count(F.lit(1)).alias("stations_total"),
        count_where(F.col("status") != "failed").alias("stations_ok"),
        count_where(F.col("status") == "failed").alias("stations_failed"),
        F.sum("total_count").alias("rows_in"), F.sum("cleaned_count").alias("rows_out"),
    ).withColumns({
        "success_rate": div("stations_ok", "stations_total") * 100,
        "row_efficiency": div("rows_out", "rows_in") * 100,
    })


def histogram(df: DataFrame, bins: int = 30, keys: list[str] = ()) -> DataFrame:
    """Equal-width bins over the range of the column; the last one is closed."""
    keys = list(keys)
    known = df.filter(F.col("value").isNotNull())
    if keys:
        bounds = known.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        ranged = known.join(bounds, keys)
    else:
        ranged = known.withColumns({"lo": known.agg(F.min("value")).scalar(), "hi": known.agg(F.max("value")).scalar()})
    width = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.least(F.floor(F.coalesce(div(F.col("value") - F.col("lo"), width), F.lit(0.0))), F.lit(bins - 1))
    return (
        ranged
        .groupBy(*keys, bin_no.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), "n")
    )


def boxplot_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Five-number summary by group, over groups of any size."""
    return exact_quantiles(
        df, by, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    )
