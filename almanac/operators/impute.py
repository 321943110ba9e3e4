"""Missing blocks and ways to fill them. Input: a complete calendar with ``pos``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.expr import count_where, div, rnd
from almanac.plans import blocks
from almanac.plans.quantiles import series_quantiles

KEYS = ["station_code", "station"]

# Block classes by length in rows, and the limits used by the fills.
SMALL_MAX = 3
MEDIUM_MAX = 30
LARGE_TRIM = 548
PERIOD = 365
AR_CONTEXT = 100
AR_MIN_CONTEXT = 50


def block_class(length: Column) -> Column:
    return F.when(length <= SMALL_MAX, "small").when(length <= MEDIUM_MAX, "medium").otherwise("large")


def missing_blocks(df: DataFrame, keys: list[str] = KEYS, split: bool = False) -> DataFrame:
    """One row per run of nulls. All rows of a run share the known point before it."""
    near = blocks.carry(
        df.withColumn("known", F.when(F.col("value").isNotNull(), F.col("pos"))), keys,
        {"after": ("known", "back", True)}, split=split,
    )
    return (
        near.filter(F.col("value").isNull())
        .groupBy(*keys, F.coalesce("after", F.lit(0).cast("bigint")).alias("after"))
        .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"),
             F.count(F.lit(1)).alias("length"))
        .select(*keys, (F.col("after") + 1).alias("start_pos"), (F.col("after") + F.col("length")).alias("end_pos"),
                "start_date", "end_date", "length", block_class(F.col("length")).alias("block_class"))
    )


def classify_blocks(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return missing_blocks(df, keys).groupBy(*keys, "block_class").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("length").alias("missing_rows"), F.max("length").alias("longest")
    )


def trim_large_blocks(df: DataFrame, max_length: int = LARGE_TRIM, keys: list[str] = KEYS) -> DataFrame:
    """Drop every row up to the end of the last block longer than ``max_length``."""
    cut = (
        missing_blocks(df, keys).filter(F.col("length") > max_length)
        .groupBy(*keys).agg(F.max("end_pos").alias("cut_pos"), F.count(F.lit(1)).alias("blocks_removed"))
    )
    return (
        df.join(cut, keys, "left")
        .filter(F.col("pos") > F.coalesce("cut_pos", F.lit(0)))
        .withColumn("blocks_removed", F.coalesce("blocks_removed", F.lit(0).cast("bigint")))
        .withColumn("pos", F.col("pos") - F.coalesce("cut_pos", F.lit(0)))
        .drop("cut_pos")
    )


def _between() -> Column:
    """Straight line between the known points around a row; null when one is missing."""
    return F.when(F.col("prev_pos") == F.col("pos"), F.col("value")).otherwise(
        F.col("prev_value")
        + (F.col("next_value") - F.col("prev_value"))
        * div(F.col("pos") - F.col("prev_pos"), F.col("next_pos") - F.col("prev_pos"))
    )


_NEAR_COLS = ("prev_pos", "prev_value", "next_pos", "next_value")


def impute_linear(df: DataFrame, keys: list[str] = KEYS, split: bool = False) -> DataFrame:
    """Linear in row position; edges repeat the nearest known value. ``imputed`` marks filled rows."""
    out = blocks.neighbours(df, keys, split=split).withColumns({
        "imputed": F.col("value").isNull(),
        "value": F.coalesce(_between(), F.col("prev_value"), F.col("next_value")),
    })
    return out.drop(*_NEAR_COLS)


def impute_linear_forward(df: DataFrame, keys: list[str] = KEYS, split: bool = False) -> DataFrame:
    """Linear; leading nulls stay null, trailing ones repeat the last value."""
    out = blocks.neighbours(df, keys, split=split).withColumns({
        "imputed": F.col("value").isNull() & F.col("prev_value").isNotNull(),
        "value": F.coalesce(_between(), F.col("prev_value")),
    })
    return out.drop(*_NEAR_COLS)


def impute_ffill(df: DataFrame, keys: list[str] = KEYS, split: bool = False) -> DataFrame:
    out = blocks.carry(df, keys, {"prev_value": ("value", "back", True)}, split=split)
    return out.withColumns({"imputed": F.col("value").isNull(), "value": F.col("prev_value")}).drop("prev_value")


def impute_bfill(df: DataFrame, keys: list[str] = KEYS, split: bool = False) -> DataFrame:
    out = blocks.carry(df, keys, {"next_value": ("value", "ahead", True)}, split=split)
    return out.withColumns({"imputed": F.col("value").isNull(), "value": F.col("next_value")}).drop("next_value")


def impute_mean(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    means = df.groupBy(*keys).agg(F.avg("value").alias("fill"))
    return _fill_from(df, means, keys)


def impute_median(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return _fill_from(df, series_quantiles(df, keys, {"fill": 0.5}), keys)


def _fill_from(df: DataFrame, per_station: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(per_station, keys).withColumns({
        "imputed": F.col("value").isNull(), "value": F.coalesce("value", "fill"),
    }).drop("fill")


def _with_three_points(df: DataFrame, keys: list[str], split: bool = False) -> DataFrame:
    """Known points around each row: the last two at or before it and the next one."""
    pt = F.when(F.col("value").isNotNull(), F.struct(F.col("pos").alias("p"), F.col("value").alias("v")))
    first = blocks.carry(
        df.withColumn("pt", pt), keys, {"older": ("pt", "back", False), "ahead": ("pt", "ahead", True)},
        split=split,
    )
    pair = F.when(F.col("pt").isNotNull(), F.struct(F.col("pt").alias("a"), F.col("older").alias("b")))
    both = blocks.carry(first.withColumn("pair", pair), keys, {"behind": ("pair", "back", True)}, split=split)
    return both.withColumns({
        "prev_pos": F.col("behind.a.p"), "prev_value": F.col("behind.a.v"),
        "prev2_pos": F.col("behind.b.p"), "prev2_value": F.col("behind.b.v"),
        "next_pos": F.col("ahead.p"), "next_value": F.col("ahead.v"),
    }).drop("pt", "older", "ahead", "pair", "behind")


def _quadratic() -> Column:
    """Parabola through two known points before and one after a gap (Newton form)."""
    x = F.col("pos")
    x0, y0 = F.col("prev2_pos"), F.col("prev2_value")
    x1, y1 = F.col("prev_pos"), F.col("prev_value")
    x2, y2 = F.col("next_pos"), F.col("next_value")
    d01 = div(y1 - y0, x1 - x0)
    d12 = div(y2 - y1, x2 - x1)
    d012 = div(d12 - d01, x2 - x0)
    curve = y1 + (x - x1) * d12 + (x - x1) * (x - x2) * d012
    return F.when(x1 == x, F.col("value")).otherwise(curve)


_THREE_COLS = ("prev_pos", "prev_value", "prev2_pos", "prev2_value", "next_pos", "next_value")


def impute_polynomial(df: DataFrame, keys: list[str] = KEYS, split: bool = False) -> DataFrame:
    """Order-2 interpolation, linear where the second point before is missing, nearest value at the edges."""
    out = _with_three_points(df, keys, split).withColumns({
        "imputed": F.col("value").isNull(),
        "value": F.coalesce(_quadratic(), _between(), F.col("prev_value"), F.col("next_value")),
    })
    return out.drop(*_THREE_COLS)


def seasonal_decompose(df: DataFrame, period: int = PERIOD, keys: list[str] = KEYS) -> DataFrame:
    """Additive split: centred moving average, mean of the detrended values by phase, rest.

    ``df`` must carry ``value`` (nulls allowed) and ``pos``; the phase is the day of year
    folded into the period. Trend is null where the full window is not inside the series.
    """
    half = period // 2
    spread = blocks.halo(df, keys, half, half)
    t = blocks.core(blocks.centred_mean(spread, keys, "value", half, "trend"))
    t = t.withColumn("trend", F.when(F.col("trend_rows") == 2 * half + 1, F.col("trend"))).drop("trend_rows")
    t = t.withColumn("phase", F.pmod(F.dayofyear("date") - 1, F.lit(period)))
    by_phase = t.groupBy(*keys, "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("raw"))
    # at most ``period`` rows per station; a phase never measured lies between its neighbours
    known = F.when(F.col("raw").isNotNull(), F.struct(F.col("phase").alias("p"), F.col("raw").alias("v")))
    near = blocks.carry(
        by_phase.withColumns({"pos": F.col("phase"), "pt": known}), keys,
        {"before": ("pt", "back", True), "after": ("pt", "ahead", True)})
    cycle = F.coalesce(
        F.col("raw"),
        F.col("before.v") + (F.col("after.v") - F.col("before.v"))
        * div(F.col("phase") - F.col("before.p"), F.col("after.p") - F.col("before.p")),
        F.col("before.v"), F.col("after.v"), F.lit(0.0))
    centre = F.avg("cycle").over(Window.partitionBy(*keys))
    seasonal = near.withColumn("cycle", cycle).select(*keys, "phase", (F.col("cycle") - centre).alias("seasonal"))
    return t.join(seasonal, [*keys, "phase"]).withColumn(
        "resid", F.col("value") - F.col("trend") - F.col("seasonal")
    )


def _seasonal_estimate(df: DataFrame, period: int, keys: list[str]) -> DataFrame:
    """Adds ``seas_value``: filled trend + seasonal + residual decaying from the block's start."""
    parts = seasonal_decompose(df, period, keys)
    known = F.when(F.col("trend").isNotNull(), F.struct(F.col("pos").alias("p"), F.col("trend").alias("v")))
    res = F.when(F.col("value").isNotNull(), F.col("pos"))
    near = blocks.carry(
        parts.withColumns({"tp": known, "known_pos": res}), keys,
        {"tb": ("tp", "back", True), "ta": ("tp", "ahead", True),
         "last_known": ("known_pos", "back", True)},
    )
    line = F.coalesce(
        F.when(F.col("tb.p") == F.col("pos"), F.col("trend")),
        F.col("tb.v") + (F.col("ta.v") - F.col("tb.v"))
        * div(F.col("pos") - F.col("tb.p"), F.col("ta.p") - F.col("tb.p")),
        F.col("tb.v"), F.col("ta.v"),
    )
    level = near.withColumn("trend_full", line).withColumn(
        "res", F.col("value") - F.col("trend_full") - F.col("seasonal")
    )
    in_order = Window.partitionBy(*keys).orderBy("pos")
    lagged = level.withColumn("res_lag", F.lag("res").over(in_order))
    last_res = blocks.carry(lagged, keys, {"res_before": ("res", "back", True)})
    # one decay rate per station by least squares on neighbouring residuals, kept inside (-1, 1)
    whole = Window.partitionBy(*keys)
    fitted = last_res.withColumns({
        "phi": F.regr_slope("res", "res_lag").over(whole), "n_known": F.count("value").over(whole),
        "n_pairs": F.count("res_lag").over(whole),
    })
    k = F.col("pos") - F.col("last_known")
    rho = F.least(F.greatest(F.col("phi"), F.lit(-0.99)), F.lit(0.99))
    decayed = F.when(
        (F.col("n_pairs") >= AR_MIN_CONTEXT) & F.col("res_before").isNotNull(),
        F.col("res_before") * F.pow(rho, k),
    ).otherwise(0.0)
    return fitted.withColumn(
        "seas_value",
        F.when(F.col("n_known") >= 2 * period, F.col("trend_full") + F.col("seasonal") + decayed),
    )


_SEAS_COLS = ("trend", "phase", "seasonal", "resid", "tp", "known_pos", "tb", "ta", "last_known", "trend_full",
              "res", "res_lag", "res_before", "phi", "n_known", "n_pairs", "seas_value")


def impute_seasonal(df: DataFrame, period: int = PERIOD, keys: list[str] = KEYS) -> DataFrame:
    """Fill from trend, season and decaying residual; stations short of two periods fall back to polynomial."""
    est = _seasonal_estimate(df, period, keys)
    out = _with_three_points(est, keys).withColumns({
        "imputed": F.col("value").isNull(),
        "value": F.coalesce("value", "seas_value", _quadratic(), _between(), "prev_value", "next_value"),
    })
    return out.drop(*_SEAS_COLS, *_THREE_COLS)


def impute_auto(df: DataFrame, min_points: int = 30, period: int = PERIOD, keys: list[str] = KEYS) -> DataFrame:
    """Each gap by its class: small linear, medium polynomial, large seasonal.

    Stations with fewer than ``min_points`` known values use the polynomial fill for all gaps.
    """
    est = _seasonal_estimate(df, period, keys)
    near = _with_three_points(est, keys)
    # A gap at the end runs to the station's last row, one at the start from its first.
    end = F.max("pos").over(Window.partitionBy(*keys)) + 1
    length = F.coalesce("next_pos", end) - F.coalesce("prev_pos", F.lit(0)) - 1
    kind = F.when(F.col("n_known") < min_points, "medium").otherwise(block_class(length))
    by_class = (
        F.when(F.col("fill_class") == "small", _between())
        .when(F.col("fill_class") == "medium", _quadratic())
        .otherwise(F.coalesce(F.col("seas_value"), _quadratic()))
    )
    out = near.withColumn("fill_class", F.when(F.col("value").isNull(), kind)).withColumns({
        "imputed": F.col("value").isNull(),
        "value": F.coalesce("value", by_class, _between(), "prev_value", "next_value"),
    })
    return out.drop(*_SEAS_COLS, *_THREE_COLS)


def imputation_report(
    original: DataFrame, trimmed: DataFrame, done: DataFrame, method: str, keys: list[str] = KEYS
) -> DataFrame:
    """Per station: status, missing counts before and after trimming, imputed and removed rows, shares."""
    before = original.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_count"), count_where(F.col("value").isNull()).alias("original_missing")
    )
    cleaned = trimmed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cleaned_count"), count_where(F.col("value").isNull()).alias("cleaned_missing")
    )
    after = done.groupBy(*keys).agg(
        count_where(F.col("imputed") & F.col("value").isNotNull()).alias("imputed_count"),
        count_where(F.col("value").isNull()).alias("remaining_missing"),
    )
    zero = F.lit(0).cast("bigint")
    j = before.join(cleaned, keys, "left").join(after, keys, "left").na.fill(
        0, ["cleaned_count", "cleaned_missing", "imputed_count", "remaining_missing"]
    )
    return j.withColumns({
        "rows_removed": F.col("total_count") - F.col("cleaned_count"),
        "missing_pct": rnd(div("original_missing", "total_count") * 100, 2),
        "imputed_pct": rnd(F.coalesce(div("imputed_count", "cleaned_missing"), F.lit(0.0)) * 100, 2),
        "method": F.when(F.col("original_missing") == zero, "none")
        .when(F.col("cleaned_missing") == zero, "cleaning_only").otherwise(method),
        "status": F.when(F.col("cleaned_count") == zero, "failed")
        .when(F.col("remaining_missing") > zero, "partial").otherwise("success"),
    })


def imputation_summary(report: DataFrame) -> DataFrame:
    """Totals over stations: one row for all methods together and one per method."""
    return report.rollup("method").agg(
        F.count(F.lit(1)).alias("total_stations"),
        count_where(F.col("status") == "success").alias("successful_stations"),
        F.sum("original_missing").alias("total_original_missing"),
        F.sum("imputed_count").alias("total_imputed"),
        F.max("original_missing").alias("max_missing"), F.min("original_missing").alias("min_missing"),
        rnd(F.avg("original_missing"), 2).alias("avg_missing"),
        F.max("imputed_count").alias("max_imputed"), F.min("imputed_count").alias("min_imputed"),
        rnd(F.avg("imputed_count"), 2).alias("avg_imputed"),
    ).withColumns({
        "method": F.coalesce("method", F.lit("all")),
        "success_rate": rnd(div("successful_stations", "total_stations") * 100, 2),
        "overall_imputation_rate": rnd(
            F.coalesce(div("total_imputed", "total_original_missing"), F.lit(0.0)) * 100, 2),
    })
