"""Window features, weights, samples and scaling of complete station series (``value`` and ``pos``)."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.expr import count_where, div, pearson
from almanac.operators.reshape import tail_rows
from almanac.plans import blocks
from almanac.plans.lineage import cut
from almanac.plans.quantiles import series_quantiles
from almanac.plans.selection import smallest

KEYS = ["station_code", "station"]

# Feature windows, periods, lags and percentiles.
ROLLING = (3, 7, 14, 30, 90)
PERIODS = (7, 30, 365)
TREND = (7, 14, 30, 90)
VOLATILITY = (5, 10, 20)
MOMENTUM = (1, 3, 7, 14)
LAGS = (1, 7, 14, 30)
PERCENTILES = (5, 25, 50, 75, 95)
TINY = 1e-9


def lag_features(df: DataFrame, lags: int = 7, keys: list[str] = KEYS) -> DataFrame:
    """The row's value as ``target`` and the ``lags`` values strictly before it; rows without all of them drop out."""
    out = blocks.framed(
        df, keys, lambda w: {f"lag_{k}": F.lag("value", k).over(w) for k in range(1, lags + 1)}, before=lags
    )
    return out.filter(F.col(f"lag_{lags}").isNotNull()).withColumn("target", F.col("value"))


def _sorted_percentile(arr: Column, n: int, p: int) -> Column:
    rank = (n - 1) * p / 100.0
    lo = int(rank)
    low, high = F.get(arr, F.lit(lo)), F.get(arr, F.lit(min(lo + 1, n - 1)))
    return low + (high - low) * (rank - lo)


def _sum_abs_from(arr: Column, centre: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.abs(x - centre))


def _if_varies(raw: str, std: str, full: Column) -> Column:
    """A standardised moment where the window is full and something varies, else 0."""
    return F.when(full & (F.col(std) > TINY), F.col(raw)).otherwise(0.0)


def rolling_stats(df: DataFrame, windows=ROLLING, keys: list[str] = KEYS) -> DataFrame:
    """Per trailing window: moments, extremes, percentiles, mean absolute deviation, share of rises.

    Zero until the window fills. The ordered window values are gathered once per window and
    all order statistics read from them.
    """
    reach = max(windows)
    w = blocks.block_window(keys)
    base = blocks.halo(df, keys, before=reach).withColumn(
        "rise", F.when(F.col("value") > F.lag("value").over(w), 1.0).otherwise(0.0)
    )
    first, second = {}, {}
    for n in windows:
        frame, diffs = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(n - 2), 0)
        full = F.col("pos") >= n
        when = lambda c, full=full: F.when(full, c).otherwise(0.0)
        first[f"sorted_{n}"] = F.sort_array(F.collect_list("value").over(frame))
        first[f"mean_{n}"] = when(F.avg("value").over(frame))
        first[f"std_{n}"] = when(F.stddev_pop("value").over(frame))
        first[f"rs_{n}"], first[f"rk_{n}"] = F.skewness("value").over(frame), F.kurtosis("value").over(frame)
        second[f"skew_{n}"] = _if_varies(f"rs_{n}", f"std_{n}", full)
        second[f"kurt_{n}"] = _if_varies(f"rk_{n}", f"std_{n}", full)
        first[f"up_{n}"] = when(F.sum("rise").over(diffs) / (n - 1))
        arr = F.col(f"sorted_{n}")
        second[f"min_{n}"] = when(F.get(arr, F.lit(0)))
        second[f"max_{n}"] = when(F.try_element_at(arr, F.lit(-1)))
        second[f"range_{n}"] = when(F.try_element_at(arr, F.lit(-1)) - F.get(arr, F.lit(0)))
        for p in PERCENTILES:
            second[f"p{p}_{n}"] = F.when(full, _sorted_percentile(arr, n, p)).otherwise(0.0)
        second[f"median_{n}"] = F.when(full, _sorted_percentile(arr, n, 50)).otherwise(0.0)
        second[f"var_{n}"] = F.col(f"std_{n}") * F.col(f"std_{n}")
        second[f"mad_{n}"] = when(_sum_abs_from(arr, F.col(f"mean_{n}")) / n)
    out = blocks.core(base.withColumns(first).withColumns(second))
    return out.drop("rise", *[f"{c}_{n}" for n in windows for c in ("sorted", "rs", "rk")])


ROLLING_NAMES = ("mean", "std", "min", "max", "range", "median", "skew", "kurt",
                 *[f"p{p}" for p in PERCENTILES], "var", "mad", "up")


def rolling_mean_std7(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean and population std of the seven rows before each row; the series' own where there are fewer."""
    def exprs(w):
        frame = w.rowsBetween(-7, -1)
        return {"m7": F.avg("value").over(frame), "s7": F.stddev_pop("value").over(frame)}
    whole = df.groupBy(*keys).agg(F.avg("value").alias("mean_all"), F.stddev_pop("value").alias("std_all"))
    full = F.col("pos") > 7
    return blocks.framed(df, keys, exprs, before=7).join(whole, keys).withColumns({
        "rolling_mean": F.when(full, F.col("m7")).otherwise(F.col("mean_all")),
        "rolling_std": F.when(full, F.col("s7")).otherwise(F.col("std_all")),
    }).drop("m7", "s7", "mean_all", "std_all")


def seasonal_pattern(df: DataFrame, periods=PERIODS, keys: list[str] = KEYS) -> DataFrame:
    """Statistics of the mean by phase, one row per station and period; zeros below two periods."""
    phases = df.withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))
    means = phases.groupBy(*keys, "period", F.pmod(F.col("pos") - 1, F.col("period")).alias("phase")).agg(
        F.avg("value").alias("m"), F.count(F.lit(1)).alias("c"))
    # at most one row per phase of the longest period
    w = Window.partitionBy(*keys, "period").orderBy("phase")
    lagged = means.withColumn("before", F.lag("m").over(w))
    stats = lagged.groupBy(*keys, "period").agg(
        F.sum("c").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"),
        F.max("m").alias("max"), F.min("m").alias("min"), pearson(F.col("m"), F.col("before")).alias("autocorr"))
    enough = F.col("n") >= 2 * F.col("period")
    stats = stats.withColumn("range", F.col("max") - F.col("min"))
    return stats.select(*keys, "period", *[
        F.when(enough, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(f"seasonal_{c}")
        for c in ("mean", "std", "max", "min", "range", "autocorr")])


def _dot(arr: Column, weights: list[float]) -> Column:
    pairs = F.zip_with(arr, F.array(*[F.lit(float(x)) for x in weights]), lambda x, u: x * u)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def trend_window(df: DataFrame, windows=TREND, keys: list[str] = KEYS) -> DataFrame:
    """Line and parabola over trailing windows with x = 0..w-1.

    The abscissae are the same for every window, so both fits are fixed weights on the
    window's values (orthogonal polynomials), which loses no digits on long series.
    """
    w = blocks.block_window(keys)
    base = blocks.halo(df, keys, before=max(windows))
    gathered, fits, out = {}, {}, {}
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        gathered |= {f"arr_{n}": F.collect_list("value").over(frame), f"vp_{n}": F.var_pop("value").over(frame),
                     f"m_{n}": F.avg("value").over(frame)}
        half, mu2 = (n - 1) / 2.0, (n * n - 1) / 12.0
        quart = n * (n * n - 1) * (n * n - 4) / 180.0
        full = F.col("pos") >= n
        fits |= {
            f"slope_{n}": F.when(full, _dot(F.col(f"arr_{n}"), [i - half for i in range(n)]) / (n * mu2)).otherwise(0.0),
            f"quad_a_{n}": F.when(
                full, _dot(F.col(f"arr_{n}"), [(i - half) ** 2 - mu2 for i in range(n)]) / quart).otherwise(0.0),
        }
        slope, quad = F.col(f"slope_{n}"), F.col(f"quad_a_{n}")
        some = F.col(f"vp_{n}") > TINY * TINY
        out |= {
            f"intercept_{n}": F.when(full, F.col(f"m_{n}") - slope * half).otherwise(0.0),
            f"quad_b_{n}": F.when(full, slope - quad * (n - 1)).otherwise(0.0),
            f"r2_{n}": F.when(full & some, F.try_divide(slope * slope * mu2, F.col(f"vp_{n}"))).otherwise(0.0),
            f"direction_{n}": F.when(~full, 0.0).when(slope > TINY, 1.0).otherwise(-1.0),
        }
    done = blocks.core(base.withColumns(gathered).withColumns(fits).withColumns(out))
    return done.drop(*gathered)


TREND_NAMES = ("slope", "intercept", "quad_a", "quad_b", "r2", "direction")


def volatility(df: DataFrame, windows=VOLATILITY, keys: list[str] = KEYS) -> DataFrame:
    """Statistics of the returns inside trailing windows; zero until the window fills."""
    w = blocks.block_window(keys)
    prev = F.lag("value").over(w)
    base = blocks.halo(df, keys, before=max(windows)).withColumn("ret", div(F.col("value") - prev, prev))
    base = base.withColumns({"ret_abs": F.abs("ret"), "ret_sq": F.col("ret") * F.col("ret")})
    out, moments = {}, {}
    for n in windows:
        frame = w.rowsBetween(-(n - 2), 0)
        full = F.col("pos") >= n
        plain = {
            "std": F.stddev_pop("ret"), "mean_abs": F.avg("ret_abs"), "max_abs": F.max("ret_abs"),
            "var": F.var_pop("ret"), "mean_sq": F.avg("ret_sq"), "std_sq": F.stddev_pop("ret_sq"),
        }
        out |= {f"{k}_{n}": F.when(full, c.over(frame)).otherwise(0.0) for k, c in plain.items()}
        out[f"rs_{n}"], out[f"rk_{n}"] = F.skewness("ret").over(frame), F.kurtosis("ret").over(frame)
        moments[f"skew_{n}"] = _if_varies(f"rs_{n}", f"std_{n}", full)
        moments[f"kurt_{n}"] = _if_varies(f"rk_{n}", f"std_{n}", full)
    done = blocks.core(base.withColumns(out).withColumns(moments))
    return done.drop("ret", "ret_abs", "ret_sq", *[f"{c}_{n}" for n in windows for c in ("rs", "rk")])


VOLATILITY_NAMES = ("std", "mean_abs", "max_abs", "var", "skew", "kurt", "mean_sq", "std_sq")


def momentum(df: DataFrame, windows=MOMENTUM, keys: list[str] = KEYS) -> DataFrame:
    """Rate of change, its change, and the share of rises."""
    w = blocks.block_window(keys)
    base = blocks.halo(df, keys, before=2 * max(windows)).withColumn(
        "rise", F.when(F.col("value") > F.lag("value").over(w), 1.0).otherwise(0.0))
    out = {}
    for n in windows:
        one, two = F.lag("value", n).over(w), F.lag("value", 2 * n).over(w)
        roc = F.coalesce(div(F.col("value") - one, one), F.lit(0.0))
        before = F.coalesce(div(one - two, two), F.lit(0.0))
        full = F.col("pos") >= n + 1
        out[f"roc_{n}"] = F.when(full, roc).otherwise(0.0)
        out[f"accel_{n}"] = F.when(F.col("pos") >= 2 * n + 1, roc - before).otherwise(0.0)
        rises = F.sum("rise").over(w.rowsBetween(-(n - 2), 0)) / (n - 1) if n > 1 else F.lit(0.0)
        out[f"strength_{n}"] = F.when(full, rises).otherwise(0.0)
    return blocks.core(base.withColumns(out)).drop("rise")


MOMENTUM_NAMES = ("roc", "accel", "strength")


def position_stats(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each row against its station's history up to it: z-score, coefficient of variation, rank and outlier flag.

    The rank is the share of known values strictly below; an outlier lies over one and a half
    interquartile ranges outside the quartiles (linear between neighbours). Order statistics of a
    growing history need its values in order: one pass per station keeps them sorted, over a
    daily series, which the calendar bounds. Rows without a value get nulls there.
    """
    grow = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"m": F.avg("value").over(grow), "s": F.stddev_pop("value").over(grow)})
    known = df.where("value IS NOT NULL").select(*keys, "pos", "value")
    types = dict(known.dtypes)

    def history(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        ordered: list[float] = []
        rank, outlier = np.zeros(len(pdf)), np.zeros(len(pdf), np.int32)
        for i, v in enumerate(pdf["value"].to_numpy()):
            below = bisect.bisect_left(ordered, v)
            ordered.insert(below, v)
            n = len(ordered)
            rank[i] = below / n
            q = []
            for share in (0.25, 0.75):
                at = share * (n - 1)
                lo = int(at)
                q.append(ordered[lo] + (ordered[min(lo + 1, n - 1)] - ordered[lo]) * (at - lo))
            reach = 1.5 * (q[1] - q[0])
            outlier[i] = v < q[0] - reach or v > q[1] + reach
        return pdf.drop(columns="value").assign(percentile_rank=rank, is_outlier=outlier)

    shape = ", ".join(f"`{c}` {types[c]}" for c in (*keys, "pos")) + ", percentile_rank double, is_outlier int"
    placed = known.groupBy(*keys).applyInPandas(history, shape)
    return rows.join(placed, [*keys, "pos"], "left").withColumns({
        "z_score": F.when(F.col("s") > TINY, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0),
        "coef_variation": F.coalesce(div("s", "m"), F.lit(0.0)),
    }).drop("m", "s")


def latest_position(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Share of values strictly below the latest one, and its outlier flag."""
    q = series_quantiles(df, keys, {"q1": 0.25, "q3": 0.75})
    last = df.groupBy(*keys).agg(F.max_by("value", "pos").alias("last_value"))
    iqr = F.col("q3") - F.col("q1")
    v = F.col("last_value")
    return df.join(last.join(q, keys), keys).groupBy(*keys).agg(
        F.avg(F.when(F.col("value") < v, 1.0).otherwise(0.0)).alias("percentile_rank"),
        F.max(F.when((v < F.col("q1") - 1.5 * iqr) | (v > F.col("q3") + 1.5 * iqr), 1).otherwise(0)).alias("is_outlier"),
    )


def bin_entropy(df: DataFrame, bins: Column, keys: list[str]) -> DataFrame:
    """Entropy of the shares in equal-width bins, and the number of bins in use."""
    bounds = df.groupBy(*keys).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    bounds = bounds.withColumn("bins", F.greatest(bins, F.lit(1)))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    bin_no = F.least(F.floor(F.coalesce(div(F.col("value") - F.col("lo"), width), F.lit(0.0))), F.col("bins") - 1)
    counts = df.join(bounds, keys).groupBy(*keys, "n", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.col("n")
    return counts.groupBy(*keys).agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("bins_used"), F.sum(-share * F.ln(share)).alias("entropy"))


def entropy(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    out = bin_entropy(df, F.least(F.lit(10), F.floor(F.col("n") / 10)), keys)
    return out.withColumn("entropy", F.when(F.col("n") > 10, F.col("entropy")).otherwise(0.0))


def lag_correlations(df: DataFrame, lags, keys: list[str] = KEYS) -> DataFrame:
    """Correlation of the series with itself shifted by each lag: one row per key, columns ``ac_{lag}``.

    Null where the overlap is too short or one side is constant.
    """
    lagged = blocks.framed(
        df, keys, lambda w: {f"l_{k}": F.lag("value", k).over(w) for k in lags}, before=max(lags))
    return lagged.groupBy(*keys).agg(
        *[pearson(F.col("value"), F.col(f"l_{k}")).alias(f"ac_{k}") for k in lags])


def dominant_period(df: DataFrame, max_lag: int = 19, keys: list[str] = KEYS) -> DataFrame:
    """First local peak (at least 0.1) of the autocorrelation at lags 1..19, zeros if there is none."""
    lags = range(1, max_lag + 1)
    lagged = blocks.framed(
        df, keys, lambda w: {f"l_{k}": F.lag("value", k).over(w) for k in lags}, before=max_lag)
    pairs = lagged.select(*keys, "value", F.posexplode(F.array(*[F.col(f"l_{k}") for k in lags])).alias("i", "other"))
    corr = pairs.groupBy(*keys, (F.col("i") + 1).alias("lag")).agg(
        F.coalesce(pearson(F.col("value"), F.col("other")), F.lit(0.0)).alias("ac"),
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("lag")  # nineteen rows
    peaks = corr.withColumns({"b": F.lag("ac").over(w), "a": F.lead("ac").over(w)})
    is_peak = (F.col("ac") > F.col("b")) & (F.col("ac") > F.col("a")) & (F.col("ac") >= 0.1) & (F.col("n") >= 20)
    best = peaks.groupBy(*keys).agg(
        F.min(F.when(is_peak, F.col("lag"))).alias("p"),
        F.min_by("ac", F.when(is_peak, F.col("lag"))).alias("a"))
    return best.select(*keys, F.coalesce("p", F.lit(0)).cast("int").alias("dominant_period"),
                       F.coalesce("a", F.lit(0.0)).alias("peak_autocorr"))


def spectrum_by_group(df: DataFrame, keys: list[str], schema: str, summarise) -> DataFrame:
    """FFT per series. A group is one daily series, bounded by the calendar: eight bytes per day."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("pos")["value"].to_numpy(dtype=float)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **summarise(v)}])

    kinds = dict(df.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return df.select(*keys, "pos", "value").groupBy(*keys).applyInPandas(run, f"{head}, {schema}")


def _spectral_summary(v: np.ndarray) -> dict:
    n = len(v)
    names = ("dominant_frequency", "power_per_row", "centroid", "bandwidth", "rolloff")
    if n < 16:
        return dict.fromkeys(names, 0.0)
    power = np.abs(np.fft.rfft(v))[: n // 2] ** 2
    total = power.sum()
    bins = np.arange(len(power))
    out = {"dominant_frequency": float(np.argmax(power[1:]) + 1) / n, "power_per_row": total / n}
    if total <= 0:
        return {**out, "centroid": 0.0, "bandwidth": 0.0, "rolloff": 0.0}
    centroid = (bins * power).sum() / total
    out["centroid"] = centroid
    out["bandwidth"] = float(np.sqrt(((bins - centroid) ** 2 * power).sum() / total))
    out["rolloff"] = float(np.argmax(np.cumsum(power) >= 0.85 * total)) / n
    return out


def spectral_features(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Dominant frequency, power, centroid, bandwidth and 85% roll-off; zeros below 16 rows."""
    return spectrum_by_group(
        df, keys, "dominant_frequency double, power_per_row double, centroid double, bandwidth double, rolloff double",
        _spectral_summary)


def _at_last(df: DataFrame, names: list[str], prefix: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max_by(c, "pos").alias(f"{prefix}{c}") for c in names])


def feature_row(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """All features at the latest row of each station, one wide row.

    Frame features only need the last rows, so they run on a short tail; ``pos`` is kept, so
    windows longer than the series stay zero.
    """
    df = cut(df)  # a dozen branches read it
    tail = tail_rows(df, max(ROLLING) + 2 * max(MOMENTUM) + 1, keys).drop("age")
    frames = [
        _at_last(lag_features(tail, 7, keys), [f"lag_{k}" for k in range(1, 8)], "", keys),
        _at_last(rolling_stats(tail, keys=keys), [f"{c}_{n}" for n in ROLLING for c in ROLLING_NAMES], "rolling_", keys),
        _at_last(trend_window(tail, keys=keys), [f"{c}_{n}" for n in TREND for c in TREND_NAMES], "trend_", keys),
        _at_last(volatility(tail, keys=keys), [f"{c}_{n}" for n in VOLATILITY for c in VOLATILITY_NAMES], "vol_", keys),
        _at_last(momentum(tail, keys=keys), [f"{c}_{n}" for n in MOMENTUM for c in MOMENTUM_NAMES], "momentum_", keys),
    ]
    seasonal = seasonal_pattern(df, keys=keys).groupBy(*keys).pivot("period", list(PERIODS)).agg(
        *[F.first(f"seasonal_{c}").alias(f"seasonal_{c}") for c in ("mean", "std", "max", "min", "range", "autocorr")])
    whole = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(div(F.max_by("value", "pos") - F.avg("value"), F.stddev_pop("value")), F.lit(0.0)).alias("z_score"),
        F.coalesce(div(F.stddev_pop("value"), F.avg("value")), F.lit(0.0)).alias("coef_variation"))
    autocorr = lag_correlations(df, LAGS, keys).na.fill(0.0)
    parts = [seasonal, whole, latest_position(df, keys), entropy(df, keys).select(*keys, "entropy"), autocorr,
             dominant_period(df, keys=keys), spectral_features(df, keys)]
    out = frames[0]
    for part in frames[1:] + parts:
        out = out.join(part, keys)
    return out


def _placed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.max("pos").alias("n")), keys)


def _scaled_weights(df: DataFrame, raw: Column, keys: list[str]) -> DataFrame:
    rows = _placed(df, keys).withColumn("raw", raw)
    total = rows.groupBy(*keys).agg(F.avg("raw").alias("mean_raw"))
    return rows.join(total, keys).withColumn("weight", F.col("raw") / F.col("mean_raw")).drop("raw", "mean_raw")


def exp_weights(df: DataFrame, decay: float = 0.1, keys: list[str] = KEYS) -> DataFrame:
    """exp(-a * age), scaled to sum to the row count."""
    return _scaled_weights(df, F.exp(-decay * (F.col("n") - F.col("pos"))), keys)


def linear_weights(df: DataFrame, increment: float = 1.0, keys: list[str] = KEYS) -> DataFrame:
    """1 + b * t / T, scaled to sum to the row count."""
    share = F.coalesce(div(F.col("pos") - 1, F.col("n") - 1), F.lit(0.0))
    return _scaled_weights(df, 1 + increment * share, keys)


def sample_weights(
    df: DataFrame, method: str = "exponential", lags: int = 7, strength: float = 0.5, decay: float = 0.1,
    increment: float = 1.0, keys: list[str] = KEYS,
) -> DataFrame:
    """Weights of the training rows (those with all lags), mean 1, blended with uniform weights."""
    rows = df.filter(F.col("pos") > lags).withColumn("pos", F.col("pos") - lags)
    out = exp_weights(rows, decay, keys) if method == "exponential" else linear_weights(rows, increment, keys)
    return out.withColumn("weight", (1 - strength) + strength * F.col("weight")).withColumn("pos", F.col("pos") + lags)


def _age_band(n_recent: int) -> tuple[Column, Column]:
    age = F.col("n") - F.col("pos")
    band = (F.when(age < n_recent, "recent").when(age < 2 * n_recent, "medium").when(age < 3 * n_recent, "far")
            .when(age < 6 * n_recent, "distant").otherwise("very_distant"))
    # Share kept per age band.
    ratio = (F.when(band == "recent", 1.0).when(band == "medium", 0.8).when(band == "far", 0.6)
             .when(band == "distant", 0.4).otherwise(0.2))
    return band, ratio


def sample_order(salt: str, keys: list[str], date: str = "date") -> Column:
    """A draw per row that any engine can repeat: half of a digest of the row's keys, then the day, so that a series' draws differ."""
    text = F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in keys], F.date_format(date, "yyyy-MM-dd"))
    days = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") * 100_000 + F.pmod(days, F.lit(100_000))


def recency_sampling(df: DataFrame, recent: int = 30, keys: list[str] = KEYS) -> DataFrame:
    """Thin older rows by age band without replacement: of each band the rows with the smallest :func:`sample_order`."""
    band, ratio = _age_band(recent)
    rows = _placed(df, keys).withColumns({"band": band, "ratio": ratio, "draw": sample_order("recency", keys)})
    target = F.greatest(F.lit(1), F.floor(F.first("ratio") * F.count(F.lit(1)) + 1e-9))
    sizes = rows.groupBy(*keys, "band").agg(target.alias("size"))
    return smallest(rows, [*keys, "band"], sizes, "draw").drop("draw", "ratio")


def stratified_sample(df: DataFrame, size: int = 1500, keys: list[str] = KEYS) -> DataFrame:
    """Rows near five percentiles of the value plus a random fill; whole series up to ``size`` rows.

    As many rows per percentile as ``size`` allows, from within half a standard deviation, those with the
    smallest :func:`sample_order`.
    """
    per = size // 5
    q = series_quantiles(df, keys, {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)})
    std = df.groupBy(*keys).agg(F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("rows_in"))
    rows = df.join(q.join(std, keys), keys)
    whole = rows.filter(F.col("rows_in") <= size).withColumn("part", F.lit("all"))
    big = cut(rows.filter(F.col("rows_in") > size))
    bands = F.array(*[
        F.when(F.abs(F.col("value") - F.col(f"p{p}")) < F.col("std") * 0.5, F.lit(f"p{p}"))
        for p in (10, 25, 50, 75, 90)])
    near = big.withColumn("part", F.explode(F.array_compact(bands))).withColumn("draw", sample_order("near", ["part", *keys]))
    strata = near.select(*keys, "part").distinct().withColumn("size", F.lit(per))
    picked = cut(smallest(near, [*keys, "part"], strata, "draw"))
    taken = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("taken"))
    missing = big.select(*keys).distinct().join(taken, keys, "left").select(*keys, (F.lit(size) - F.coalesce("taken", F.lit(0))).alias("size"))
    fill = smallest(big.withColumn("draw", sample_order("fill", keys)), keys, missing, "draw").withColumn("part", F.lit("fill"))
    cols = [*keys, "date", "value", "part"]
    return whole.select(*cols).unionByName(picked.select(*cols)).unionByName(fill.select(*cols))


def train_test_split(df: DataFrame, share: float = 0.8, keys: list[str] = KEYS) -> DataFrame:
    """First ``share`` of the rows in time order train, the rest test."""
    return _placed(df, keys).withColumn(
        "part", F.when(F.col("pos") <= F.floor(F.col("n") * share + 1e-9), "train").otherwise("test"))


def scale_stats(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Centre and spread per series for each way of scaling."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), q.alias("q"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ).select(
        *keys,
        F.struct(F.col("mean").alias("centre"), F.col("std").alias("spread")).alias("standard"),
        F.struct(F.col("q")[1].alias("centre"), (F.col("q")[2] - F.col("q")[0]).alias("spread")).alias("robust"),
        F.struct(F.col("min").alias("centre"), (F.col("max") - F.col("min")).alias("spread")).alias("minmax"),
    )


def scale(df: DataFrame, how: str, keys: list[str] = KEYS) -> DataFrame:
    """(v - centre) / spread per series, with the inverse; a zero spread counts as one."""
    stats = scale_stats(df, keys).select(*keys, f"{how}.centre", F.when(F.col(f"{how}.spread") > 0, F.col(f"{how}.spread"))
                                         .otherwise(1.0).alias("spread"))
    return df.join(stats, keys).withColumn("scaled", (F.col("value") - F.col("centre")) / F.col("spread")).withColumn(
        "restored", F.col("scaled") * F.col("spread") + F.col("centre"))
