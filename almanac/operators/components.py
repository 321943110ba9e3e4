"""Additive components of a series, their properties and classes.

Long tables keyed by station and ``component`` (1 is the fastest), with ``pos`` and ``value``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.expr import count_where, div, flag, messages, pearson
from almanac.operators import features
from almanac.plans import blocks
from almanac.plans.quantiles import series_quantiles

KEYS = ["station_code", "station"]
CKEYS = [*KEYS, "component"]

# Widths of the centred averages, fast to slow; half-widths are what the frames use.
SMOOTHERS = (7, 31, 91, 365)
N_COMPONENTS = len(SMOOTHERS) + 1


def decompose(df: DataFrame, widths=SMOOTHERS, keys: list[str] = KEYS) -> DataFrame:
    """Cascade of centred moving averages: each component is what the next average removes.

    The components add up to the series. All averages run in one exchange: the halo covers
    the reach of the whole cascade.
    """
    halves = [w // 2 for w in widths]
    out = blocks.halo(df.select(*keys, "date", "pos", "value"), keys, sum(halves), sum(halves))
    level = "value"
    parts = []
    for i, half in enumerate(halves, start=1):
        out = blocks.centred_mean(out, keys, level, half, f"level_{i}").drop(f"level_{i}_rows")
        parts.append((i, F.col(level) - F.col(f"level_{i}")))
        level = f"level_{i}"
    parts.append((len(halves) + 1, F.col(level)))
    entries = F.array(*[F.struct(F.lit(i).alias("component"), c.alias("value")) for i, c in parts])
    return (
        blocks.core(out)
        .select(*keys, "date", "pos", F.col("value").alias("series_value"), F.explode(entries).alias("e"))
        .select(*keys, "e.component", "date", "pos", "series_value", F.col("e.value").alias("value"))
    )


def component_correlation(comp: DataFrame, keys: list[str] = CKEYS) -> DataFrame:
    return comp.groupBy(*keys).agg(pearson(F.col("value"), F.col("series_value")).alias("correlation"))


def variance_explained(comp: DataFrame, keys: list[str] = CKEYS) -> DataFrame:
    var = comp.groupBy(*keys).agg(
        F.var_pop("value").alias("variance"), F.var_pop("series_value").alias("series_variance"))
    share = var.withColumn("explained_ratio", F.coalesce(div("variance", "series_variance"), F.lit(0.0)))
    w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1])  # one row per component
    return share.withColumn("cumulative_ratio", F.sum("explained_ratio").over(w)).drop("series_variance")


def wide_components(comp: DataFrame, n: int = N_COMPONENTS) -> DataFrame:
    """One row per date with the components side by side; components of a date meet by key."""
    return comp.groupBy(*KEYS, "date", "pos").agg(
        F.first("series_value").alias("series_value"),
        *[F.max(F.when(F.col("component") == i, F.col("value"))).alias(f"c{i}") for i in range(1, n + 1)])


def orthogonality(comp: DataFrame, n: int = N_COMPONENTS) -> DataFrame:
    """Mean absolute correlation over the component pairs of each station."""
    pairs = [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]
    corr = wide_components(comp, n).groupBy(*KEYS).agg(
        *[F.abs(pearson(F.col(f"c{i}"), F.col(f"c{j}"))).alias(f"r_{i}_{j}") for i, j in pairs])
    return corr.select(*KEYS, F.aggregate(
        F.array(*[F.coalesce(f"r_{i}_{j}", F.lit(0.0)) for i, j in pairs]), F.lit(0.0), lambda a, x: a + x,
    ).alias("total")).select(*KEYS, (F.col("total") / len(pairs)).alias("orthogonality"))


def _with_lags(comp: DataFrame, lags) -> DataFrame:
    return blocks.framed(
        comp, CKEYS, lambda w: {f"lag_{k}": F.lag("value", k).over(w) for k in lags}, before=max(lags))


def component_quality(comp: DataFrame) -> DataFrame:
    """Mean of the zero-mean, variance and smoothness scores."""
    lagged = _with_lags(comp, [1])
    s = lagged.groupBy(*CKEYS).agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.var_pop("value").alias("v"),
        F.var_pop("series_value").alias("sv"), F.stddev_pop(F.col("value") - F.col("lag_1")).alias("ds"))
    some = F.col("s") > 0
    one = F.lit(1.0)
    zero_mean = F.when(some, 1 - F.least(div(F.abs("m"), F.col("s")), one)).otherwise(0.0)
    variance = F.least(F.coalesce(div("v", "sv"), F.lit(0.0)) * 10, one)
    smooth = F.when(some, 1 - F.least(div("ds", "s"), one)).otherwise(0.0)
    return s.select(*CKEYS, zero_mean.alias("zero_mean_score"), variance.alias("variance_score"),
                    smooth.alias("smoothness_score"), ((zero_mean + variance + smooth) / 3).alias("quality"))


def periodicity(comp: DataFrame, first: int = 5) -> DataFrame:
    """Absolute autocorrelation at lags 365, 30 and 7 of the first components, and the strongest one each."""
    lags = {"annual": 365, "monthly": 30, "weekly": 7}
    lagged = _with_lags(comp.filter(F.col("component") <= first), list(lags.values()))
    s = lagged.groupBy(*CKEYS).agg(*[
        F.coalesce(F.abs(pearson(F.col("value"), F.col(f"lag_{k}"))), F.lit(0.0)).alias(n) for n, k in lags.items()])
    return _with_strongest(s, list(lags))


def _with_strongest(s: DataFrame, names: list[str]) -> DataFrame:
    """Add the component with the highest score per station (the first on a tie)."""
    w = Window.partitionBy(*KEYS)  # one row per component
    return s.withColumns({
        f"strongest_{n}": F.max_by("component", F.struct(F.col(n), -F.col("component"))).over(w) for n in names})


def _trend_sums(comp: DataFrame) -> DataFrame:
    """Moments for line and parabola with x centred on the middle of the series."""
    n = comp.groupBy(*CKEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    u = F.col("pos") - (F.col("n") + 1) / 2
    d = F.col("value") - F.col("m")
    n_ = F.col("n").cast("double")
    s = comp.join(n, CKEYS).groupBy(*CKEYS, "n").agg(
        F.sum(u * d).alias("ud"), F.sum(u * u * d).alias("uud"), F.stddev_pop("value").alias("s"))
    suu = n_ * (n_ * n_ - 1) / 12
    quart = n_ * (n_ * n_ - 1) * (n_ * n_ - 4) / 180
    return s.select(
        *CKEYS, "n", "s", div(F.col("ud"), suu).alias("slope"), div(F.col("uud"), quart).alias("quad"),
        F.least(F.coalesce(F.try_divide(F.col("ud") * F.col("ud"), suu * F.col("s") * F.col("s") * n_), F.lit(0.0)),
                F.lit(1.0)).alias("r2"))


def component_trend(comp: DataFrame) -> DataFrame:
    """Slope and curvature against the spread, and how well the line fits; strongest component each."""
    t = _trend_sums(comp)
    long_enough = F.col("n") > 10
    s = t.select(
        *CKEYS, F.coalesce(div(F.abs("slope"), F.col("s")), F.lit(0.0)).alias("trend"),
        F.when(long_enough, F.coalesce(div(F.abs("quad"), F.col("s")), F.lit(0.0))).otherwise(0.0).alias("quadratic"),
        F.when(long_enough & (F.col("s") > 0), F.greatest(1 - F.sqrt(1 - F.col("r2")), F.lit(0.0)))
        .otherwise(0.0).alias("consistency"))
    return _with_strongest(s, ["trend", "quadratic"])


def extreme_events(comp: DataFrame) -> DataFrame:
    """Share of component values above the series' 95th or below its 5th percentile, rounding noise apart."""
    q = series_quantiles(comp.filter(F.col("component") == 1), KEYS, {"p5": 0.05, "p95": 0.95}, "series_value")
    s = comp.join(q, KEYS).groupBy(*CKEYS).agg(
        F.avg(F.when(F.col("value") > F.col("p95") + 1e-9, 1.0).otherwise(0.0)).alias("heat"),
        F.avg(F.when(F.col("value") < F.col("p5") - 1e-9, 1.0).otherwise(0.0)).alias("cold"))
    return _with_strongest(s, ["heat", "cold"])


def climate_trends(comp: DataFrame, decade: int = 3650, two_years: int = 730) -> DataFrame:
    """Trend of the whole series, of its last decade and of its yearly means, against their spread."""
    n = comp.groupBy(*CKEYS).agg(F.count(F.lit(1)).alias("n"))
    rows = comp.join(n, CKEYS)
    v, x = F.col("value"), F.col("pos").cast("double")
    span = F.least(F.lit(decade).cast("bigint"), F.floor(F.col("n") / 2))
    recent = (F.col("n") > decade) & (F.col("pos") > F.col("n") - span)
    rv, rx = F.when(recent, v), F.when(recent, x)
    whole = rows.groupBy(*CKEYS, "n").agg(
        F.regr_slope(v, x).alias("slope"), F.stddev_pop(v).alias("s"),
        F.regr_slope(rv, rx).alias("dslope"), F.stddev_pop(rv).alias("ds"), F.count(rv).alias("dn"))
    # whole years of 365 rows that start before the last 365
    year = F.floor((F.col("pos") - 1) / 365)
    yearly = rows.filter((F.col("n") > two_years) & (year * 365 < F.col("n") - 365)).groupBy(
        *CKEYS, year.alias("y")).agg(F.avg("value").alias("ym"))
    years = yearly.groupBy(*CKEYS).agg(
        F.regr_slope("ym", F.col("y").cast("double")).alias("yslope"), F.stddev_pop("ym").alias("ys"),
        F.count(F.lit(1)).alias("yn"))
    zero = F.lit(0.0)
    s = whole.join(years, CKEYS, "left").select(
        *CKEYS,
        F.coalesce(F.abs(div(F.col("slope") * F.col("n"), F.col("s"))), zero).alias("long_term"),
        F.coalesce(F.abs(div(F.col("dslope") * F.col("dn"), F.col("ds"))), zero).alias("decadal"),
        F.when(F.col("yn") > 2, F.coalesce(div(F.abs("yslope"), F.col("ys")), zero)).otherwise(0.0).alias("seasonal_trend"))
    return _with_strongest(s, ["long_term", "decadal", "seasonal_trend"])


def lag_products(comp: DataFrame, max_lag: int, keys: list[str] = CKEYS) -> DataFrame:
    """Sum of value(t) * value(t - lag) for every lag 0..max_lag, from blocks with a halo.

    Each block multiplies its own rows with the rows up to ``max_lag`` before them; the sums of
    the blocks add up. One Arrow batch holds a block, never a whole series.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        v, own = pdf["value"].to_numpy(dtype=float), pdf["core"].to_numpy(dtype=bool)
        # own rows are contiguous; a block past the end of the series has none
        mine = np.flatnonzero(own)
        out = []
        for lag in range(0, max_lag + 1):
            at = mine[mine >= lag]
            out.append((lag, float(v[at] @ v[at - lag])))
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**head, "lag": k, "product": p} for k, p in out])

    kinds = dict(comp.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", lag int, product double"
    rows = blocks.halo(comp.select(*keys, "pos", "value"), keys, before=max_lag)
    return (
        rows.groupBy(*keys, "block").applyInPandas(run, schema)
        .groupBy(*keys, "lag").agg(F.sum("product").alias("product"))
    )


def cyclical_strength(comp: DataFrame) -> DataFrame:
    """Mean height of the autocorrelation peaks at lags 10..99, scaled by lag 0."""
    p = lag_products(comp, 100)
    w = Window.partitionBy(*CKEYS).orderBy("lag")  # 101 rows
    whole = Window.partitionBy(*CKEYS)
    ac = p.withColumn("ac", F.coalesce(div("product", F.max(F.when(F.col("lag") == 0, F.col("product"))).over(whole)), F.lit(0.0)))
    near = ac.withColumns({"b": F.lag("ac").over(w), "a": F.lead("ac").over(w)})
    peak = (F.col("lag").between(10, 99) & (F.col("ac") > F.col("b") + 1e-9) & (F.col("ac") > F.col("a") + 1e-9)
            & (F.col("ac") > 0.1))
    s = near.groupBy(*CKEYS).agg(
        F.coalesce(F.avg(F.when(peak, F.col("ac"))), F.lit(0.0)).alias("cyclical"),
        count_where(peak).alias("peaks"))
    return _with_strongest(s, ["cyclical"])


def _spectrum(v: np.ndarray) -> dict:
    n = len(v)
    mag = np.abs(np.fft.fft(v))
    power = mag ** 2
    total = power.sum()
    half = mag[1: n // 2]
    return {
        "noise_ratio": float(power[n // 4:].sum() / total) if total > 0 else 0.0,
        "noise_level": float(mag[n // 4:].mean() / mag.mean()) if mag.mean() > 0 else 0.0,
        "dominant_frequency": float(np.argmax(half) + 1) / n if len(half) else 0.0,
    }


def spectra(comp: DataFrame) -> DataFrame:
    """Noise shares and dominant frequency of each component; a group is one daily series."""
    return features.spectrum_by_group(
        comp, CKEYS, "noise_ratio double, noise_level double, dominant_frequency double", _spectrum)


def noise_ratio(comp: DataFrame) -> DataFrame:
    return _with_strongest(spectra(comp).select(*CKEYS, "noise_ratio"), ["noise_ratio"])


def shape_properties(comp: DataFrame) -> DataFrame:
    """Properties that need no spectrum: correlation, variance, trend, stability, crossings, range, autocorrelation."""
    def frames(w):
        last31 = w.rowsBetween(-30, 0)
        return {"prev": F.lag("value").over(w), "v31": F.var_pop("value").over(last31)}
    rows = blocks.framed(comp, CKEYS, frames, before=31)
    # values that only differ from zero by rounding noise count as zero
    crossed = F.col("prev").isNotNull() & (F.signum(F.round("value", 9)) != F.signum(F.round("prev", 9)))
    s = rows.groupBy(*CKEYS).agg(
        F.coalesce(pearson(F.col("value"), F.col("series_value")), F.lit(0.0)).alias("correlation"),
        F.var_pop("value").alias("variance"),
        F.coalesce(F.try_divide(F.abs(F.regr_slope(F.col("value"), F.col("pos").cast("double"))), F.stddev_pop("value")), F.lit(0.0))
        .alias("trend_strength"),
        (1 / (1 + F.coalesce(F.stddev_pop(F.when(F.col("pos") > 30, F.col("v31"))), F.lit(0.0)))).alias("stability"),
        (F.sum(F.when(crossed, 1.0).otherwise(0.0)) / F.count(F.lit(1))).alias("complexity"),
        (F.max("value") - F.min("value")).alias("amplitude"), F.avg("value").alias("mean_value"),
        F.coalesce(pearson(F.col("value"), F.col("prev")), F.lit(0.0)).alias("autocorrelation"),
        F.count(F.lit(1)).alias("n"))
    return s


def component_properties(comp: DataFrame) -> DataFrame:
    """All properties, with annual and monthly flags from the dominant frequency."""
    near = lambda target: F.abs(F.col("dominant_frequency") - target) < 0.1
    return shape_properties(comp).join(spectra(comp), CKEYS).withColumns({
        "annual": near(1 / 365), "monthly": near(1 / 30)})


# Weights of the sixteen scores.
SCORE_WEIGHTS = {
    "annual": 0.20, "monthly": 0.12, "weekly": 0.04, "trend": 0.12, "long_term": 0.08, "decadal": 0.04,
    "quadratic": 0.04, "consistency": 0.04, "seasonal_trend": 0.04, "cyclical": 0.04, "extreme": 0.04,
    "stability": 0.08, "autocorrelation": 0.04, "noise": 0.02, "frequency": 0.02, "predictability": 0.04,
}


def score_inputs(comp: DataFrame) -> DataFrame:
    """Everything the composite score reads, one row per component."""
    parts = [
        component_properties(comp).drop("annual", "monthly", "n"),
        periodicity(comp).select(*CKEYS, "annual", "monthly", "weekly"),
        component_trend(comp).select(*CKEYS, "trend", "quadratic", "consistency"),
        extreme_events(comp).select(*CKEYS, "heat", "cold"),
        climate_trends(comp).select(*CKEYS, "long_term", "decadal", "seasonal_trend"),
        cyclical_strength(comp).select(*CKEYS, "cyclical"),
        variance_explained(comp).select(*CKEYS, "explained_ratio"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, CKEYS, "left")
    return out.na.fill(0.0, ["annual", "monthly", "weekly"])


def seasonal_model_score(inputs: DataFrame) -> DataFrame:
    """Weighted sum of the normalised scores; higher suits the seasonal model better."""
    one = F.lit(1.0)
    cap = lambda c, scale: F.least(F.col(c) / scale, one)
    f = F.col("dominant_frequency")
    scores = {
        "annual": F.col("annual"), "monthly": F.col("monthly"), "weekly": F.col("weekly") * 0.5,
        "trend": cap("trend", 0.1), "long_term": cap("long_term", 0.1), "decadal": cap("decadal", 0.1),
        "quadratic": cap("quadratic", 0.1), "consistency": F.col("consistency"),
        "seasonal_trend": cap("seasonal_trend", 0.1), "cyclical": cap("cyclical", 0.5),
        "extreme": F.greatest("heat", "cold"), "stability": F.col("stability"),
        "autocorrelation": F.least(F.col("autocorrelation") * 2, one),
        "noise": 1 - F.least(F.col("noise_level") * 2, one),
        "frequency": F.when(f < 0.001, 1.0).when(f < 0.01, 0.9).when(f < 0.05, 0.6).otherwise(0.2),
        "predictability": F.least(F.col("explained_ratio") * 2, one),
    }
    total = sum((scores[k] * w for k, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    return inputs.withColumn("score", total)


def classify_components(scored: DataFrame) -> DataFrame:
    """The best score takes the seasonal model (exactly one per station); the others by their properties."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.round("score", 9).desc(), "component"))
    corr, noise = F.abs("correlation"), F.col("noise_level")
    lag = (F.col("complexity") > 0.08) & (F.col("dominant_frequency") > 0.005) & (corr > 0.05) & (noise < 0.8)
    junk = (noise > 0.7) | (corr < 0.02) | (F.col("variance") < 0.0001)
    simple = (F.col("complexity") < 0.05) & (F.col("stability") > 0.6) & (corr > 0.02)
    return scored.withColumn("rank", rank).withColumn(
        "model_class",
        F.when(F.col("rank") == 1, "seasonal").when(lag, "lag").when(junk, "noise").when(simple, "extrapolation")
        .otherwise("lag"))


def filter_components(comp: DataFrame) -> DataFrame:
    """Components kept: share of at least 0.5% and quality of at least 0.3; never fewer than the first three."""
    s = variance_explained(comp).select(*CKEYS, "explained_ratio").join(
        component_quality(comp).select(*CKEYS, "quality"), CKEYS)
    good = (F.col("explained_ratio") >= 0.005) & (F.col("quality") >= 0.3)
    w = Window.partitionBy(*KEYS)
    s = s.withColumns({"total": F.count(F.lit(1)).over(w), "n_good": F.sum(flag(good)).over(w)})
    keep = F.when(F.col("total") <= 3, True).when(F.col("n_good") < 3, F.col("component") <= 3).otherwise(good)
    return s.withColumn("kept", keep).drop("total", "n_good")


def reconstruction_error(comp: DataFrame) -> DataFrame:
    """Series minus sum of components: squared and absolute error, and correlation."""
    back = comp.groupBy(*KEYS, "date").agg(
        F.first("series_value").alias("series_value"), F.sum("value").alias("rebuilt"))
    d = F.col("series_value") - F.col("rebuilt")
    return back.groupBy(*KEYS).agg(
        F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"),
        pearson(F.col("series_value"), F.col("rebuilt")).alias("reconstruction_correlation"),
        F.count(F.lit(1)).alias("n"))


def decomposition_quality(comp: DataFrame) -> DataFrame:
    """Station-level quality and its composite (lower is better)."""
    var = variance_explained(comp).groupBy(*KEYS).agg(
        F.sum(F.when(F.col("component") <= 3, F.col("explained_ratio"))).alias("top3_variance"),
        F.sum(F.when(F.col("component") <= 5, F.col("explained_ratio"))).alias("top5_variance"))
    corr = component_correlation(comp).groupBy(*KEYS).agg(
        F.max(F.abs("correlation")).alias("max_correlation"), F.avg(F.abs("correlation")).alias("mean_correlation"))
    quality = component_quality(comp).groupBy(*KEYS).agg(F.avg("quality").alias("mean_quality"))
    season = periodicity(comp).groupBy(*KEYS).agg(F.max("annual").alias("seasonality"))
    recon = reconstruction_error(comp).select(
        *KEYS, F.col("mae").alias("reconstruction_error"), "reconstruction_correlation")
    out = orthogonality(comp)
    for part in (var, corr, quality, season, recon):
        out = out.join(part, KEYS)
    return out.withColumn(
        "composite",
        F.col("orthogonality") * 0.25 + (1 - F.col("top3_variance")) * 0.20 + F.col("reconstruction_error") * 0.15
        + (1 - F.col("mean_quality")) * 0.15 + (1 - F.col("reconstruction_correlation")) * 0.15
        + (1 - F.col("seasonality")) * 0.10)


def decomposition_acceptance(quality: DataFrame) -> DataFrame:
    """At least four of six checks."""
    checks = (
        flag(F.col("orthogonality") <= 0.1) + flag(F.col("top3_variance") >= 0.3)
        + flag(F.col("reconstruction_error") <= 1.0) + flag(F.col("reconstruction_correlation") >= 0.8)
        + flag(F.col("mean_quality") >= 0.5) + flag(F.col("seasonality") >= 0.1))
    return quality.select(*KEYS, checks.alias("checks_passed"), (checks >= 4).alias("accepted"))


def _finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))


def model_input_checks(comp: DataFrame) -> DataFrame:
    """Errors and warnings per component before a model is fitted."""
    rows = _with_lags(comp.withColumn("bad", F.abs("value") == float("inf")).withColumn("value", _finite("value")), [1])
    q = series_quantiles(rows, CKEYS, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)
    s = rows.join(q, CKEYS).groupBy(*CKEYS).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("value").isNull() & ~F.coalesce("bad", F.lit(False)), 1.0).otherwise(0.0)).alias("missing_ratio"),
        count_where(F.col("bad")).alias("infinite"), F.var_pop("value").alias("variance"),
        F.avg(F.when(out & (iqr > 0), 1.0).otherwise(0.0)).alias("outlier_ratio"),
        F.coalesce(pearson(F.col("value"), F.col("lag_1")), F.lit(0.0)).alias("autocorrelation"))
    errors = messages((F.col("n") < 365, "insufficient_data"), (F.col("infinite") > 0, "infinite_values"))
    warnings = messages(
        (F.col("missing_ratio") > 0.1, "high_missing"), (F.col("variance") < 1e-6, "low_variance"),
        (F.col("outlier_ratio") > 0.05, "high_outliers"),
        ((F.col("n") > 10) & (F.abs("autocorrelation") < 0.1), "low_autocorrelation"))
    advice = messages((warnings != "", "preprocess"), (F.col("missing_ratio") > 0.05, "impute"))
    return s.withColumns({"errors": errors, "warnings": warnings, "recommendations": advice,
                          "is_valid": errors == ""})


def model_eligibility(checks: DataFrame, forced: Column) -> DataFrame:
    """Forced component passes; else enough rows, one of the first three, variance, no gaps, some autocorrelation."""
    ok = (
        (F.col("n") >= 365) & (F.col("component") <= 3) & (F.col("variance") >= 0.001)
        & (F.col("missing_ratio") == 0) & (F.col("infinite") == 0) & (F.abs("autocorrelation") >= 0.1))
    return checks.select(*CKEYS, (F.coalesce(forced, F.lit(False)) | ok).alias("eligible"))


def scaling_choice(props: DataFrame, model: Column) -> DataFrame:
    """None for the seasonal model; for others robust when complex, min-max when flat, else standard."""
    return props.withColumn(
        "scaling",
        F.when(model == "seasonal", "none").when(model != "lag", "standard")
        .when(F.col("complexity") > 0.3, "robust").when(F.col("variance") < 0.1, "minmax").otherwise("standard"))


def scale_consistency(comp: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Per component: other components of the station whose spread differs by more than the tolerance."""
    s = comp.groupBy(*CKEYS).agg(F.stddev_pop("value").alias("std"), F.avg("value").alias("mean"))
    other = s.select(*KEYS, F.col("component").alias("other"), F.col("std").alias("other_std"))
    apart = F.abs(F.col("std") - F.col("other_std")) / F.greatest(F.col("std"), F.lit(1e-8)) > tolerance
    # a handful of components per station on both sides
    return s.join(other, KEYS).filter(F.col("component") != F.col("other")).groupBy(*CKEYS, "mean", "std").agg(
        count_where(apart).alias("inconsistent_with")).withColumn("consistent", F.col("inconsistent_with") == 0)
