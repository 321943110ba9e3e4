"""Per-component models fitted from sums: weighted ridge on lags, and a seasonal AR(1).

Fitting is one aggregation of products per (station, component). What remains is a small
system of equations per row, solved in Arrow batches; no series is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.expr import div
from almanac.operators.reshape import tail_rows
from almanac.plans import blocks

KEYS = ["station_code", "station"]
CKEYS = [*KEYS, "component"]

# Lags, training share, recency decay and blend, rows for the seasonal model.
N_LAGS = 7
TRAIN_SHARE = 0.8
DECAY = 0.1
STRENGTH = 0.5
SEASONAL_ROWS = 365
GRID = (0.1, 1.0, 10.0)


def lag_design(comp: DataFrame, lags: int = N_LAGS, keys: list[str] = CKEYS) -> DataFrame:
    """Rows with all lags: array ``x`` of the lags (newest first), their mean and std, target ``y``, part and weight.

    All inputs lie strictly before the target. Weights fall with age and are blended with
    uniform ones.
    """
    def frames(w):
        before = w.rowsBetween(-lags, -1)
        return {
            **{f"lag_{k}": F.lag("value", k).over(w) for k in range(1, lags + 1)},
            "lag_mean": F.avg("value").over(before), "lag_std": F.stddev_pop("value").over(before),
        }
    rows = blocks.framed(comp, keys, frames, before=lags).filter(F.col(f"lag_{lags}").isNotNull())
    n = comp.groupBy(*keys).agg((F.max("pos") - lags).alias("n"), F.avg("value").alias("centre"))
    idx = F.col("pos") - lags
    raw = F.exp(-DECAY * (F.col("n") - idx))
    # mean of exp(-a * age) over ages 0..n-1 in closed form
    mean_raw = (1 - F.exp(-DECAY * F.col("n"))) / (F.lit(1.0) - F.exp(F.lit(-DECAY))) / F.col("n")
    return rows.join(n, keys).select(
        *keys, "date", "pos", F.array(*[F.col(f"lag_{k}") for k in range(1, lags + 1)], "lag_mean", "lag_std").alias("x"),
        F.col("value").alias("y"),
        F.when(idx <= F.floor(F.col("n") * TRAIN_SHARE + 1e-9), "train").otherwise("test").alias("part"),
        ((1 - STRENGTH) + STRENGTH * raw / mean_raw).alias("weight"), "centre")


def _gram(part: str, width: int, levels: int) -> Column:
    """Weighted sums of products of (1, x, y) over one part, as one flat array (upper triangle).

    The first ``levels`` inputs and y are levels of the series: its mean, ``centre``, is taken off, so that sums of
    squares aren't differences of large numbers.
    """
    mine = F.col("part") == part
    v = [F.lit(1.0), *[F.col("x")[i] - F.col("centre") if i < levels else F.col("x")[i] for i in range(width)], F.col("y") - F.col("centre")]
    w = F.when(mine, F.col("weight") if part == "train" else F.lit(1.0))
    return F.array(*[F.coalesce(F.sum(w * v[i] * v[j]), F.lit(0.0)) for i in range(len(v)) for j in range(i, len(v))])


def _unpack(flat, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = np.asarray(flat, dtype=float)
    return m + np.triu(m, 1).T


def ridge_from_sums(m: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and slopes in raw units; the penalty acts on standardised inputs."""
    total = m[0, 0]
    mean = m[0, 1:-1] / total
    xx = m[1:-1, 1:-1] / total - np.outer(mean, mean)
    xy = m[1:-1, -1] / total - mean * m[0, -1] / total
    sd = np.sqrt(np.maximum(np.diag(xx), 0.0))
    sd[sd < 1e-12] = 1.0
    z = xx / np.outer(sd, sd) + np.eye(len(sd)) * alpha / total
    slopes = np.linalg.solve(z, xy / sd) / sd
    return np.concatenate([[m[0, -1] / total - mean @ slopes], slopes])


def mean_square(m: np.ndarray, beta: np.ndarray) -> float:
    """Mean squared error of a model on the rows behind a product matrix."""
    if m[0, 0] <= 0:
        return float("nan")
    a, b = m[:-1, :-1], m[:-1, -1]
    return float(max(m[-1, -1] - 2 * beta @ b + beta @ a @ beta, 0.0) / m[0, 0])


def lag_sums(comp: DataFrame, keys: list[str] = CKEYS) -> DataFrame:
    """Product sums of the training and the hold-out rows, one row per component."""
    width = N_LAGS + 2
    return lag_design(comp, keys=keys).groupBy(*keys).agg(
        _gram("train", width, N_LAGS + 1).alias("train"), _gram("test", width, N_LAGS + 1).alias("test"),
        F.count(F.lit(1)).alias("n"), F.first("centre").alias("centre"))


def _solve(sums: DataFrame, alphas: list[float], keys: list[str]) -> DataFrame:
    size = N_LAGS + 4
    kinds = dict(sums.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                train, test = _unpack(row.train, size), _unpack(row.test, size)
                if train[0, 0] <= 0:
                    continue
                scale = getattr(row, "alpha_scale", 1.0)
                for a in alphas:
                    beta = ridge_from_sums(train, a * scale)
                    errors = mean_square(train, beta), mean_square(test, beta)
                    beta[0] += row.centre * (1 - beta[1:N_LAGS + 2].sum())  # back to levels
                    out.append((*[getattr(row, k) for k in keys], a * scale, beta.tolist(), *errors))
            yield pd.DataFrame(out, columns=[*keys, "alpha", "coefficients", "train_mse", "test_mse"])

    return sums.mapInPandas(run, f"{head}, alpha double, coefficients array<double>, train_mse double, test_mse double")


def lag_model_fit(comp: DataFrame, alpha: float = 1.0, keys: list[str] = CKEYS) -> DataFrame:
    return _solve(lag_sums(comp, keys), [alpha], keys)


def lag_model_grid(comp: DataFrame, props: DataFrame | None = None, keys: list[str] = CKEYS) -> DataFrame:
    """Best penalty of the grid by hold-out error, all from the same sums.

    With ``props`` the grid is shifted for fast and for strongly varying components.
    """
    sums = lag_sums(comp, keys)
    if props is not None:
        fast = F.when(F.col("dominant_frequency") > 0.01, 2.0).otherwise(1.0)
        strong = F.when(F.col("variance") > 0.1, 1 / 0.7).otherwise(1.0)
        sums = sums.join(props.select(*keys, (fast * strong).alias("alpha_scale")), keys)
    tried = _solve(sums, list(GRID), keys)
    pick = F.struct(F.coalesce("test_mse", F.lit(float("inf"))), "alpha")
    return tried.groupBy(*keys).agg(
        *[F.min_by(c, pick).alias(c) for c in ("alpha", "coefficients", "train_mse", "test_mse")],
        F.count(F.lit(1)).alias("tried"))


def predict_rows(design: DataFrame, models: DataFrame, keys: list[str] = CKEYS) -> DataFrame:
    """Model value for each design row."""
    terms = F.zip_with(F.concat(F.array(F.lit(1.0)), F.col("x")), F.col("coefficients"), lambda a, b: a * b)
    return design.join(models.select(*keys, "coefficients"), keys).withColumn(
        "predicted", F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)).drop("coefficients")


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: list[str]) -> DataFrame:
    """MSE, RMSE, MAE, R2 and MAPE per key."""
    e = F.col(actual) - F.col(predicted)
    share = F.abs(e) / F.greatest(F.abs(actual), F.lit(1e-8))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), F.var_pop(actual))).alias("r2"),
        (F.avg(share) * 100).alias("mape"))


def day_means(comp: DataFrame, keys: list[str] = CKEYS) -> DataFrame:
    """Day-of-year mean around the component's mean."""
    by_day = comp.groupBy(*keys, F.dayofyear("date").alias("doy")).agg(
        F.sum("value").alias("t"), F.count("value").alias("c"))
    w = Window.partitionBy(*keys)  # at most 366 rows
    mean = F.sum("t").over(w) / F.sum("c").over(w)
    return by_day.select(*keys, "doy", (F.col("t") / F.col("c") - mean).alias("seasonal"))


def seasonal_ar_fit(comp: DataFrame, rows: int = SEASONAL_ROWS, keys: list[str] = CKEYS) -> tuple[DataFrame, DataFrame]:
    """AR(1) on the differences of the deseasonalised last rows, and the day-of-year means."""
    season = day_means(comp, keys)
    recent = tail_rows(comp, rows + 2, keys).withColumn("doy", F.dayofyear("date")).join(season, [*keys, "doy"])
    w = Window.partitionBy(*keys).orderBy("pos")  # a year of rows
    level = recent.withColumn("x", F.col("value") - F.col("seasonal"))
    diff = level.withColumn("d", F.col("x") - F.lag("x").over(w))
    pairs = diff.withColumn("d_prev", F.lag("d").over(w)).filter(F.col("age") <= rows)
    fit = pairs.groupBy(*keys).agg(
        F.regr_slope("d", "d_prev").alias("slope"), F.count("d_prev").alias("n"),
        F.max_by("x", "pos").alias("last_level"), F.max_by("d", "pos").alias("last_diff"),
        F.max("date").alias("last_date"))
    phi = F.least(F.greatest(F.coalesce("slope", F.lit(0.0)), F.lit(-0.99)), F.lit(0.99))
    return fit.select(*keys, "n", phi.alias("phi"), "last_level", "last_diff", "last_date"), season


def order_selection(comp: DataFrame, max_order: int = 3, keys: list[str] = CKEYS) -> DataFrame:
    """Order p in 0..3 with the smallest AIC, from one set of product sums."""
    rows = blocks.framed(
        comp, keys, lambda w: {f"lag_{k}": F.lag("value", k).over(w) for k in range(1, max_order + 1)},
        before=max_order).filter(F.col(f"lag_{max_order}").isNotNull())
    centre = comp.groupBy(*keys).agg(F.avg("value").alias("centre"))
    design = rows.join(centre, keys).select(*keys, F.array(*[F.col(f"lag_{k}") for k in range(1, max_order + 1)]).alias("x"),
                         F.col("value").alias("y"), F.lit("test").alias("part"), F.lit(1.0).alias("weight"), "centre")
    sums = design.groupBy(*keys).agg(_gram("test", max_order, max_order).alias("sums"))
    kinds = dict(sums.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                m = _unpack(row.sums, max_order + 2)
                n = m[0, 0]
                for p in range(max_order + 1):
                    pick = [*range(p + 1), max_order + 1]
                    sub = m[np.ix_(pick, pick)]
                    beta = np.linalg.lstsq(sub[:-1, :-1], sub[:-1, -1], rcond=None)[0]
                    mse = max(mean_square(sub, beta), 1e-300)
                    out.append((*[getattr(row, k) for k in keys], p, n * np.log(mse) + 2 * (p + 1)))
            yield pd.DataFrame(out, columns=[*keys, "p", "aic"])

    tried = sums.mapInPandas(run, f"{head}, p int, aic double")
    return tried.groupBy(*keys).agg(F.min_by("p", F.struct("aic", "p")).alias("p"), F.min("aic").alias("aic"))
