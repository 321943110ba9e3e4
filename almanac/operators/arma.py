"""Orders of autoregressive moving-average models by two regressions (Hannan and Rissanen).

A long autoregression, solved from lag products alone, gives every row a residual. Regressions of
the value on lagged values and lagged residuals follow for all orders from one set of centred
product sums. Both scans work on blocks of rows; what is left per series is a few numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.plans import blocks
from almanac.plans.lineage import cut

KEYS = ["station_code", "station"]
LONG = 20
"""Order of the long autoregression."""
MAX_P = MAX_Q = 3


def centred(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, pos, value) with each series' mean taken off."""
    mean = df.groupBy(*keys).agg(F.avg("value").alias("mean"))
    return df.select(*keys, "pos", "value").join(mean, keys).select(*keys, "pos", (F.col("value") - F.col("mean")).alias("value"))


def lag_products(rows: DataFrame, lags: int = LONG, keys: list[str] = KEYS) -> DataFrame:
    """(keys, n, g): mean products of centred values 0 to ``lags`` rows apart, each divided by all n rows.

    ``rows`` are complete series (:func:`centred`); pairs beyond the ends count as zero, which keeps the
    recursion stable.
    """
    framed = blocks.framed(rows, keys, lambda w: {f"lag_{k}": F.lag("value", k).over(w) for k in range(1, lags + 1)}, before=lags)
    v = F.col("value")
    products = F.array(F.avg(v * v), *[F.sum(v * F.coalesce(f"lag_{k}", F.lit(0.0))) / F.count(v) for k in range(1, lags + 1)])
    return framed.groupBy(*keys).agg(F.count(v).alias("n"), products.alias("g"))


def levinson(g: np.ndarray) -> np.ndarray:
    """Coefficients of the autoregression with the given lag products, one row per series."""
    rows, width = g.shape
    a, error = np.zeros((rows, width - 1)), g[:, 0].copy()
    for m in range(width - 1):
        known = (a[:, :m] * g[:, m:0:-1]).sum(axis=1) if m else 0.0
        k = np.where(error > 1e-12 * g[:, 0], (g[:, m + 1] - known) / np.where(error > 0, error, 1.0), 0.0)
        a[:, :m] -= k[:, None] * a[:, :m][:, ::-1]
        a[:, m] = k
        error = error * (1 - k * k)
    return a


def long_coefficients(products: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, long): the long autoregression of every series of :func:`lag_products`."""
    kinds = dict(products.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[keys].assign(long=list(levinson(np.stack(pdf["g"].to_numpy()))))
    return products.mapInPandas(run, f"{head}, long array<double>")


def _residuals(rows: DataFrame, long: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with all lags of the long autoregression, with ``error``: the value less what it foretells."""
    lags = [f"lag_{k}" for k in range(1, LONG + 1)]
    framed = blocks.framed(rows, keys, lambda w: {c: F.lag("value", k).over(w) for k, c in enumerate(lags, start=1)}, before=LONG)
    known = framed.where(F.col(lags[-1]).isNotNull()).join(long, keys)
    foretold = sum((F.col("long")[i] * F.col(c) for i, c in enumerate(lags)), F.lit(0.0))
    return known.select(*keys, "pos", "value", (F.col("value") - foretold).alias("error"))


def regression_sums(rows: DataFrame, long: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, n, sums): products of three lagged values, three lagged residuals and the value itself, upper triangle."""
    errors = _residuals(rows, long, keys)
    names = [f"x{k}" for k in range(1, MAX_P + 1)] + [f"e{k}" for k in range(1, MAX_Q + 1)]
    framed = blocks.framed(errors, keys, lambda w: {
        **{f"x{k}": F.lag("value", k).over(w) for k in range(1, MAX_P + 1)},
        **{f"e{k}": F.lag("error", k).over(w) for k in range(1, MAX_Q + 1)}}, before=max(MAX_P, MAX_Q))
    whole = framed.where(F.col(f"x{MAX_P}").isNotNull() & F.col(f"e{MAX_Q}").isNotNull())
    v = [F.col(c) for c in [*names, "value"]]
    sums = F.array(*[F.sum(v[i] * v[j]) for i in range(len(v)) for j in range(i, len(v))])
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sums.alias("sums"))


def _orders(n: float, flat: np.ndarray) -> list[tuple]:
    """(p, q, sigma2, aic, bic, ar, ma) of all orders, by eliminating the regressors of each."""
    size = MAX_P + MAX_Q + 1
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = flat
    m += np.triu(m, 1).T
    out = []
    for p in range(MAX_P + 1):
        for q in range(MAX_Q + 1):
            pick = [*range(p), *range(MAX_P, MAX_P + q)]
            b = m[pick, -1]
            beta = np.linalg.lstsq(m[np.ix_(pick, pick)], b, rcond=1e-13)[0] if pick else np.zeros(0)
            sigma2 = max((m[-1, -1] - beta @ b) / n, 1e-12 * m[-1, -1] / n, 1e-300)
            out.append((p, q, sigma2, n * math.log(sigma2) + 2 * (p + q + 1), n * math.log(sigma2) + math.log(n) * (p + q + 1),
                        beta[:p].tolist(), beta[p:].tolist()))
    return out


def arma_orders(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, n, p, q, sigma2, aic, bic, ar, ma) for p and q from 0 to 3: 16 rows per series.

    ``df`` has complete series (keys, pos, value). All orders are compared on the same rows: those behind
    the long autoregression's and the regressions' lags. Series too short for any such row give none.
    """
    rows = cut(centred(df, keys))
    long = cut(long_coefficients(lag_products(rows, LONG, keys), keys))
    sums = regression_sums(rows, long, keys)
    kinds = dict(sums.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*[getattr(row, k) for k in keys], row.n, *order) for row in pdf.itertuples(index=False)
                   for order in _orders(row.n, np.asarray(row.sums, float))]
            yield pd.DataFrame(out, columns=[*keys, "n", "p", "q", "sigma2", "aic", "bic", "ar", "ma"])

    return sums.mapInPandas(run, f"{head}, n long, p int, q int, sigma2 double, aic double, bic double, ar array<double>, ma array<double>")


def arma_order_selection(df: DataFrame, criterion: str = "bic", keys: list[str] = KEYS) -> DataFrame:
    """The order with the smallest criterion of every series, the smaller p then q on a tie, and ``tried``."""
    tried = arma_orders(df, keys)
    pick = F.struct(criterion, "p", "q")
    columns = ["p", "q", "sigma2", "aic", "bic", "ar", "ma"]
    return tried.groupBy(*keys).agg(*[F.min_by(c, pick).alias(c) for c in columns], F.max("n").alias("n"), F.count(F.lit(1)).alias("tried"))
