"""A first-order process seen through noise: likelihood, filter and smoother as associative scans.

    x[t] = phi * x[t - 1] + w[t],   y[t] = x[t] + v[t],   var(w) = sigma2,   var(v) = ratio * sigma2

Days without a value are gaps the process runs through. A block of days is one element, however
long the series; elements are combined as a tree (:mod:`almanac.plans.scans`), then each block is
run from what came before it, and for the smoother back from what comes after. No task holds a series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.operators.impute import PERIOD, seasonal_decompose
from almanac.plans import blocks, scans
from almanac.plans.lineage import cut

KEYS = ["station_code", "station"]
LIMIT = 0.999
"""Largest absolute phi that the search tries."""
RATIOS = (0.0, 0.05, 0.2, 0.5, 1.0, 2.0, 5.0, 20.0)
LEAST = 0.05
"""Noise ratios below this are searched in even steps, larger ones in even factors."""
TRIES = 17
ROUNDS = 4


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The element of ``a`` followed by ``b``; the last axis is (A, b, C, eta, J, logs, squares).

    Given the state x before an element, the state after it is normal with mean A x + b and variance
    C, and the values inside have log density logs + squares + eta x - J x^2 / 2 (up to constants).
    """
    a1, b1, c1, n1, j1, l1, s1 = np.moveaxis(a, -1, 0)
    a2, b2, c2, n2, j2, l2, s2 = np.moveaxis(b, -1, 0)
    d = 1 + c1 * j2
    return np.stack([
        a2 * a1 / d, a2 * (b1 + c1 * n2) / d + b2, a2 * a2 * c1 / d + c2,
        a1 * (n2 - j2 * b1) / d + n1, a1 * a1 * j2 / d + j1,
        l1 + l2 - np.log(d) / 2, s1 + s2 + (c1 * n2 * n2 / 2 + n2 * b1 - j2 * b1 * b1 / 2) / d], axis=-1)


def combine_back(after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The element of ``before`` led on by ``after``; the last axis is (E, g, L): given the state x after it, mean E x + g, variance L."""
    e2, g2, l2 = np.moveaxis(after, -1, 0)
    e1, g1, l1 = np.moveaxis(before, -1, 0)
    return np.stack([e1 * e2, e1 * g2 + g1, e1 * e1 * l2 + l1], axis=-1)


def steps(y: np.ndarray, phi: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Elements of single days, by day and parameter pair, for sigma2 = 1; nan is a day without a value."""
    y, phi, ratio = y[:, None], phi[None, :], ratio[None, :]
    seen = np.isfinite(y)
    v = np.where(seen, y, 0.0)
    f = 1 + ratio
    gain = np.where(seen, 1 / f, 0.0)
    zero = np.zeros(np.broadcast_shapes(y.shape, phi.shape))
    return np.stack([
        (1 - gain) * phi + zero, gain * v + zero, 1 - gain + zero, np.where(seen, phi * v / f, 0.0) + zero,
        np.where(seen, phi * phi / f, 0.0) + zero, np.where(seen, -np.log(f) / 2, 0.0) + zero, np.where(seen, -v * v / f / 2, 0.0) + zero], axis=-1)


def _product(e: np.ndarray) -> np.ndarray:
    """Elements combined along the first axis."""
    while len(e) > 1:
        tail = e[len(e) - len(e) % 2:]
        e = np.concatenate([combine(e[0:len(e) - len(tail):2], e[1:len(e) - len(tail):2]), tail])
    return e[0]


def _running(e: np.ndarray) -> np.ndarray:
    """Products of all elements up to each one, along the first axis."""
    return scans.segment_scan(e, np.zeros(1, int), combine)


def day_blocks(df: DataFrame, keys: list[str] = KEYS, size: int = 0) -> DataFrame:
    """(keys, block, start, y): blocks of ``pos`` with an array of all days, null where there is no value.

    ``df`` must have a row for every position (a calendar).
    """
    size = size or blocks.BLOCK
    dealt = df.select(*keys, "pos", F.col("value").cast("double").alias("v")).withColumn("block", F.floor((F.col("pos") - 1) / size))
    grouped = dealt.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("rows"))
    return grouped.select(*keys, "block", F.col("rows.pos")[0].alias("start"), F.col("rows.v").alias("y"))


def _floats(y) -> np.ndarray:
    return np.array(y, dtype=float)


def _block_elements(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, e) of block rows that carry arrays ``phi`` and ``ratio``: one element per pair, flat."""
    kinds = dict(rows.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [_product(steps(_floats(y), np.asarray(p, float), np.asarray(r, float))).ravel()
                   for y, p, r in zip(pdf["y"], pdf["phi"], pdf["ratio"])]
            yield pdf[[*keys, "block"]].assign(e=out)
    return rows.select(*keys, "block", "y", "phi", "ratio").mapInPandas(run, f"{head}, block long, e array<double>")


def _combine_flat(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    shape = (*a.shape[:-1], -1, 7)
    return combine(a.reshape(shape), b.reshape(shape)).reshape(a.shape)


def _likelihood(e: np.ndarray, n: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sigma2, log likelihood at it) of whole series, whose state before the first day is in equilibrium."""
    eta, j, logs, squares = np.moveaxis(e[..., 3:], -1, 0)
    p0 = 1 / (1 - phi * phi)
    d = 1 + p0 * j
    logs, squares = logs - np.log(d) / 2, squares + p0 * eta * eta / d / 2
    sigma2 = np.maximum(-2 * squares / n, 1e-300)
    return sigma2, logs - n / 2 * (np.log(2 * np.pi * sigma2) + 1)


def log_likelihoods(days: DataFrame, params: DataFrame, keys: list[str] = KEYS, fan: int = scans.FAN) -> DataFrame:
    """(keys, phi, ratio, sigma2, log_likelihood): arrays over the pairs that ``params`` (keys, phi, ratio arrays) asks for.

    All pairs come from one scan of ``days`` (:func:`day_blocks`). ``sigma2`` is the best one for its pair.
    """
    known = days.groupBy(*keys).agg(F.sum(F.size(F.filter("y", lambda v: v.isNotNull()))).alias("n"))
    rows = days.join(params.select(*keys, "phi", "ratio"), keys)
    total = scans.totals(_block_elements(rows, keys), keys, _combine_flat, fan)
    kinds = dict(days.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_likelihood(np.reshape(e, (-1, 7)), max(n, 1), np.asarray(p, float)) for e, n, p in zip(pdf["e"], pdf["n"], pdf["phi"])]
            yield pdf[[*keys, "n", "phi", "ratio"]].assign(sigma2=[s for s, _ in found], log_likelihood=[v for _, v in found])
    return total.join(params.select(*keys, "phi", "ratio"), keys).join(known, keys).mapInPandas(
        run, f"{head}, n long, phi array<double>, ratio array<double>, sigma2 array<double>, log_likelihood array<double>")


def likelihood_fit(days: DataFrame, noisy: bool = True, keys: list[str] = KEYS, fan: int = scans.FAN) -> DataFrame:
    """(keys, n, phi, ratio, sigma2, log_likelihood) of the largest likelihood, by a bounded search.

    ``TRIES`` values of phi between -``LIMIT`` and ``LIMIT`` meet ``RATIOS`` of noise (0 alone, unless ``noisy``); each of
    ``ROUNDS`` further rounds tries as many around the best pair, an eighth (noise: a third) as far apart. Every round scans
    ``days`` once. A series without a value gets phi 0, ratio 0 and null sigma2.
    """
    series = cut(days.select(*keys).distinct())
    # Steps are even on atanh(phi / LIMIT) and on log(ratio + LEAST), so that they stay inside and reach zero noise.
    wide = np.linspace(-3.8, 3.8, TRIES)
    ratios = RATIOS if noisy else (0.0,)
    pairs = [(LIMIT * np.tanh(a), r) for a in wide for r in ratios]
    asked = series.select(*keys, F.array(*[F.lit(float(p)) for p, _ in pairs]).alias("phi"), F.array(*[F.lit(float(r)) for _, r in pairs]).alias("ratio"))
    best = None
    for turn in range(ROUNDS + 1):
        found = log_likelihoods(days, asked, keys, fan)
        if best is not None:
            found = found.unionByName(best)
        each = F.arrays_zip("log_likelihood", "phi", "ratio", "sigma2")
        top = found.select(*keys, "n", F.array_max(each).alias("top"))
        best = cut(top.groupBy(*keys).agg(F.max("n").alias("n"), F.max("top").alias("top")).select(
            *keys, "n", *[F.array(f"top.{c}").alias(c) for c in ("phi", "ratio", "sigma2", "log_likelihood")]))
        step, wider = 0.475 / 8 ** (turn + 1), 0.47 / 3 ** turn
        centre = F.atanh(F.col("phi")[0] / LIMIT)
        shifts = F.array(*[F.lit(step * i) for i in range(-8, 9)])
        grown = F.array(*[F.lit(float(np.exp(wider * i))) for i in range(-3, 4)]) if noisy else F.array(F.lit(1.0))
        noise = lambda g: F.greatest((F.col("ratio")[0] + LEAST) * g - LEAST, F.lit(0.0))
        near = F.flatten(F.transform(shifts, lambda s: F.transform(grown, lambda g: F.struct(
            (LIMIT * F.tanh(F.least(F.greatest(centre + s, F.lit(-3.8)), F.lit(3.8)))).alias("phi"), noise(g).alias("ratio")))))
        asked = best.select(*keys, near.alias("near")).select(*keys, "near.phi", "near.ratio")
    one = best.select(*keys, "n", *[F.col(c)[0].alias(c) for c in ("phi", "ratio", "sigma2", "log_likelihood")])
    some = F.col("n") > 0
    return one.select(*keys, "n", *[F.when(some, F.col(c)).otherwise(0.0).alias(c) for c in ("phi", "ratio")],
                      *[F.when(some, F.col(c)).alias(c) for c in ("sigma2", "log_likelihood")])


def _filtered_blocks(days: DataFrame, params: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """Block rows with arrays ``m`` and ``p``: mean and variance (for sigma2 = 1) of every day's state given the days up to it."""
    rows = cut(days.join(params.select(*keys, "phi", "ratio"), keys))
    single = rows.select(*keys, "block", "y", F.array("phi").alias("phi"), F.array("ratio").alias("ratio"))
    elements = cut(_block_elements(single, keys))
    nothing = np.array([1.0, 0, 0, 0, 0, 0, 0])
    before = scans.before_blocks(elements, keys, combine, nothing, fan)

    @F.pandas_udf(T.StructType([T.StructField("m", T.ArrayType(T.DoubleType())), T.StructField("p", T.ArrayType(T.DoubleType()))]))
    def run(y: pd.Series, phi: pd.Series, ratio: pd.Series, e: pd.Series) -> pd.DataFrame:
        out = {"m": [], "p": []}
        for values, a, r, earlier in zip(y, phi, ratio, e):
            start = np.array([0.0, 0.0, 1 / (1 - a * a), 0, 0, 0, 0])
            first = combine(start, np.asarray(earlier, float))
            state = combine(first[None, :], _running(steps(_floats(values), np.array([a]), np.array([r]))[:, 0]))
            out["m"].append(state[:, 1])
            out["p"].append(state[:, 2])
        return pd.DataFrame(out)

    return rows.join(before, [*keys, "block"]).withColumn("f", run("y", "phi", "ratio", "e")).select(
        *keys, "block", "start", "y", "phi", "ratio", F.col("f.m").alias("m"), F.col("f.p").alias("p"))


def _long(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return rows.select(*keys, "start", F.posexplode(F.arrays_zip(*names)).alias("at", "e")).select(
        *keys, (F.col("start") + F.col("at")).alias("pos"), *[F.col(f"e.{n}").alias(n) for n in names])


def filtered(days: DataFrame, params: DataFrame, keys: list[str] = KEYS, fan: int = scans.FAN) -> DataFrame:
    """(keys, pos, m, p): every day's state given the days up to it, for ``params`` (keys, phi, ratio); p in units of sigma2."""
    return _long(_filtered_blocks(days, params, keys, fan), keys, ["m", "p"])


def _back_steps(m: np.ndarray, p: np.ndarray, phi: float, last: bool) -> np.ndarray:
    """Elements of single days for the way back, last day first; the last day of a series stays as the filter has it."""
    e = p * phi / (phi * phi * p + 1)
    if last:
        e[-1] = 0.0
    return np.stack([e, m - e * phi * m, p - e * phi * p], axis=-1)[::-1]


def smoothed(days: DataFrame, params: DataFrame, keys: list[str] = KEYS, fan: int = scans.FAN) -> DataFrame:
    """(keys, pos, m, p): every day's state given all days, for ``params`` (keys, phi, ratio); p in units of sigma2."""
    rows = cut(_filtered_blocks(days, params, keys, fan))
    last = F.max("block").alias("last")
    kinds = dict(rows.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    # Blocks count backwards, so that what comes after a block is what the scan has done before it.
    backwards = rows.join(rows.groupBy(*keys).agg(last), keys).withColumn("block", F.col("last") - F.col("block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for m, p, phi, number in zip(pdf["m"], pdf["p"], pdf["phi"], pdf["block"]):
                e = _back_steps(np.asarray(m), np.asarray(p), phi, number == 0)
                out.append(scans.segment_fold(e, np.zeros(1, int), combine_back)[0])
            yield pdf[[*keys, "block"]].assign(e=out)

    elements = cut(backwards.select(*keys, "block", "m", "p", "phi").mapInPandas(run, f"{head}, block long, e array<double>"))
    after = scans.before_blocks(elements, keys, combine_back, np.array([1.0, 0.0, 0.0]), fan)

    @F.pandas_udf(T.StructType([T.StructField("m", T.ArrayType(T.DoubleType())), T.StructField("p", T.ArrayType(T.DoubleType()))]))
    def back(m: pd.Series, p: pd.Series, phi: pd.Series, e: pd.Series, block: pd.Series) -> pd.DataFrame:
        out = {"m": [], "p": []}
        for mean, var, a, later, number in zip(m, p, phi, e, block):
            own = _back_steps(np.asarray(mean), np.asarray(var), a, number == 0)
            found = scans.segment_scan(own, np.zeros(1, int), combine_back)
            found = combine_back(np.asarray(later, float)[None, :], found)
            out["m"].append(found[::-1, 1])
            out["p"].append(found[::-1, 2])
        return pd.DataFrame(out)

    joined = backwards.select(*keys, "block", "start", "m", "p", "phi").join(after, [*keys, "block"])
    return _long(joined.withColumn("s", back("m", "p", "phi", "e", "block")).select(
        *keys, "start", F.col("s.m").alias("m"), F.col("s.p").alias("p")), keys, ["m", "p"])


def deseasonalised(df: DataFrame, period: int = PERIOD, keys: list[str] = KEYS) -> DataFrame:
    """(keys, date, pos, value, seasonal, level, centre): ``level`` is the value less its day's seasonal part and the mean of the rest."""
    parts = seasonal_decompose(df, period, keys).select(*keys, "date", "pos", "value", "seasonal")
    centre = parts.groupBy(*keys).agg(F.avg(F.col("value") - F.col("seasonal")).alias("centre"))
    return parts.join(centre, keys).withColumn("level", F.col("value") - F.col("seasonal") - F.col("centre"))


def ar_likelihood(df: DataFrame, period: int = PERIOD, noisy: bool = True, keys: list[str] = KEYS) -> DataFrame:
    """:func:`likelihood_fit` of the deseasonalised series, gaps included."""
    level = deseasonalised(df, period, keys).select(*keys, "pos", F.col("level").alias("value"))
    return likelihood_fit(cut(day_blocks(level, keys)), noisy, keys)


def impute_smoothed(df: DataFrame, period: int = PERIOD, phi: float | None = None, keys: list[str] = KEYS, size: int = 0) -> DataFrame:
    """``df`` with gaps filled by season plus the smoothed deviation from it, ``imputed``, and ``spread``, its standard deviation.

    The deviation is a first-order process without noise, fitted by likelihood or with the given ``phi``, so a fill meets the known days
    on both sides of its gap and leans to the season in the middle of a long one; gaps at the ends
    leave the one known side the same way. A station without a value stays without.
    """
    parts = cut(deseasonalised(df, period, keys))
    days = cut(day_blocks(parts.select(*keys, "pos", F.col("level").alias("value")), keys, size))
    if phi is None:
        fit = cut(likelihood_fit(days, False, keys))
    else:
        given = days.select(*keys).distinct().select(*keys, F.array(F.lit(float(phi))).alias("phi"), F.array(F.lit(0.0)).alias("ratio"))
        fit = cut(log_likelihoods(days, given, keys).select(*keys, "n", *[F.col(c)[0].alias(c) for c in ("phi", "ratio", "sigma2")]))
    found = smoothed(days, fit, keys).join(fit.select(*keys, "sigma2", F.col("n").alias("known")), keys)
    own = F.when(F.col("known") > 0, F.col("seasonal") + F.col("centre") + F.col("m"))
    gap = F.col("value").isNull()
    return parts.join(found, [*keys, "pos"]).select(
        *keys, "date", "pos", F.coalesce("value", own).alias("value"), gap.alias("imputed"),
        F.when(gap & (F.col("known") > 0), F.sqrt(F.greatest(F.col("p") * F.col("sigma2"), F.lit(0.0)))).otherwise(F.when(~gap, F.lit(0.0))).alias("spread"))
