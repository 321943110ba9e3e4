"""Distributions of wet-day amounts with a free location: profile search by grouped sums, shapes by Newton steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.expr import div
from almanac.operators.precip import MIN_FIT, ln_gamma
from almanac.plans.lineage import cut

KEYS = ["station_code", "station"]
TRIES = 17
ROUNDS = 3
NEAREST = 0.99
"""Largest share of the smallest value that a location may have: beyond it likelihoods may grow without bound."""
NEWTON = 6


def _raised(a: Column) -> Column:
    return a + 6


def digamma(a: Column) -> Column:
    """Derivative of the logarithm of the gamma function, for positive arguments, to about 1e-10."""
    x = _raised(a)
    series = F.ln(x) - 1 / (2 * x) - F.pow(x, -2) / 12 + F.pow(x, -4) / 120 - F.pow(x, -6) / 252 + F.pow(x, -8) / 240 - F.pow(x, -10) / 132
    for i in range(6):
        series = series - 1 / (a + i)
    return series


def trigamma(a: Column) -> Column:
    """Its second derivative."""
    x = _raised(a)
    series = 1 / x + F.pow(x, -2) / 2 + F.pow(x, -3) / 6 - F.pow(x, -5) / 30 + F.pow(x, -7) / 42 - F.pow(x, -9) / 30 + 5 * F.pow(x, -11) / 66
    for i in range(6):
        series = series + F.pow(a + i, -2)
    return series


def gamma_shape(gap: Column, steps: int = NEWTON) -> Column:
    """The shape whose log mean less mean log is ``gap``; null where the gap is 0 (equal values)."""
    first = (3 - gap + F.sqrt((gap - 3) * (gap - 3) + 24 * gap)) / (12 * gap)

    def step(a: Column, _) -> Column:
        return 1 / (1 / a + (F.ln(a) - digamma(a) - gap) / (a * a * (1 / a - trigamma(a))))

    # A fold keeps the steps' expression as short as one step's.
    return F.when(gap > 1e-12, F.aggregate(F.array_repeat(F.lit(0), steps), first, step))


def _profile(wet: DataFrame, tries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, low, kind, share, loc, shape, scale, ll) of every location tried, from one grouped aggregate.

    ``tries`` has (keys, n, mean, low, shares): arrays of shares of the smallest value.
    """
    joined = wet.join(tries.select(*keys, "low", "shares"), keys)
    size = 2 * TRIES
    logs = [F.ln(F.col("value") - F.col("shares")[i] * F.col("low")) for i in range(size)]
    sums = joined.groupBy(*keys).agg(F.array(*[F.avg(v) for v in logs]).alias("ml"), F.array(*[F.var_pop(v) for v in logs]).alias("vl"))
    rows = tries.join(sums, keys).select(*keys, "n", "mean", "low", F.posexplode(F.arrays_zip("shares", "ml", "vl")).alias("i", "e")).select(
        *keys, "n", "mean", "low", "i", F.col("e.shares").alias("share"), F.col("e.ml").alias("ml"), F.col("e.vl").alias("vl"))
    rows = rows.withColumn("loc", F.col("share") * F.col("low")).withColumn("gap", F.ln(F.col("mean") - F.col("loc")) - F.col("ml"))
    shaped = cut(rows.withColumn("a", gamma_shape(F.col("gap"))))
    n, a, ml, s = F.col("n"), F.col("a"), F.col("ml"), F.sqrt("vl")
    theta = (F.col("mean") - F.col("loc")) / a
    gamma = F.struct(F.lit("gamma").alias("kind"), a.alias("shape"), theta.alias("scale"),
                     (n * ((a - 1) * ml - a - a * F.ln(theta) - ln_gamma(a))).alias("ll"))
    log = F.when(s > 1e-9, -n * ml - n * F.ln(s) - n * 0.5 * math.log(2 * math.pi) - n / 2)
    lognormal = F.struct(F.lit("lognormal").alias("kind"), s.alias("shape"), F.exp(ml).alias("scale"), log.alias("ll"))
    # The first half of the tries belongs to the one family, the second to the other.
    own = F.when(F.col("i") < TRIES, gamma).otherwise(lognormal)
    return shaped.select(*keys, "n", "mean", "low", "share", "loc", own.alias("f")).select(*keys, "n", "mean", "low", "share", "loc", "f.*")


def fit_located(df: DataFrame, keys: list[str] = KEYS, rounds: int = ROUNDS) -> DataFrame:
    """(keys, n, best, and per family its aic, loc, scale and shape) of the positive values of every station.

    Gamma and lognormal locations run from 0 to ``NEAREST`` of the smallest value: ``TRIES`` even steps, then
    ``rounds`` times as many around the best one; every round is one aggregate over all stations, and
    shapes at a location are exact. The exponential's location is the smallest value. Each
    family counts its parameters, location included; the smallest criterion wins. Stations with
    few wet days (under ``MIN_FIT``) are marked and have no parameters; a family that doesn't fit (equal values) has nulls.
    """
    wet = df.where(F.col("value") > 0).select(*keys, "value")
    start = cut(wet.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low")))
    even = [NEAREST * i / (TRIES - 1) for i in range(TRIES)]
    tries = start.select("*", F.array(*[F.lit(v) for v in [*even, *even]]).alias("shares"))
    best, step = None, NEAREST / (TRIES - 1)
    for turn in range(rounds + 1):
        found = cut(_profile(wet, tries, keys)).where("ll is not null and not isnan(ll)")
        found = found if best is None else found.unionByName(best)
        columns = [c for c in found.columns if c not in (*keys, "kind")]
        pick = F.struct("ll", -F.col("share"))
        best = cut(found.groupBy(*keys, "kind").agg(*[F.max_by(c, pick).alias(c) for c in columns]).select(found.columns))
        step /= (TRIES - 1) / 2
        around = best.groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == k, F.col("share"))).alias(k) for k in ("gamma", "lognormal")])
        shares = [F.least(F.greatest(F.coalesce(k, F.lit(0.0)) + (i - TRIES // 2) * step, F.lit(0.0)), F.lit(NEAREST))
                  for k in ("gamma", "lognormal") for i in range(TRIES)]
        tries = start.join(around, keys).select(*keys, "n", "mean", "low", F.array(*shares).alias("shares"))
    fits = best.groupBy(*keys).agg(*[
        F.max(F.when(F.col("kind") == k, v)).alias(f"{k}_{name}") for k in ("gamma", "lognormal")
        for name, v in (("aic", 6 - 2 * F.col("ll")), ("loc", F.col("loc")), ("scale", F.col("scale")), ("shape", F.col("shape")))])
    n, spread = F.col("n"), F.col("mean") - F.col("low")
    own = start.join(fits, keys, "left").withColumns({
        "exponential_aic": F.when(spread > 0, 4 + 2 * n * (F.ln(spread) + 1)), "exponential_loc": F.col("low"), "exponential_scale": spread})
    inf = F.lit(float("inf"))
    g, e, lg = (F.coalesce(f"{k}_aic", inf) for k in ("gamma", "exponential", "lognormal"))
    name = (F.when(n < MIN_FIT, "insufficient_data").when(F.least(g, e, lg) == inf, "fitting_failed")
            .when((g <= e) & (g <= lg), "gamma").when(e <= lg, "exponential").otherwise("lognormal"))
    columns = [f"{k}_{v}" for k, v in (("gamma", "aic"), ("gamma", "loc"), ("gamma", "scale"), ("gamma", "shape"), ("exponential", "aic"),
               ("exponential", "loc"), ("exponential", "scale"), ("lognormal", "aic"), ("lognormal", "loc"), ("lognormal", "scale"), ("lognormal", "shape"))]
    return own.select(*keys, "n", name.alias("best"), *[F.when(n >= MIN_FIT, F.col(c)).alias(c) for c in columns])
