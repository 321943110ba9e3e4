"""Queries for zero-inflated series."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.components import COMP, KEYS, sel
from almanac.catalog.forecast import SIMPLE
from almanac.catalog.registry import query
from almanac.catalog.sql import RAIN, r
from almanac.functions.expr import long, rnd, shown
from almanac.operators import components as cops
from almanac.operators import forecast as fops
from almanac.operators import located
from almanac.operators import precip as ops
from almanac.plans.lineage import cut
from almanac.sources import tables as src

PROFILE = """prof AS MATERIALIZED (SELECT *, total_days - dry_days AS wet_days, 1 - dry_fraction AS wet_fraction,
   CASE WHEN dry_fraction > 0.8 THEN 'very_dry' WHEN dry_fraction < 0.3 THEN 'wet' ELSE 'moderate' END AS regime FROM (
   SELECT station_code, station, count(*) AS total_days, count(*) FILTER (value = 0) AS dry_days, CAST(count(*) FILTER (value = 0) AS DOUBLE) / count(*) AS dry_fraction,
    coalesce(avg(value) FILTER (value > 0), 0.0) AS wet_mean, coalesce(stddev_samp(value) FILTER (value > 0), 0.0) AS wet_std,
    coalesce(quantile_cont(value, 0.5) FILTER (value > 0), 0.0) AS wet_median, coalesce(max(value) FILTER (value > 0), 0.0) AS wet_max FROM rain GROUP BY 1, 2))"""
_P = ["dry_fraction", "wet_fraction", "wet_mean", "wet_std", "wet_median", "wet_max"]


@query("wet_dry_profile", f"WITH {RAIN}, {PROFILE} SELECT station_code, station, total_days, dry_days, wet_days, regime, {sel(_P)} FROM prof")
def _(spark, sf):
    return shown(ops.wet_dry_profile(src.rain(spark, sf)), [*KEYS, "total_days", "dry_days", "wet_days", "regime"], _P)


@query("monthly_wet_pattern", f"""WITH {RAIN} SELECT station_code, station, CAST(month(date) AS INTEGER) AS month, count(value) AS n, {r('avg(value)')} AS mean,
  {r('avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END)')} AS wet_fraction FROM rain GROUP BY 1, 2, 3""")
def _(spark, sf):
    return shown(ops.monthly_wet_pattern(src.rain(spark, sf)), [*KEYS, "month", "n"], ["mean", "wet_fraction"])


_LN2PI = "0.9189385332046727"
FIT = f"""d0 AS (SELECT station_code, station, count(*) AS n, avg(value) AS m, avg(ln(value)) AS ml, stddev_pop(ln(value)) AS sl FROM {{rel}} WHERE value > 0 GROUP BY 1, 2),
  d1 AS (SELECT *, CASE WHEN ln(m) - ml > 1e-12 THEN (3 - (ln(m) - ml) + sqrt(pow(ln(m) - ml - 3, 2) + 24 * (ln(m) - ml))) / (12 * (ln(m) - ml)) END AS shape FROM d0),
  d2 AS (SELECT *, m / shape AS scale, 4 - 2 * (-n * ln(m) - n) AS aic_exponential,
    CASE WHEN sl > 1e-12 THEN 6 - 2 * (-n * ml - n * ln(sl) - n * {_LN2PI} - n / 2.0) END AS aic_lognormal,
    6 - 2 * ((shape - 1) * n * ml - n * m / (m / shape) - n * (shape * ln(m / shape) + lgamma(shape))) AS aic_gamma FROM d1),
  dist AS (SELECT *, CASE WHEN n < 10 THEN 'insufficient_data' WHEN coalesce(aic_gamma, 1e300) <= coalesce(aic_exponential, 1e300) AND coalesce(aic_gamma, 1e300) <= coalesce(aic_lognormal, 1e300) THEN 'gamma'
    WHEN coalesce(aic_exponential, 1e300) <= coalesce(aic_lognormal, 1e300) THEN 'exponential' ELSE 'lognormal' END AS best FROM d2)"""
_FN = ["aic_gamma", "aic_exponential", "aic_lognormal", "shape", "scale"]


# order values are continuous amounts; daily counts would be nearly constant on wet days
def amounts(spark, sf):
    """Prices of orders in thousands, by the customer's nation."""
    o = src.table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    c = src.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = src.table(spark, sf, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_nationkey").alias("station_code"), F.col("n_name").alias("station"), (F.col("o_totalprice") / 1000).alias("value"))


@query("fit_distribution", f"""WITH src AS (SELECT c_nationkey AS station_code, n_name AS station, o_totalprice / 1000 AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  {FIT.format(rel='src')} SELECT station_code, station, n, best, {', '.join(f"{r(f'CASE WHEN n >= 10 THEN {c} END', 3)} AS {c}" for c in _FN)},
  {r('CASE WHEN n >= 10 THEN ml END', 3)} AS log_mean, {r('CASE WHEN n >= 10 THEN sl END', 3)} AS log_std FROM dist""")
def _(spark, sf):
    return shown(ops.fit_distribution(amounts(spark, sf)), [*KEYS, "n", "best"], [*_FN, "log_mean", "log_std"], 3)


@query("fit_distribution_rain", f"""WITH {RAIN}, {FIT.format(rel='rain')} SELECT station_code, station, n, best, {', '.join(f"{r(f'CASE WHEN n >= 10 THEN {c} END', 3)} AS {c}" for c in _FN)} FROM dist""")
def _(spark, sf):
    return shown(ops.fit_distribution(src.rain(spark, sf)), [*KEYS, "n", "best"], _FN, 3)


def _rain_parts(spark, sf):
    history = cut(src.rain(spark, sf))
    parts = cut(fops.simple_components(cops.decompose(history)))
    base = parts.groupBy(*KEYS, "date", "days_ahead").agg(F.sum("value").alias("value"))
    return history, parts, base


COMP_RAIN = RAIN + ", " + COMP[COMP.index("lv1 AS ("):].replace("AS level_1 FROM filled)", "AS level_1 FROM rain)")
BASE = f"{COMP_RAIN}, {SIMPLE}, {PROFILE}, base AS MATERIALIZED (SELECT station_code, station, date, days_ahead, sum(value) AS value FROM parts GROUP BY 1, 2, 3, 4)"
BOUNDED = f"{BASE}, bnd AS MATERIALIZED (SELECT b.station_code, b.station, b.date, b.days_ahead, greatest(0.0, least(b.value, wet_max * 1.5)) AS value FROM base b JOIN (SELECT station_code, wet_max FROM prof) p ON b.station_code = p.station_code)"


def unit(salt):
    """The same draw as ``hash_unit``."""
    return f"((CAST('0x' || substr(md5('{salt}|' || CAST(station_code AS VARCHAR) || '|' || station || '|' || CAST(date AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


@query("precip_transform", f"""WITH {BASE}, hi AS (SELECT station_code, avg(value) AS hm, stddev_samp(value) AS hs FROM rain GROUP BY 1),
  t0 AS (SELECT b.station_code, b.station, CAST(b.date AS DATE) AS date, b.days_ahead, b.value, 1 - p.dry_fraction AS wet_fraction, p.wet_mean, hm, hs,
    avg(b.value) OVER (PARTITION BY b.station_code) AS pm, stddev_pop(b.value) OVER (PARTITION BY b.station_code) AS ps
    FROM base b JOIN prof p ON b.station_code = p.station_code JOIN hi ON b.station_code = hi.station_code),
  t1 AS (SELECT *, CASE WHEN ps > 0 THEN (value - pm) * (hs / ps) + hm ELSE hm END AS scaled FROM t0)
  SELECT station_code, station, date, {r(f"""CASE WHEN wet_fraction <= 0 THEN scaled WHEN NOT {unit('wet')} < wet_fraction THEN 0.0
    WHEN scaled < wet_mean * 0.1 THEN -wet_mean * ln({unit('amount')}) ELSE greatest(scaled, wet_mean * 0.1) END""")} AS value, days_ahead FROM t1""")
def _(spark, sf):
    h, _p, base = _rain_parts(spark, sf)
    return long(ops.precip_transform(base, h), "days_ahead")


@query("precip_forecast")
def _(spark, sf):
    h, parts, _b = _rain_parts(spark, sf)
    return long(ops.precip_forecast(parts, h), "days_ahead")


@query("precip_bounds", f"WITH {BOUNDED} SELECT station_code, station, date, {r('value')} AS value, days_ahead FROM bnd")
def _(spark, sf):
    h, _p, base = _rain_parts(spark, sf)
    return long(ops.precip_bounds(base, ops.wet_dry_profile(h)), "days_ahead")


# every day is lifted off zero first, so only the drying branch acts and the result is exact
FIXED = f"""{BOUNDED}, lifted AS (SELECT station_code, station, date, days_ahead, greatest(value, 0.01) AS value FROM bnd), fx0 AS (SELECT b.*, dry_fraction, count(*) OVER (PARTITION BY b.station_code) AS n, count(*) FILTER (value > 0) OVER (PARTITION BY b.station_code) AS nw,
    row_number() OVER (PARTITION BY b.station_code, value > 0 ORDER BY value, date) AS rk FROM lifted b JOIN (SELECT station_code, dry_fraction FROM prof) p ON b.station_code = p.station_code),
  fixed AS MATERIALIZED (SELECT station_code, station, date, days_ahead, CASE WHEN abs(CAST(n - nw AS DOUBLE) / n - dry_fraction) > 0.2 AND value > 0
    AND rk <= nw - (n - floor(n * dry_fraction + 1e-9)) THEN 0.0 ELSE value END AS value FROM fx0)"""


def _fixed(spark, sf):
    h, _p, base = _rain_parts(spark, sf)
    profile = cut(ops.wet_dry_profile(h))
    lifted = ops.precip_bounds(base, profile).withColumn("value", F.greatest("value", F.lit(0.01)))
    return ops.dry_fraction_fix(lifted, profile), profile


@query("dry_fraction_fix", f"WITH {FIXED} SELECT station_code, station, date, {r('value')} AS value, days_ahead FROM fixed")
def _(spark, sf):
    return long(_fixed(spark, sf)[0], "days_ahead")


_PQ = ["dry_fraction_similarity", "wet_mean_similarity", "overall_quality", "predicted_dry_fraction", "predicted_wet_mean"]


@query("precip_quality", f"""WITH {FIXED}, q0 AS (SELECT station_code, station, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS predicted_dry_fraction,
   coalesce(avg(value) FILTER (value > 0), 0.0) AS predicted_wet_mean FROM fixed GROUP BY 1, 2),
  q1 AS (SELECT q0.*, 1 - abs(dry_fraction - predicted_dry_fraction) AS dry_fraction_similarity, CASE WHEN wet_mean > 0 THEN 1 - abs(predicted_wet_mean - wet_mean) / wet_mean
    WHEN predicted_wet_mean = 0 THEN 1.0 ELSE 0.0 END AS wet_mean_similarity FROM q0 JOIN (SELECT station_code, dry_fraction, wet_mean FROM prof) p ON q0.station_code = p.station_code),
  q2 AS (SELECT *, (dry_fraction_similarity + wet_mean_similarity) / 2 AS overall_quality FROM q1) SELECT station_code, station, {sel(_PQ)} FROM q2""")
def _(spark, sf):
    return shown(ops.precip_quality(*_fixed(spark, sf)), KEYS, _PQ)


@query("precip_realism", f"""WITH {FIXED}, k AS (SELECT *, CASE WHEN value > 0 THEN 'wet' ELSE 'dry' END AS kind FROM fixed),
  rn AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY date) - row_number() OVER (PARTITION BY station_code, kind ORDER BY date) AS run FROM k),
  ln AS (SELECT station_code, station, kind, run, count(*) AS len FROM rn GROUP BY 1, 2, 3, 4),
  lm AS (SELECT station_code, station, coalesce(max(len) FILTER (kind = 'wet'), 0) AS longest_wet, coalesce(max(len) FILTER (kind = 'dry'), 0) AS longest_dry FROM ln GROUP BY 1, 2),
  mx AS (SELECT f.station_code, max(value) AS hi, any_value(wet_max) AS wm FROM fixed f JOIN prof p ON f.station_code = p.station_code GROUP BY 1)
  SELECT lm.station_code, station, longest_wet, longest_dry, {r('greatest(0.0, 1 - CASE WHEN hi > 2 * wm THEN 0.2 ELSE 0.0 END - CASE WHEN longest_wet > 30 THEN 0.2 ELSE 0.0 END - CASE WHEN longest_dry > 365 THEN 0.3 ELSE 0.0 END)')} AS realism
  FROM lm JOIN mx ON lm.station_code = mx.station_code""")
def _(spark, sf):
    f, p = _fixed(spark, sf)
    return shown(ops.precip_realism(cut(f), p), [*KEYS, "longest_wet", "longest_dry"], ["realism"])


@query("precip_interval", f"""WITH {FIXED} SELECT f.station_code, f.station, date, days_ahead, {r('value')} AS value, 0.0::DOUBLE AS lower_ci,
  {r('least(value + 1.96 * wet_std, 2 * wet_max)')} AS upper_ci FROM fixed f JOIN prof p ON f.station_code = p.station_code""")
def _(spark, sf):
    return shown(ops.precip_interval(*_fixed(spark, sf)), [*KEYS, "date", "days_ahead"], ["value", "lower_ci", "upper_ci"])


@query("fit_located")
def _(spark, sf):
    fits = located.fit_located(cut(amounts(spark, sf)))
    names = [c for c in fits.columns if c not in (*KEYS, "n", "best")]
    return shown(fits, [*KEYS, "n", "best"], names)
