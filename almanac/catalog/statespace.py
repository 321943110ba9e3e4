"""Queries for the first-order process through noise: likelihoods, filter, smoother and fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.impute import DECOMP
from almanac.catalog.registry import query
from almanac.catalog.sql import DAILY_SPARSE, near, r
from almanac.functions.expr import shown
from almanac.operators import statespace as ops
from almanac.plans.lineage import cut
from almanac.sources import tables as src

KEYS = ["station_code", "station"]
PHI, RATIO = 0.8, 0.5
PAIRS = ((0.0, 0.0), (0.3, 0.2), (0.6, 1.0), (0.9, 4.0), (-0.4, 0.5))


def centred(spark, sf):
    """The gappy daily series less each station's mean."""
    daily = cut(src.daily_sparse(spark, sf))
    mean = daily.groupBy(*KEYS).agg(F.avg("value").alias("mean"))
    return daily.join(mean, KEYS).withColumn("value", F.col("value") - F.col("mean")).drop("mean")


def fixed(days, pairs):
    return days.select(*KEYS).distinct().select(
        *KEYS, F.array(*[F.lit(float(p)) for p, _ in pairs]).alias("phi"), F.array(*[F.lit(float(q)) for _, q in pairs]).alias("ratio"))


def one(days):
    return days.select(*KEYS).distinct().select(*KEYS, F.lit(PHI).alias("phi"), F.lit(RATIO).alias("ratio"))


def _filter(pairs):
    """Day by day from the state in equilibrium, one row per station, day and pair."""
    listed = ", ".join(f"({p}, {q})" for p, q in pairs)
    return f"""{DAILY_SPARSE}, c AS MATERIALIZED (
   SELECT station_code, station, CAST(pos AS BIGINT) AS pos, value - avg(value) OVER (PARTITION BY station_code) AS y FROM daily),
  k AS (SELECT CAST(phi AS DOUBLE) AS phi, CAST(ratio AS DOUBLE) AS ratio FROM (VALUES {listed}) v(phi, ratio)),
  f AS (
   SELECT DISTINCT station_code, station, CAST(0 AS BIGINT) AS pos, phi, ratio, CAST(0 AS DOUBLE) AS m, 1 / (1 - phi * phi) AS p,
    CAST(0 AS DOUBLE) AS logs, CAST(0 AS DOUBLE) AS squares FROM c, k
   UNION ALL
   SELECT f.station_code, f.station, c.pos, phi, ratio,
    CASE WHEN y IS NULL THEN phi * m ELSE phi * m + (phi * phi * p + 1) / (phi * phi * p + 1 + ratio) * (y - phi * m) END,
    CASE WHEN y IS NULL THEN phi * phi * p + 1 ELSE (phi * phi * p + 1) * ratio / (phi * phi * p + 1 + ratio) END,
    logs + CASE WHEN y IS NULL THEN 0 ELSE ln(phi * phi * p + 1 + ratio) END,
    squares + CASE WHEN y IS NULL THEN 0 ELSE pow(y - phi * m, 2) / (phi * phi * p + 1 + ratio) END
   FROM f JOIN c ON c.station_code = f.station_code AND c.pos = f.pos + 1)"""


@query("ar_likelihoods", f"""WITH RECURSIVE {_filter(PAIRS)}, n AS (SELECT station_code, max(pos) AS last, count(y) AS n FROM c GROUP BY 1)
  SELECT f.station_code, station, n.n, {r('phi')} AS phi, {r('ratio')} AS ratio, {r('squares / n.n / 1e6')} AS sigma2,
   {r('-logs / 2 - n.n / 2.0 * (ln(2 * pi() * squares / n.n) + 1)', 3)} AS log_likelihood
  FROM f JOIN n ON n.station_code = f.station_code AND f.pos = n.last""")
def _(spark, sf):
    days = cut(ops.day_blocks(centred(spark, sf), size=512))
    found = ops.log_likelihoods(days, fixed(days, PAIRS))
    rows = found.select(*KEYS, "n", F.explode(F.arrays_zip("phi", "ratio", "sigma2", "log_likelihood")).alias("e")).select(*KEYS, "n", "e.*")
    return shown(shown(rows.withColumn("sigma2", F.col("sigma2") / 1e6), [*KEYS, "n", "log_likelihood"], ["phi", "ratio", "sigma2"]),
                 [*KEYS, "n", "phi", "ratio", "sigma2"], ["log_likelihood"], 3)


@query("kalman_filter", f"""WITH RECURSIVE {_filter([(PHI, RATIO)])}
  SELECT station_code, station, pos, {r('m', 3)} AS m, {r('p', 3)} AS p FROM f WHERE pos > 0""")
def _(spark, sf):
    days = cut(ops.day_blocks(centred(spark, sf), size=512))
    return shown(ops.filtered(days, one(days)), [*KEYS, "pos"], ["m", "p"], 3)


_GAIN = f"(f.p * {PHI} / ({PHI} * {PHI} * f.p + 1))"


@query("kalman_smoother", f"""WITH RECURSIVE {_filter([(PHI, RATIO)])}, n AS (SELECT station_code, max(pos) AS last FROM c GROUP BY 1),
  g AS MATERIALIZED (SELECT station_code, station, pos, m, p FROM f WHERE pos > 0),
  s AS (
   SELECT g.station_code, g.station, g.pos, g.m, g.p FROM g JOIN n ON n.station_code = g.station_code AND g.pos = n.last
   UNION ALL
   SELECT f.station_code, f.station, f.pos, f.m + {_GAIN} * (s.m - {PHI} * f.m), f.p + {_GAIN} * {_GAIN} * (s.p - {PHI} * {PHI} * f.p - 1)
   FROM s JOIN g f ON f.station_code = s.station_code AND f.pos = s.pos - 1)
  SELECT station_code, station, pos, {r('m', 3)} AS m, {r('p', 3)} AS p FROM s""")
def _(spark, sf):
    days = cut(ops.day_blocks(centred(spark, sf), size=512))
    return shown(ops.smoothed(days, one(days)), [*KEYS, "pos"], ["m", "p"], 3)


@query("ar_likelihood_fit")
def _(spark, sf):
    return shown(ops.ar_likelihood(cut(src.daily_sparse(spark, sf))), [*KEYS, "n"], ["phi", "ratio", "sigma2", "log_likelihood"])


@query("impute_smoothed")
def _(spark, sf):
    return shown(ops.impute_smoothed(cut(src.daily_sparse(spark, sf))), [*KEYS, "date", "imputed"], ["value", "spread"])


# Between two known days the closed form of the process, beyond the last one its decay.
_B = f"pow({PHI}, pos - prev_pos)"
_A = f"pow({PHI}, next_pos - pos)"
_L = f"pow({PHI}, next_pos - prev_pos)"


@query("impute_bridge", f"""WITH {DAILY_SPARSE}, {DECOMP.format(src='daily')},
  lv AS (SELECT station_code, station, date, CAST(pos AS BIGINT) AS pos, value AS own, seasonal, avg(value - seasonal) OVER (PARTITION BY station_code) AS centre,
    value - seasonal - avg(value - seasonal) OVER (PARTITION BY station_code) AS value FROM decomp),
  {near('lv', 'nr')}
  SELECT station_code, station, date, own IS NULL AS imputed, {r(f"""coalesce(own, seasonal + centre + CASE
    WHEN prev_pos IS NULL THEN next_value * {_A} WHEN next_pos IS NULL THEN prev_value * {_B}
    ELSE (prev_value * {_B} * (1 - {_A} * {_A}) + next_value * {_A} * (1 - {_B} * {_B})) / (1 - {_L} * {_L}) END)""", 2)} AS value FROM nr""")
def _(spark, sf):
    """The smoother's fill with a given phi is the bridge between the edges of every gap."""
    d = ops.impute_smoothed(cut(src.daily_sparse(spark, sf)), phi=PHI, size=512)
    return shown(d, [*KEYS, "date", "imputed"], ["value"], 2)
