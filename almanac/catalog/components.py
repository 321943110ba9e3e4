"""Queries for components, their quality and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.registry import query
from almanac.catalog.sql import FILLED, corr, r
from almanac.functions.expr import rnd, shown
from almanac.operators import components as ops
from almanac.plans.lineage import cut
from almanac.sources import tables as src

KEYS = ["station_code", "station"]
CK = [*KEYS, "component"]
CKS = "station_code, station, component"
CW = "(PARTITION BY station_code, component ORDER BY pos)"


def comp(spark, sf):
    return ops.decompose(src.filled(spark, sf))


def comp_cut(spark, sf):
    """Components written once, for the queries whose branches read them several times."""
    return cut(comp(spark, sf))


_LEVELS = []
_prev = "filled"
for _i, _h in enumerate([3, 15, 45, 182], start=1):
    _v = "value" if _i == 1 else f"level_{_i - 1}"
    _LEVELS.append(
        f"lv{_i} AS (SELECT *, avg({_v}) OVER (PARTITION BY station_code ORDER BY pos ROWS BETWEEN {_h} PRECEDING AND {_h} FOLLOWING) "
        f"AS level_{_i} FROM {_prev})")
    _prev = f"lv{_i}"
_PARTS = ["value - level_1", "level_1 - level_2", "level_2 - level_3", "level_3 - level_4", "level_4"]
COMP = f"{FILLED}, {', '.join(_LEVELS)}, comp AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT station_code, station, {i} AS component, date, pos, value AS series_value, {p} AS value FROM lv4"
    for i, p in enumerate(_PARTS, start=1)) + ")"


@query("decompose", f"WITH {COMP} SELECT {CKS}, date, {r('value')} AS value, {r('series_value')} AS series_value FROM comp")
def _(spark, sf):
    return shown(comp(spark, sf), [*CK, "date"], ["value", "series_value"])


@query("component_correlation", f"WITH {COMP} SELECT {CKS}, {r(corr('value', 'series_value'))} AS correlation FROM comp GROUP BY 1, 2, 3")
def _(spark, sf):
    return shown(ops.component_correlation(comp(spark, sf)), CK, ["correlation"])


VAR = f"""p_var AS MATERIALIZED (SELECT {CKS}, variance, ratio AS explained_ratio, sum(ratio) OVER (PARTITION BY station_code ORDER BY component) AS cumulative_ratio
  FROM (SELECT {CKS}, var_pop(value) AS variance, var_pop(value) / nullif(var_pop(series_value), 0) AS ratio FROM comp GROUP BY 1, 2, 3))"""


@query("variance_explained", f"WITH {COMP}, {VAR} SELECT {CKS}, {r('variance')} AS variance, {r('explained_ratio')} AS explained_ratio, {r('cumulative_ratio')} AS cumulative_ratio FROM p_var")
def _(spark, sf):
    return shown(ops.variance_explained(comp(spark, sf)), CK, ["variance", "explained_ratio", "cumulative_ratio"])


ORTH = f"""p_orth AS MATERIALIZED (SELECT station_code, station, avg(c) AS orthogonality FROM (
   SELECT a.station_code, a.station, a.component AS i, b.component AS j, abs({corr('a.value', 'b.value')}) AS c
   FROM comp a JOIN comp b ON a.station_code = b.station_code AND a.pos = b.pos AND a.component < b.component GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)"""


@query("orthogonality", f"WITH {COMP}, {ORTH} SELECT station_code, station, {r('orthogonality')} AS orthogonality FROM p_orth")
def _(spark, sf):
    return shown(ops.orthogonality(comp(spark, sf)), KEYS, ["orthogonality"])


QUAL = f"""lg1 AS (SELECT *, lag(value) OVER {CW} AS l FROM comp),
  q0 AS (SELECT {CKS}, avg(value) AS m, stddev_pop(value) AS s, var_pop(value) / nullif(var_pop(series_value), 0) AS vr, stddev_pop(value - l) AS ds FROM lg1 GROUP BY 1, 2, 3),
  p_qual AS MATERIALIZED (SELECT *, (zero_mean_score + variance_score + smoothness_score) / 3 AS quality FROM (SELECT {CKS},
   CASE WHEN s > 0 THEN 1 - least(abs(m) / s, 1.0) ELSE 0.0 END AS zero_mean_score, least(vr * 10, 1.0) AS variance_score,
   CASE WHEN s > 0 THEN 1 - least(ds / s, 1.0) ELSE 0.0 END AS smoothness_score FROM q0))"""
_Q = ["zero_mean_score", "variance_score", "smoothness_score", "quality"]


def sel(names, digits=4):
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


@query("component_quality", f"WITH {COMP}, {QUAL} SELECT {CKS}, {sel(_Q)} FROM p_qual")
def _(spark, sf):
    return shown(ops.component_quality(comp(spark, sf)), CK, _Q)


def strongest(rel, names):
    return ", ".join(f"first_value(component) OVER (PARTITION BY station_code ORDER BY {n} DESC, component) AS strongest_{n}" for n in names)


PER = f"""lgp AS (SELECT *, lag(value, 365) OVER {CW} AS la, lag(value, 30) OVER {CW} AS lm, lag(value, 7) OVER {CW} AS lw FROM comp),
  p_per AS MATERIALIZED (SELECT {CKS}, coalesce(abs({corr('value', 'la')}), 0.0) AS annual, coalesce(abs({corr('value', 'lm')}), 0.0) AS monthly,
   coalesce(abs({corr('value', 'lw')}), 0.0) AS weekly FROM lgp GROUP BY 1, 2, 3)"""
_P = ["annual", "monthly", "weekly"]


@query("periodicity", f"WITH {COMP}, {PER} SELECT {CKS}, {sel(_P)}, {strongest('p_per', _P)} FROM p_per")
def _(spark, sf):
    return shown(ops.periodicity(comp(spark, sf)), [*CK, *[f"strongest_{c}" for c in _P]], _P)


TREND = f"""tn AS (SELECT {CKS}, count(*) AS n, avg(value) AS m FROM comp GROUP BY 1, 2, 3),
  ts AS (SELECT c.station_code, c.station, c.component, n, sum((pos - (n + 1) / 2.0) * (value - m)) AS ud,
    sum(pow(pos - (n + 1) / 2.0, 2) * (value - m)) AS uud, stddev_pop(value) AS s
    FROM comp c JOIN tn ON c.station_code = tn.station_code AND c.component = tn.component GROUP BY 1, 2, 3, 4),
  tc AS (SELECT *, CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) * n - 1) / 12 AS suu, CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) * n - 1) * (CAST(n AS DOUBLE) * n - 4) / 180 AS qt FROM ts),
  p_trend AS MATERIALIZED (SELECT {CKS}, abs(ud / suu) / s AS trend, abs(uud / qt) / s AS quadratic,
    greatest(1 - sqrt(1 - least(ud * ud / (suu * s * s * n), 1.0)), 0.0) AS consistency FROM tc)"""


@query("component_trend", f"""WITH {COMP}, {TREND} SELECT {CKS}, {r('trend * 1000')} AS trend_per_1000, {r('quadratic * 1000000')} AS quadratic_per_million,
  {r('consistency')} AS consistency, {strongest('p_trend', ['trend', 'quadratic'])} FROM p_trend""")
def _(spark, sf):
    d = ops.component_trend(comp(spark, sf))
    return d.select(*CK, rnd(F.col("trend") * 1000).alias("trend_per_1000"),
                    rnd(F.col("quadratic") * 1000000).alias("quadratic_per_million"), rnd("consistency").alias("consistency"),
                    "strongest_trend", "strongest_quadratic")


EXT = f"""qs AS (SELECT station_code, quantile_cont(series_value, 0.05) AS p5, quantile_cont(series_value, 0.95) AS p95 FROM comp WHERE component = 1 GROUP BY 1),
  p_ext AS MATERIALIZED (SELECT c.station_code, c.station, c.component, avg(CASE WHEN value > p95 + 1e-9 THEN 1.0 ELSE 0.0 END) AS heat,
   avg(CASE WHEN value < p5 - 1e-9 THEN 1.0 ELSE 0.0 END) AS cold FROM comp c JOIN qs ON c.station_code = qs.station_code GROUP BY 1, 2, 3)"""


@query("extreme_events", f"WITH {COMP}, {EXT} SELECT {CKS}, {sel(['heat', 'cold'])}, {strongest('p_ext', ['heat', 'cold'])} FROM p_ext")
def _(spark, sf):
    return shown(ops.extreme_events(comp_cut(spark, sf)), [*CK, "strongest_heat", "strongest_cold"], ["heat", "cold"])


def clim(decade=3650):
    return f"""cn AS (SELECT *, count(*) OVER (PARTITION BY station_code, component) AS n FROM comp),
  ca AS (SELECT {CKS}, n, regr_slope(value, pos) AS slope, stddev_pop(value) AS s,
   regr_slope(value, pos) FILTER (n > {decade} AND pos > n - least({decade}, n // 2)) AS dslope,
   stddev_pop(value) FILTER (n > {decade} AND pos > n - least({decade}, n // 2)) AS ds,
   count(*) FILTER (n > {decade} AND pos > n - least({decade}, n // 2)) AS dn FROM cn GROUP BY 1, 2, 3, 4),
  cy AS (SELECT {CKS}, (pos - 1) // 365 AS y, avg(value) AS ym FROM cn WHERE n > 730 AND ((pos - 1) // 365) * 365 < n - 365 GROUP BY 1, 2, 3, 4),
  cz AS (SELECT {CKS}, regr_slope(ym, y) AS ys, stddev_pop(ym) AS yd, count(*) AS yn FROM cy GROUP BY 1, 2, 3),
  p_clim AS MATERIALIZED (SELECT ca.station_code, ca.station, ca.component, coalesce(abs(slope * n / nullif(s, 0)), 0.0) AS long_term,
   coalesce(abs(dslope * dn / nullif(ds, 0)), 0.0) AS decadal, CASE WHEN yn > 2 THEN coalesce(abs(ys) / nullif(yd, 0), 0.0) ELSE 0.0 END AS seasonal_trend
   FROM ca LEFT JOIN cz ON ca.station_code = cz.station_code AND ca.component = cz.component)"""


_C = ["long_term", "decadal", "seasonal_trend"]


@query("climate_trends", f"WITH {COMP}, {clim(1800)} SELECT {CKS}, {sel(_C)}, {strongest('p_clim', _C)} FROM p_clim")
def _(spark, sf):
    # the series have seven years, so the recent span is set below them
    return shown(ops.climate_trends(comp_cut(spark, sf), 1800), [*CK, *[f"strongest_{c}" for c in _C]], _C)


CYC = f"""cp AS (SELECT {CKS}, pos, value, list(value) OVER (PARTITION BY station_code, component ORDER BY pos ROWS BETWEEN 100 PRECEDING AND CURRENT ROW) AS l FROM comp),
  cq AS (SELECT {CKS}, g.lag, sum(value * l[len(l) - g.lag]) AS product FROM cp, (SELECT unnest(range(0, 101)) AS lag) g
    WHERE len(l) > g.lag GROUP BY 1, 2, 3, 4),
  cr AS (SELECT *, coalesce(product / nullif(max(CASE WHEN lag = 0 THEN product END) OVER (PARTITION BY station_code, component), 0), 0.0) AS ac FROM cq),
  cs AS (SELECT *, lag(ac) OVER w AS b, lead(ac) OVER w AS a FROM cr WINDOW w AS (PARTITION BY station_code, component ORDER BY lag)),
  ct AS (SELECT *, coalesce(lag BETWEEN 10 AND 99 AND ac > b + 1e-9 AND ac > a + 1e-9 AND ac > 0.1, false) AS peak FROM cs),
  p_cyc AS MATERIALIZED (SELECT {CKS}, coalesce(avg(CASE WHEN peak THEN ac END), 0.0) AS cyclical, count(*) FILTER (peak) AS peaks FROM ct GROUP BY 1, 2, 3)"""


@query("cyclical_strength", f"WITH {COMP}, {CYC} SELECT {CKS}, {sel(['cyclical'])}, peaks, {strongest('p_cyc', ['cyclical'])} FROM p_cyc")
def _(spark, sf):
    return shown(ops.cyclical_strength(comp(spark, sf)), [*CK, "peaks", "strongest_cyclical"], ["cyclical"])


# the full transform by definition; mirrored bins of a real series count twice
SPEC = f"""sn AS (SELECT station_code, component, count(*) AS n FROM comp GROUP BY 1, 2),
  sk AS (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM sn),
  sd AS (SELECT sk.station_code, c.station, sk.component, sk.n, sk.k, pow(sum(value * cos(2 * pi() * ((sk.k * (pos - 1)) % sk.n) / sk.n)), 2)
    + pow(sum(value * sin(2 * pi() * ((sk.k * (pos - 1)) % sk.n) / sk.n)), 2) AS pw
    FROM sk JOIN comp c ON c.station_code = sk.station_code AND c.component = sk.component GROUP BY 1, 2, 3, 4, 5),
  sm AS (SELECT *, CASE WHEN k > 0 AND 2 * k < n THEN 1 ELSE 0 END AS mirror, CASE WHEN k >= n // 4 THEN 1 ELSE 0 END AS high FROM sd),
  p_spec AS MATERIALIZED (SELECT {CKS}, sum(pw * (high + mirror)) / sum(pw * (1 + mirror)) AS noise_ratio,
    (sum(sqrt(pw) * (high + mirror)) / (any_value(n) - any_value(n) // 4)) / (sum(sqrt(pw) * (1 + mirror)) / any_value(n)) AS noise_level,
    CAST(arg_max(k, CASE WHEN k > 0 AND k < n // 2 THEN pw END) AS DOUBLE) / any_value(n) AS dominant_frequency FROM sm GROUP BY 1, 2, 3)"""


@query("noise_ratio", f"WITH {COMP}, {SPEC} SELECT {CKS}, {sel(['noise_ratio'])}, {strongest('p_spec', ['noise_ratio'])} FROM p_spec")
def _(spark, sf):
    return shown(ops.noise_ratio(comp(spark, sf)), [*CK, "strongest_noise_ratio"], ["noise_ratio"])


SHAPE = f"""sh AS (SELECT *, lag(value) OVER {CW} AS prev, var_pop(value) OVER (PARTITION BY station_code, component ORDER BY pos ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS v31 FROM comp),
  p_shape AS MATERIALIZED (SELECT {CKS}, coalesce({corr('value', 'series_value')}, 0.0) AS correlation, var_pop(value) AS variance,
   coalesce(abs(regr_slope(value, pos)) / nullif(stddev_pop(value), 0), 0.0) AS trend_strength,
   1 / (1 + coalesce(stddev_pop(v31) FILTER (pos > 30), 0.0)) AS stability,
   CAST(count(*) FILTER (prev IS NOT NULL AND sign(round(value, 9)) <> sign(round(prev, 9))) AS DOUBLE) / count(*) AS complexity,
   max(value) - min(value) AS amplitude, avg(value) AS mean_value, coalesce({corr('value', 'prev')}, 0.0) AS autocorrelation FROM sh GROUP BY 1, 2, 3)"""
_S = ["correlation", "variance", "trend_strength", "stability", "complexity", "amplitude", "mean_value", "autocorrelation"]
_SF = ["noise_ratio", "noise_level", "dominant_frequency"]


@query("component_properties", f"""WITH {COMP}, {SHAPE}, {SPEC} SELECT {CKS}, {sel(_S)}, {sel(_SF)},
  abs(dominant_frequency - 1 / 365.0) < 0.1 AS annual, abs(dominant_frequency - 1 / 30.0) < 0.1 AS monthly
  FROM p_shape JOIN p_spec USING ({CKS})""")
def _(spark, sf):
    return shown(ops.component_properties(comp_cut(spark, sf)), [*CK, "annual", "monthly"], [*_S, *_SF])


SCORE = f"""{SHAPE}, {SPEC}, {PER}, {TREND}, {EXT}, {clim()}, {CYC}, {VAR},
  p_in AS (SELECT s.*, noise_ratio, noise_level, dominant_frequency, annual, monthly, weekly, trend, quadratic, consistency, heat, cold,
    long_term, decadal, seasonal_trend, cyclical, explained_ratio
    FROM p_shape s JOIN p_spec USING ({CKS}) JOIN p_per USING ({CKS}) JOIN p_trend USING ({CKS}) JOIN p_ext USING ({CKS})
    JOIN p_clim USING ({CKS}) JOIN p_cyc USING ({CKS}) JOIN p_var USING ({CKS})),
  p_score AS MATERIALIZED (SELECT *, 0.20 * annual + 0.12 * monthly + 0.04 * weekly * 0.5 + 0.12 * least(trend / 0.1, 1.0)
    + 0.08 * least(long_term / 0.1, 1.0) + 0.04 * least(decadal / 0.1, 1.0) + 0.04 * least(quadratic / 0.1, 1.0) + 0.04 * consistency
    + 0.04 * least(seasonal_trend / 0.1, 1.0) + 0.04 * least(cyclical / 0.5, 1.0) + 0.04 * greatest(heat, cold) + 0.08 * stability
    + 0.04 * least(autocorrelation * 2, 1.0) + 0.02 * (1 - least(noise_level * 2, 1.0))
    + 0.02 * CASE WHEN dominant_frequency < 0.001 THEN 1.0 WHEN dominant_frequency < 0.01 THEN 0.9 WHEN dominant_frequency < 0.05 THEN 0.6 ELSE 0.2 END
    + 0.04 * least(explained_ratio * 2, 1.0) AS score FROM p_in)"""


def scored(spark, sf):
    return ops.seasonal_model_score(ops.score_inputs(comp_cut(spark, sf)))


@query("seasonal_model_score", f"WITH {COMP}, {SCORE} SELECT {CKS}, {sel(['score'])} FROM p_score")
def _(spark, sf):
    return shown(scored(spark, sf), CK, ["score"])


CLASSES = f"""{SCORE}, p_rank AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY round(score, 9) DESC, component) AS rk FROM p_score),
  classes AS MATERIALIZED (SELECT *, CASE WHEN rk = 1 THEN 'seasonal'
   WHEN complexity > 0.08 AND dominant_frequency > 0.005 AND abs(correlation) > 0.05 AND noise_level < 0.8 THEN 'lag'
   WHEN noise_level > 0.7 OR abs(correlation) < 0.02 OR variance < 0.0001 THEN 'noise'
   WHEN complexity < 0.05 AND stability > 0.6 AND abs(correlation) > 0.02 THEN 'extrapolation' ELSE 'lag' END AS model_class FROM p_rank)"""


@query("classify_components", f"WITH {COMP}, {CLASSES} SELECT {CKS}, {sel(['score'])}, CAST(rk AS INTEGER) AS rank, model_class FROM classes")
def _(spark, sf):
    return ops.classify_components(scored(spark, sf)).select(*CK, rnd("score").alias("score"), "rank", "model_class")


@query("filter_components", f"""WITH {COMP}, {VAR}, {QUAL}, j AS (SELECT {CKS}, explained_ratio, quality, explained_ratio >= 0.005 AND quality >= 0.3 AS good
   FROM p_var JOIN p_qual USING ({CKS})),
  k AS (SELECT *, count(*) OVER (PARTITION BY station_code) AS total, count(*) FILTER (good) OVER (PARTITION BY station_code) AS ng FROM j)
  SELECT {CKS}, {sel(['explained_ratio', 'quality'])}, CASE WHEN total <= 3 THEN true WHEN ng < 3 THEN component <= 3 ELSE good END AS kept FROM k""")
def _(spark, sf):
    return shown(ops.filter_components(comp_cut(spark, sf)), [*CK, "kept"], ["explained_ratio", "quality"])


@query("reconstruction_error", f"""WITH {COMP}, b AS (SELECT station_code, station, pos, any_value(series_value) AS sv, sum(value) AS rb FROM comp GROUP BY 1, 2, 3)
  SELECT station_code, station, {r('avg(pow(sv - rb, 2))')} AS mse, {r('avg(abs(sv - rb))')} AS mae, {r(corr('sv', 'rb'))} AS reconstruction_correlation,
  count(*) AS n FROM b GROUP BY 1, 2""")
def _(spark, sf):
    return shown(ops.reconstruction_error(comp(spark, sf)), [*KEYS, "n"], ["mse", "mae", "reconstruction_correlation"])


DQ = f"""{VAR}, {QUAL}, {PER}, {ORTH},
  d1 AS (SELECT station_code, station, sum(explained_ratio) FILTER (component <= 3) AS top3_variance, sum(explained_ratio) AS top5_variance FROM p_var GROUP BY 1, 2),
  d2 AS (SELECT station_code, max(abs(c)) AS max_correlation, avg(abs(c)) AS mean_correlation FROM (SELECT station_code, component, {corr('value', 'series_value')} AS c FROM comp GROUP BY 1, 2) GROUP BY 1),
  d3 AS (SELECT station_code, avg(quality) AS mean_quality FROM p_qual GROUP BY 1),
  d4 AS (SELECT station_code, max(annual) AS seasonality FROM p_per GROUP BY 1),
  d5 AS (SELECT station_code, avg(abs(sv - rb)) AS reconstruction_error, {corr('sv', 'rb')} AS reconstruction_correlation
    FROM (SELECT station_code, pos, any_value(series_value) AS sv, sum(value) AS rb FROM comp GROUP BY 1, 2) GROUP BY 1),
  dq AS MATERIALIZED (SELECT *, orthogonality * 0.25 + (1 - top3_variance) * 0.20 + reconstruction_error * 0.15 + (1 - mean_quality) * 0.15
    + (1 - reconstruction_correlation) * 0.15 + (1 - seasonality) * 0.10 AS composite
    FROM d1 JOIN d2 USING (station_code) JOIN d3 USING (station_code) JOIN d4 USING (station_code) JOIN d5 USING (station_code)
    JOIN (SELECT station_code, orthogonality FROM p_orth) USING (station_code))"""
_D = ["top3_variance", "top5_variance", "max_correlation", "mean_correlation", "mean_quality", "seasonality", "reconstruction_error",
      "reconstruction_correlation", "orthogonality", "composite"]


@query("decomposition_quality", f"WITH {COMP}, {DQ} SELECT station_code, station, {sel(_D)} FROM dq")
def _(spark, sf):
    return shown(ops.decomposition_quality(comp_cut(spark, sf)), KEYS, _D)


@query("decomposition_acceptance", f"""WITH {COMP}, {DQ}, k AS (SELECT station_code, station, CAST(orthogonality <= 0.1 AS INTEGER) + CAST(top3_variance >= 0.3 AS INTEGER)
   + CAST(reconstruction_error <= 1 AS INTEGER) + CAST(reconstruction_correlation >= 0.8 AS INTEGER) + CAST(mean_quality >= 0.5 AS INTEGER)
   + CAST(seasonality >= 0.1 AS INTEGER) AS checks_passed FROM dq) SELECT *, checks_passed >= 4 AS accepted FROM k""")
def _(spark, sf):
    return ops.decomposition_acceptance(ops.decomposition_quality(comp_cut(spark, sf)))


CHECKS = f"""lgm AS (SELECT *, lag(value) OVER {CW} AS l FROM comp),
  mq AS (SELECT station_code, component, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM comp GROUP BY 1, 2),
  ms AS (SELECT m.station_code, m.station, m.component, count(*) AS n, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_ratio, CAST(0 AS BIGINT) AS infinite,
    var_pop(value) AS variance, avg(CASE WHEN q3 > q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) THEN 1.0 ELSE 0.0 END) AS outlier_ratio,
    coalesce({corr('value', 'l')}, 0.0) AS autocorrelation FROM lgm m JOIN mq ON m.station_code = mq.station_code AND m.component = mq.component GROUP BY 1, 2, 3),
  mw AS (SELECT *, concat_ws(',', CASE WHEN n < 365 THEN 'insufficient_data' END, CASE WHEN infinite > 0 THEN 'infinite_values' END) AS errors,
    concat_ws(',', CASE WHEN missing_ratio > 0.1 THEN 'high_missing' END, CASE WHEN variance < 1e-6 THEN 'low_variance' END,
    CASE WHEN outlier_ratio > 0.05 THEN 'high_outliers' END, CASE WHEN n > 10 AND abs(autocorrelation) < 0.1 THEN 'low_autocorrelation' END) AS warnings FROM ms)"""


@query("model_input_checks", f"""WITH {COMP}, {CHECKS} SELECT {CKS}, n, infinite, {sel(['missing_ratio', 'variance', 'outlier_ratio', 'autocorrelation'])},
  errors, warnings, concat_ws(',', CASE WHEN warnings <> '' THEN 'preprocess' END, CASE WHEN missing_ratio > 0.05 THEN 'impute' END) AS recommendations,
  errors = '' AS is_valid FROM mw""")
def _(spark, sf):
    return shown(ops.model_input_checks(comp_cut(spark, sf)), [*CK, "n", "infinite", "errors", "warnings", "recommendations", "is_valid"],
                 ["missing_ratio", "variance", "outlier_ratio", "autocorrelation"])


@query("model_eligibility", f"""WITH {COMP}, {CHECKS} SELECT {CKS}, component = 5 OR (n >= 365 AND component <= 3 AND variance >= 0.001 AND missing_ratio = 0
  AND infinite = 0 AND abs(autocorrelation) >= 0.1) AS eligible FROM mw""")
def _(spark, sf):
    return ops.model_eligibility(ops.model_input_checks(comp_cut(spark, sf)), F.col("component") == 5)


@query("scaling_choice", f"""WITH {COMP}, {SHAPE} SELECT {CKS}, {sel(['variance', 'complexity'])}, CASE WHEN component = 4 THEN 'none' WHEN component = 5 THEN 'standard'
  WHEN complexity > 0.3 THEN 'robust' WHEN variance < 0.1 THEN 'minmax' ELSE 'standard' END AS scaling FROM p_shape""")
def _(spark, sf):
    model = F.when(F.col("component") == 4, "seasonal").when(F.col("component") == 5, "extrapolation").otherwise("lag")
    return shown(ops.scaling_choice(ops.shape_properties(comp(spark, sf)), model), [*CK, "scaling"], ["variance", "complexity"])


@query("scale_consistency", f"""WITH {COMP}, s AS (SELECT {CKS}, avg(value) AS mean, stddev_pop(value) AS std FROM comp GROUP BY 1, 2, 3)
  SELECT a.station_code, a.station, a.component, {r('a.mean')} AS mean, {r('a.std')} AS std,
   count(*) FILTER (abs(a.std - b.std) / greatest(a.std, 1e-8) > 0.1) AS inconsistent_with,
   count(*) FILTER (abs(a.std - b.std) / greatest(a.std, 1e-8) > 0.1) = 0 AS consistent
  FROM s a JOIN s b ON a.station_code = b.station_code AND a.component <> b.component GROUP BY 1, 2, 3, a.mean, a.std""")
def _(spark, sf):
    return shown(ops.scale_consistency(comp(spark, sf)), [*CK, "inconsistent_with", "consistent"], ["mean", "std"])
