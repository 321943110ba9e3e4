"""Queries for model fits and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.components import CK, CKS, COMP, CW, KEYS, comp, comp_cut, sel
from almanac.catalog.registry import query
from almanac.catalog.sql import FILLED, r
from almanac.functions.expr import long, rnd, shown
from almanac.operators import components as cops
from almanac.operators import forecast as ops
from almanac.operators import models
from almanac.operators.reshape import tail_rows
from almanac.plans.lineage import cut
from almanac.sources import tables as src


@query("recent_tail", f"""WITH {COMP}, k AS (SELECT *, row_number() OVER (PARTITION BY station_code, component ORDER BY date DESC) AS age FROM comp)
  SELECT {CKS}, date, {r('value')} AS value, CAST(age AS INTEGER) AS age FROM k WHERE age <= 365""")
def _(spark, sf):
    return shown(tail_rows(comp(spark, sf), 365, CK), [*CK, "date", "age"], ["value"])


@query("lag_model_fit")
def _(spark, sf):
    return _coef(models.lag_model_fit(comp_cut(spark, sf)))


def _coef(d, extra=()):
    names = ["intercept", *[f"b_lag_{k}" for k in range(1, 8)], "b_mean", "b_std"]
    d = d.select("*", *[F.col("coefficients")[i].alias(n) for i, n in enumerate(names)])
    return shown(d, [*CK, *extra], ["alpha", "train_mse", "test_mse", *names], 6)


@query("lag_model_grid")
def _(spark, sf):
    c = comp_cut(spark, sf)
    return _coef(models.lag_model_grid(c, cops.component_properties(c)), ["tried"])


# the hold-out fifth of the lag design, predicted by the value before
@query("regression_metrics", f"""WITH {FILLED}, l AS (SELECT *, lag(value) OVER (PARTITION BY station_code ORDER BY pos) AS p,
   max(pos) OVER (PARTITION BY station_code) - 7 AS n FROM filled), t AS (SELECT * FROM l WHERE pos > 7 AND pos - 7 > floor(0.8 * n + 1e-9))
  SELECT station_code, station, count(*) AS n, {r('avg(pow(value - p, 2))')} AS mse, {r('sqrt(avg(pow(value - p, 2)))')} AS rmse,
   {r('avg(abs(value - p))')} AS mae, {r('1 - avg(pow(value - p, 2)) / nullif(var_pop(value), 0)')} AS r2,
   {r('avg(abs(value - p) / greatest(abs(value), 1e-8)) * 100')} AS mape FROM t GROUP BY 1, 2""")
def _(spark, sf):
    design = models.lag_design(src.filled(spark, sf), keys=KEYS).filter(F.col("part") == "test")
    d = models.regression_metrics(design.withColumn("p", F.col("x")[0]), "y", "p", KEYS)
    return shown(d, [*KEYS, "n"], ["mse", "rmse", "mae", "r2", "mape"])


@query("lag_model_holdout")
def _(spark, sf):
    c = comp_cut(spark, sf)
    rows = models.predict_rows(models.lag_design(c).filter(F.col("part") == "test"), models.lag_model_fit(c))
    return shown(models.regression_metrics(rows, "y", "predicted", CK), [*CK, "n"], ["mse", "rmse", "mae", "r2", "mape"], 6)


def ar_sql(src_rel):
    """Fit and day-of-year means of the seasonal model on a component relation."""
    return f"""dm AS (SELECT {CKS}, dayofyear(date) AS doy, sum(value) AS t, count(value) AS c FROM {src_rel} GROUP BY 1, 2, 3, 4),
  season AS MATERIALIZED (SELECT {CKS}, doy, t / c - sum(t) OVER (PARTITION BY station_code, component) / sum(c) OVER (PARTITION BY station_code, component) AS seasonal FROM dm),
  rc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_code, component ORDER BY date DESC) AS age FROM {src_rel}) WHERE age <= 367),
  xl AS (SELECT rc.station_code, rc.station, rc.component, rc.date, rc.pos, age, value - seasonal AS x FROM rc JOIN season s
    ON rc.station_code = s.station_code AND rc.component = s.component AND dayofyear(rc.date) = s.doy),
  dl AS (SELECT *, x - lag(x) OVER {CW} AS d FROM xl), dp AS (SELECT *, lag(d) OVER {CW} AS dprev FROM dl),
  arfit AS MATERIALIZED (SELECT {CKS}, count(dprev) AS n, least(greatest(coalesce(regr_slope(d, dprev), 0.0), -0.99), 0.99) AS phi,
    arg_max(x, pos) AS last_level, arg_max(d, pos) AS last_diff, max(date) AS last_date FROM dp WHERE age <= 365 GROUP BY 1, 2, 3)"""


@query("seasonal_ar_fit", f"""WITH {COMP}, {ar_sql('comp')} SELECT {CKS}, n, {sel(['phi', 'last_level', 'last_diff'])}, last_date FROM arfit""")
def _(spark, sf):
    fit, _season = models.seasonal_ar_fit(comp_cut(spark, sf))
    return shown(fit, [*CK, "n", "last_date"], ["phi", "last_level", "last_diff"])


@query("order_selection")
def _(spark, sf):
    return shown(models.order_selection(comp(spark, sf)), [*CK, "p"], ["aic"])


HZ = "CAST(greatest(1, least({d}, floor(n * 0.1 + 1e-9), 60)) AS INTEGER)"


@query("horizon", f"""WITH {FILLED}, h AS (SELECT station_code, station, count(*) AS n, max(date) AS last_date FROM filled GROUP BY 1, 2)
  SELECT *, 21 AS requested, {HZ.format(d=21)} AS steps, CAST(greatest(1, floor(n * 0.2 + 1e-9)) AS INTEGER) AS legacy_steps FROM h""")
def _(spark, sf):
    return ops.horizon(src.filled(spark, sf), max_share=ops.MAX_SHARE, max_steps=ops.MAX_HORIZON)


@query("horizon_long", f"""WITH {FILLED}, h AS (SELECT station_code, station, count(*) AS n, max(date) AS last_date FROM filled GROUP BY 1, 2)
  SELECT *, 90 AS requested, 90 AS steps, CAST(greatest(1, floor(n * 0.2 + 1e-9)) AS INTEGER) AS legacy_steps FROM h""")
def _(spark, sf):
    """Ninety days asked for are ninety days given."""
    return ops.horizon(src.filled(spark, sf), 90)


def future_sql(rel, keys, out, days=21):
    return f"""{out}_h AS (SELECT {keys}, count(*) AS n, max(date) AS ld FROM {rel} GROUP BY ALL),
  {out} AS MATERIALIZED (SELECT {keys}, n, CAST(ld + CAST(k AS INTEGER) AS DATE) AS date, CAST(k AS INTEGER) AS days_ahead
   FROM (SELECT *, unnest(range(1, {HZ.format(d=days)} + 1)) AS k FROM {out}_h))"""


@query("future_dates", f"WITH {FILLED}, {future_sql('filled', 'station_code, station', 'fut')} SELECT * FROM fut")
def _(spark, sf):
    return ops.future_dates(src.filled(spark, sf))


def far_sql(rel, out, days=21):
    return f"""{ar_sql(rel)}, {future_sql(rel, CKS, out + '_f', days)},
  {out} AS MATERIALIZED (SELECT f.station_code, f.station, f.component, f.date, f.days_ahead,
    last_level + last_diff * phi * (1 - pow(phi, days_ahead)) / (1 - phi) + coalesce(seasonal, 0.0) AS value
    FROM {out}_f f JOIN arfit a ON f.station_code = a.station_code AND f.component = a.component
    LEFT JOIN season s ON f.station_code = s.station_code AND f.component = s.component AND dayofyear(f.date) = s.doy)"""


def ftr_sql(rel, out, days=21):
    return f"""{future_sql(rel, CKS, out + '_f', days)},
  {out}_h AS (SELECT station_code, component, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi,
    regr_slope(value, pos) AS slope, regr_intercept(value, pos) AS ic FROM {rel} GROUP BY 1, 2),
  {out}_p AS (SELECT f.*, lo, hi, CASE WHEN s < 0.01 THEN m ELSE ic + slope * (n + days_ahead) END AS p
    FROM {out}_f f JOIN {out}_h h ON f.station_code = h.station_code AND f.component = h.component),
  {out} AS MATERIALIZED (SELECT {CKS}, date, days_ahead, CASE WHEN max(p) OVER w - min(p) OVER w > 1e-9 * (hi - lo)
    THEN (p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w) * (hi - lo) + lo ELSE p END AS value
    FROM {out}_p WINDOW w AS (PARTITION BY station_code, component))"""


_F = f"{CKS}, date, days_ahead"


@query("forecast_ar", f"WITH {COMP}, {far_sql('comp', 'far')} SELECT {_F}, {sel(['value'])} FROM far")
def _(spark, sf):
    return shown(ops.forecast_ar(comp_cut(spark, sf)), [*CK, "date", "days_ahead"], ["value"])


@query("forecast_trend", f"WITH {COMP}, {ftr_sql('comp', 'ftr')} SELECT {_F}, {sel(['value'])} FROM ftr")
def _(spark, sf):
    return shown(ops.forecast_trend(comp_cut(spark, sf)), [*CK, "date", "days_ahead"], ["value"])


@query("forecast_lag")
def _(spark, sf):
    c = comp_cut(spark, sf)
    return shown(ops.forecast_lag(c, models.lag_model_fit(c)), [*CK, "date", "days_ahead"], ["value"])


@query("predict_components")
def _(spark, sf):
    c = comp_cut(spark, sf)
    classes = cut(cops.classify_components(cops.seasonal_model_score(cops.score_inputs(c))))
    d = ops.predict_components(c, classes, models.lag_model_fit(c))
    return shown(d, [*CK, "date", "days_ahead", "model_class", "method"], ["value"])


SIMPLE = f"""c4 AS MATERIALIZED (SELECT * FROM comp WHERE component = 4), cx AS MATERIALIZED (SELECT * FROM comp WHERE component <> 4),
  {far_sql('c4', 'far')}, {ftr_sql('cx', 'ftr')}, parts AS MATERIALIZED (SELECT * FROM far UNION ALL SELECT * FROM ftr)"""
HIST = """hs AS MATERIALIZED (SELECT station_code, avg(value) AS h_mean, stddev_samp(value) AS h_std, min(value) AS h_min, max(value) AS h_max,
   arg_max(value, pos) AS h_last, (arg_max(value, pos) - arg_min(value, pos)) / (count(value) - 1) AS h_trend FROM {rel} GROUP BY 1)"""
RECON = HIST + """,
  tot AS (SELECT station_code, station, date, days_ahead, sum(value) AS v FROM parts GROUP BY 1, 2, 3, 4),
  tm AS (SELECT t.*, avg(v) OVER w AS pm, stddev_pop(v) OVER w AS ps FROM tot t WINDOW w AS (PARTITION BY station_code)),
  tz AS (SELECT t.*, h_mean, h_std, h_min, h_max, h_last, abs(pm - h_mean) / (abs(h_mean) + 1e-8) > 0.5 OR abs(ps - h_std) / (abs(h_std) + 1e-8) > 0.5 AS rescaled
    FROM tm t JOIN hs ON t.station_code = hs.station_code),
  ty AS (SELECT *, CASE WHEN rescaled AND ps > 0 THEN (v - pm) * (h_std / (ps + 1e-8)) + h_mean WHEN rescaled THEN h_mean ELSE v END AS s FROM tz),
  tx AS (SELECT *, CASE WHEN days_ahead = 1 AND abs(s - h_last) > 2 * greatest(h_std, 1.0) THEN 0.7 * h_last + 0.3 * s ELSE s END AS t FROM ty),
  fc AS MATERIALIZED (SELECT station_code, station, date, days_ahead, rescaled, greatest(least(t, h_max + (h_max - h_min) * 0.1), h_min - (h_max - h_min) * 0.1) AS value FROM tx)"""


def _simple(spark, sf):
    history = cut(src.filled(spark, sf))
    c = cut(cops.decompose(history))
    parts = cut(ops.simple_components(c))
    return history, c, parts, ops.reconstruct_forecast(parts, history)


@query("reconstruct_forecast", f"WITH {COMP}, {SIMPLE}, {RECON.format(rel='filled')} SELECT station_code, station, date, {sel(['value'])}, days_ahead, rescaled FROM fc")
def _(spark, sf):
    return long(_simple(spark, sf)[3], "days_ahead", "rescaled")


@query("weighted_reconstruction", f"""WITH {COMP}, {SIMPLE}, iv AS (SELECT station_code, component, 1 / greatest(stddev_pop(value), 1e-8) AS inv FROM comp GROUP BY 1, 2),
  sh AS (SELECT *, inv / sum(inv) OVER (PARTITION BY station_code) AS share FROM iv)
  SELECT p.station_code, p.station, p.date, {r('sum(value * share)')} AS value, p.days_ahead FROM parts p JOIN sh
  ON p.station_code = sh.station_code AND p.component = sh.component GROUP BY 1, 2, 3, 5""")
def _(spark, sf):
    _h, c, parts, _f = _simple(spark, sf)
    return long(ops.weighted_reconstruction(parts, c), "days_ahead")


CI = """pv AS (SELECT station_code, component, var_pop(value) AS v FROM parts GROUP BY 1, 2), ps AS (SELECT station_code, sqrt(sum(v)) AS spread FROM pv GROUP BY 1),
  ci AS MATERIALIZED (SELECT fc.*, value - 1.96 * spread AS lower_ci, value + 1.96 * spread AS upper_ci FROM fc JOIN ps ON fc.station_code = ps.station_code)"""


@query("confidence_interval", f"WITH {COMP}, {SIMPLE}, {RECON.format(rel='filled')}, {CI} SELECT station_code, station, date, days_ahead, {sel(['value', 'lower_ci', 'upper_ci'])} FROM ci")
def _(spark, sf):
    _h, _c, parts, fc = _simple(spark, sf)
    return shown(ops.confidence_interval(fc, parts), [*KEYS, "date", "days_ahead"], ["value", "lower_ci", "upper_ci"])


FQ = """fp AS (SELECT station_code, station, avg(value) AS p_mean, stddev_pop(value) AS p_std, stddev_samp(value) AS p_std_s, count(*) AS prediction_length,
   (arg_max(value, days_ahead) - arg_min(value, days_ahead)) / (count(*) - 1) AS p_trend FROM fc GROUP BY 1, 2),
  fu AS (SELECT station_code, count(DISTINCT component) AS num_components FROM parts GROUP BY 1),
  fe AS (SELECT fp.*, h_mean, h_std, h_trend, num_components, 1 - abs(p_mean - h_mean) / (abs(h_mean) + 1e-8) AS mean_consistency,
    1 - abs(p_std - h_std) / (abs(h_std) + 1e-8) AS std_consistency, 1 - abs(p_trend - h_trend) / (abs(h_trend) + 1e-8) AS trend_consistency,
    p_std / (h_std + 1e-8) AS diversity_score, abs(p_mean - h_mean) / h_std AS scaled_mean_distance,
    coalesce(abs(p_trend - h_trend) / nullif(abs(h_trend), 0), 0.0) AS scaled_trend_distance, p_std_s / h_std AS scaled_diversity
    FROM fp JOIN hs ON fp.station_code = hs.station_code JOIN fu ON fp.station_code = fu.station_code),
  fq AS MATERIALIZED (SELECT *, (mean_consistency + std_consistency + trend_consistency) / 3 AS overall_quality,
    greatest(0.0, 1 - (scaled_mean_distance + scaled_trend_distance) / 2) AS scaled_quality FROM fe)"""
_QN = ["mean_consistency", "std_consistency", "diversity_score", "scaled_mean_distance", "scaled_diversity", "scaled_quality"]
_QL = ["trend_consistency", "overall_quality", "scaled_trend_distance"]  # ratios to a trend near zero: large numbers


@query("forecast_quality", f"WITH {COMP}, {SIMPLE}, {RECON.format(rel='filled')}, {FQ} SELECT station_code, station, {sel(_QN)}, {sel(_QL, 2)}, num_components, prediction_length FROM fq")
def _(spark, sf):
    h, _c, parts, fc = _simple(spark, sf)
    d = ops.forecast_quality(fc, h, parts)
    return d.select(*KEYS, "num_components", "prediction_length", *[rnd(c).alias(c) for c in _QN], *[rnd(c, 2).alias(c) for c in _QL])


def _table(spark, sf):
    h, _c, parts, fc = _simple(spark, sf)
    fc = cut(ops.confidence_interval(fc, parts))
    return ops.predictions_table(h, fc, parts, ops.forecast_quality(fc, h, parts), "temp_max")


_PV = [f"imf_{i}" for i in range(1, 9)]
TABLE = f"""{CI}, {FQ}, sd AS (SELECT station_code, date, {', '.join(f"max(CASE WHEN component = {i} THEN value END) AS imf_{i}" for i in range(1, 9))} FROM parts GROUP BY 1, 2),
  tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY date DESC) AS age FROM filled) WHERE age <= 30),
  pt0 AS (SELECT station_code, station, date, 'historical' AS type, value, {', '.join(f'NULL::DOUBLE AS imf_{i}' for i in range(1, 9))}, NULL::DOUBLE AS lower_ci, NULL::DOUBLE AS upper_ci, NULL::DOUBLE AS confidence_level FROM tl
    UNION ALL SELECT ci.station_code, ci.station, ci.date, 'prediction', value, {', '.join(_PV)}, lower_ci, upper_ci, 0.95 FROM ci LEFT JOIN sd ON ci.station_code = sd.station_code AND ci.date = sd.date),
  pt AS MATERIALIZED (SELECT pt0.*, mean_consistency, trend_consistency, diversity_score, num_components AS num_imfs_used, prediction_length AS prediction_steps, 'temp_max' AS variable_type
    FROM pt0 LEFT JOIN (SELECT station_code, mean_consistency, trend_consistency, diversity_score, num_components, prediction_length FROM fq) q ON pt0.station_code = q.station_code)"""


@query("predictions_table", f"""WITH {COMP}, {SIMPLE}, {RECON.format(rel='filled')}, {TABLE} SELECT station_code, station, date, type, num_imfs_used, prediction_steps, variable_type,
  {sel(['value', *_PV, 'lower_ci', 'upper_ci', 'confidence_level', 'mean_consistency', 'diversity_score'])}, {sel(['trend_consistency'], 2)} FROM pt""")
def _(spark, sf):
    d = _table(spark, sf)
    plain = [*KEYS, "date", "type", "num_imfs_used", "prediction_steps", "variable_type"]
    r4 = ["value", *_PV, "lower_ci", "upper_ci", "confidence_level", "mean_consistency", "diversity_score"]
    return d.select(*plain, *[rnd(c).alias(c) for c in r4], rnd("trend_consistency", 2).alias("trend_consistency"))


@query("prediction_summary", f"""WITH {COMP}, {SIMPLE}, {RECON.format(rel='filled')} SELECT station_code, station, count(*) AS n, min(date) AS first_date, max(date) AS last_date,
  {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('min(value)')} AS min, {r('max(value)')} AS max, {r('quantile_cont(value, 0.5)')} AS median FROM fc GROUP BY 1, 2""")
def _(spark, sf):
    from almanac.operators.stats import prediction_summary
    d = prediction_summary(_table(spark, sf))
    return shown(d, [*KEYS, "n", "first_date", "last_date"], ["mean", "std", "min", "max", "median"])


# the last 28 days held out: fit on what is before them, compare where dates overlap
HELD = """hist AS MATERIALIZED (SELECT f.station_code, f.station, f.date, f.pos, f.value FROM filled f
   JOIN (SELECT station_code, max(pos) AS n FROM filled GROUP BY 1) m ON f.station_code = m.station_code WHERE f.pos <= m.n - 28)"""
COMP_HELD = COMP.replace("lv1 AS (", HELD + ", lv1 AS (", 1).replace("AS level_1 FROM filled)", "AS level_1 FROM hist)")


@query("overlap_residuals", f"""WITH {COMP_HELD}, {SIMPLE}, {RECON.format(rel='hist')} SELECT fc.station_code, fc.station, fc.date, {r('f.value')} AS actual,
  {r('fc.value')} AS predicted, {r('f.value - fc.value')} AS residual FROM fc JOIN filled f ON fc.station_code = f.station_code AND fc.date = f.date""")
def _(spark, sf):
    whole = cut(src.filled(spark, sf))
    n = whole.groupBy(*KEYS).agg(F.max("pos").alias("n"))
    hist = cut(whole.join(n, KEYS).filter(F.col("pos") <= F.col("n") - 28).drop("n"))
    parts = cut(ops.simple_components(cut(cops.decompose(hist))))
    d = ops.overlap_residuals(whole, ops.reconstruct_forecast(parts, hist))
    return shown(d, [*KEYS, "date"], ["actual", "predicted", "residual"])
