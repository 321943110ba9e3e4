"""Queries for missing blocks and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.registry import query
from almanac.catalog.sql import DAILY, DAILY_SPARSE, LINEAR, linear, near, r
from almanac.functions.expr import long, rnd, shown
from almanac.operators import impute as ops
from almanac.operators import splines
from almanac.plans.lineage import cut
from almanac.sources import tables as src


BLOCKS = """runs AS (SELECT *, pos - row_number() OVER (PARTITION BY station_code ORDER BY pos) AS grp
    FROM daily WHERE value IS NULL),
  blk AS (SELECT station_code, station, min(pos) AS start_pos, max(pos) AS end_pos, min(date) AS start_date,
    max(date) AS end_date, count(*) AS length FROM runs GROUP BY station_code, station, grp),
  blocks AS MATERIALIZED (SELECT *, CASE WHEN length <= 3 THEN 'small' WHEN length <= 30 THEN 'medium' ELSE 'large' END AS block_class
    FROM blk)"""


@query("missing_blocks", f"WITH {DAILY_SPARSE}, {BLOCKS} SELECT * FROM blocks")
def _(spark, sf):
    return ops.missing_blocks(src.daily_sparse(spark, sf))


@query("classify_blocks", f"""WITH {DAILY_SPARSE}, {BLOCKS} SELECT station_code, station, block_class,
  count(*) AS n_blocks, CAST(sum(length) AS BIGINT) AS missing_rows, max(length) AS longest
  FROM blocks GROUP BY 1, 2, 3""")
def _(spark, sf):
    return ops.classify_blocks(src.daily_sparse(spark, sf))


TRIM = """cuts AS (SELECT station_code, max(end_pos) AS cut_pos, count(*) AS blocks_removed FROM blocks
    WHERE length > 30 GROUP BY 1),
  trimmed AS MATERIALIZED (SELECT d.station_code, d.station, d.date, d.value, d.pos - coalesce(cut_pos, 0) AS pos,
    coalesce(blocks_removed, 0) AS blocks_removed
    FROM daily d LEFT JOIN cuts c ON d.station_code = c.station_code WHERE d.pos > coalesce(cut_pos, 0))"""


@query("trim_large_blocks", f"""WITH {DAILY_SPARSE}, {BLOCKS}, {TRIM}
  SELECT station_code, station, date, {r('value')} AS value, pos, blocks_removed FROM trimmed""")
def _(spark, sf):
    return long(ops.trim_large_blocks(src.daily_sparse(spark, sf), 30), "pos", "blocks_removed")


def _fill(expr):
    return f"""WITH {DAILY_SPARSE}, {near('daily', 'nb')}
      SELECT station_code, station, date, {r(expr)} AS value, value IS NULL AS imputed FROM nb"""


@query("impute_linear", _fill(f"coalesce({LINEAR}, prev_value, next_value)"))
def _(spark, sf):
    return long(ops.impute_linear(src.daily_sparse(spark, sf)), "imputed")


# a calendar that starts and ends with gaps: values missing in each station's first and last ten days
EDGED = """edged AS MATERIALIZED (SELECT d.station_code, d.station, d.date, d.pos,
    CASE WHEN d.pos > 10 AND d.pos <= m.n - 10 THEN d.value END AS value
  FROM daily d JOIN (SELECT station_code, max(pos) AS n FROM daily GROUP BY 1) m ON d.station_code = m.station_code)"""


def _edged(spark, sf):
    d = src.daily_sparse(spark, sf)
    n = d.groupBy("station_code").agg(F.max("pos").alias("n"))
    inside = (F.col("pos") > 10) & (F.col("pos") <= F.col("n") - 10)
    return d.join(n, "station_code").withColumn("value", F.when(inside, F.col("value"))).drop("n")


def _fill_edged(expr, imputed):
    return f"""WITH {DAILY_SPARSE}, {EDGED}, {near('edged', 'nb')}
      SELECT station_code, station, date, {r(expr)} AS value, {imputed} AS imputed FROM nb"""


@query("impute_linear_forward", _fill_edged(f"coalesce({LINEAR}, prev_value)", "value IS NULL AND prev_value IS NOT NULL"))
def _(spark, sf):
    return long(ops.impute_linear_forward(_edged(spark, sf)), "imputed")


@query("impute_ffill", _fill_edged("prev_value", "value IS NULL"))
def _(spark, sf):
    return long(ops.impute_ffill(_edged(spark, sf)), "imputed")


@query("impute_bfill", _fill_edged("next_value", "value IS NULL"))
def _(spark, sf):
    return long(ops.impute_bfill(_edged(spark, sf)), "imputed")


def _fill_stat(agg):
    return f"""WITH {DAILY_SPARSE}, m AS (SELECT station_code, {agg} AS fill FROM daily GROUP BY 1)
      SELECT d.station_code, d.station, d.date, {r('coalesce(value, fill)')} AS value, value IS NULL AS imputed
      FROM daily d JOIN m ON d.station_code = m.station_code"""


@query("impute_mean", _fill_stat("avg(value)"))
def _(spark, sf):
    return long(ops.impute_mean(src.daily_sparse(spark, sf)), "imputed")


@query("impute_median", _fill_stat("quantile_cont(value, 0.5)"))
def _(spark, sf):
    return long(ops.impute_median(src.daily_sparse(spark, sf)), "imputed")


THREE = """older AS (SELECT *, CASE WHEN value IS NOT NULL THEN pos END AS kp,
    CASE WHEN value IS NOT NULL THEN last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER w END AS op,
    CASE WHEN value IS NOT NULL THEN last_value(value IGNORE NULLS) OVER w END AS ov
    FROM {src} WINDOW w AS (PARTITION BY station_code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  three AS MATERIALIZED (SELECT * EXCLUDE (kp, op, ov),
    last_value(kp IGNORE NULLS) OVER b AS prev_pos, last_value(value IGNORE NULLS) OVER b AS prev_value,
    max(op) OVER b AS prev2_pos, last_value(ov IGNORE NULLS) OVER b AS prev2_value,
    first_value(kp IGNORE NULLS) OVER a AS next_pos, first_value(value IGNORE NULLS) OVER a AS next_value
    FROM older
    WINDOW b AS (PARTITION BY station_code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      a AS (PARTITION BY station_code ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  slopes AS (SELECT *, (prev_value - prev2_value) / CAST(prev_pos - prev2_pos AS DOUBLE) AS d01,
    (next_value - prev_value) / nullif(CAST(next_pos - prev_pos AS DOUBLE), 0) AS d12 FROM three),
  poly AS MATERIALIZED (SELECT *, CASE WHEN value IS NOT NULL THEN value ELSE
    prev_value + (pos - prev_pos) * d12 + (pos - prev_pos) * (pos - next_pos)
      * ((d12 - d01) / CAST(next_pos - prev2_pos AS DOUBLE)) END AS quad FROM slopes)"""


@query("impute_polynomial", f"""WITH {DAILY_SPARSE}, {THREE.format(src='daily')}
  SELECT station_code, station, date, {r(f'coalesce(quad, {LINEAR}, prev_value, next_value)')} AS value,
    value IS NULL AS imputed FROM poly""")
def _(spark, sf):
    return long(ops.impute_polynomial(src.daily_sparse(spark, sf)), "imputed")


DECOMP = """tr AS (SELECT *, (dayofyear(date) - 1) % 365 AS phase,
    CASE WHEN count(*) OVER w = 365 THEN avg(value) OVER w END AS trend
    FROM {src} WINDOW w AS (PARTITION BY station_code ORDER BY pos ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)),
  ph AS (SELECT station_code, phase, avg(value - trend) AS raw FROM tr GROUP BY 1, 2),
  pn AS (SELECT *, last_value(CASE WHEN raw IS NOT NULL THEN phase END IGNORE NULLS) OVER b AS bp, last_value(raw IGNORE NULLS) OVER b AS bv,
    first_value(CASE WHEN raw IS NOT NULL THEN phase END IGNORE NULLS) OVER a AS ap, first_value(raw IGNORE NULLS) OVER a AS av FROM ph
    WINDOW b AS (PARTITION BY station_code ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      a AS (PARTITION BY station_code ORDER BY phase ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  pc AS (SELECT *, coalesce(raw, bv + (av - bv) * (CAST(phase - bp AS DOUBLE) / nullif(CAST(ap - bp AS DOUBLE), 0)), bv, av, 0.0) AS cycle FROM pn),
  ce AS (SELECT station_code, phase, cycle - avg(cycle) OVER (PARTITION BY station_code) AS seasonal FROM pc),
  decomp AS MATERIALIZED (SELECT tr.*, seasonal, value - trend - seasonal AS resid
    FROM tr JOIN ce ON tr.station_code = ce.station_code AND tr.phase = ce.phase)"""


@query("seasonal_decompose", f"""WITH {DAILY}, {linear('daily', 'filled')}, {DECOMP.format(src='filled')}
  SELECT station_code, station, date, {r('trend')} AS trend, {r('seasonal')} AS seasonal, {r('resid')} AS resid
  FROM decomp""")
def _(spark, sf):
    d = ops.seasonal_decompose(src.filled(spark, sf))
    return d.select("station_code", "station", "date", *[rnd(c).alias(c) for c in ("trend", "seasonal", "resid")])


SEAS = DECOMP.format(src="daily") + f""",
  tn AS (SELECT *, CASE WHEN trend IS NOT NULL THEN pos END AS tp, CASE WHEN value IS NOT NULL THEN pos END AS vp FROM decomp),
  tf AS (SELECT *, last_value(tp IGNORE NULLS) OVER b AS bp, last_value(trend IGNORE NULLS) OVER b AS bv,
    first_value(tp IGNORE NULLS) OVER a AS ap, first_value(trend IGNORE NULLS) OVER a AS av,
    last_value(vp IGNORE NULLS) OVER b AS last_known FROM tn
    WINDOW b AS (PARTITION BY station_code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      a AS (PARTITION BY station_code ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  tg AS (SELECT *, coalesce(trend, bv + (av - bv) * (CAST(pos - bp AS DOUBLE) / nullif(CAST(ap - bp AS DOUBLE), 0)), bv, av)
    AS trend_full FROM tf),
  rs AS (SELECT *, value - trend_full - seasonal AS res FROM tg),
  rl AS (SELECT *, lag(res) OVER w AS res_lag,
    last_value(res IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS res_before
    FROM rs WINDOW w AS (PARTITION BY station_code ORDER BY pos)),
  ar AS (SELECT station_code, regr_slope(res, res_lag) AS phi, count(value) AS n_known, count(res_lag) AS n_pairs
    FROM rl GROUP BY 1),
  seas AS MATERIALIZED (SELECT rl.station_code, rl.pos, n_known, CASE WHEN n_known >= {{need}} THEN trend_full + seasonal
     + CASE WHEN n_pairs >= 50 AND res_before IS NOT NULL
       THEN res_before * pow(least(greatest(phi, -0.99), 0.99), pos - last_known) ELSE 0.0 END END AS seas_value
    FROM rl JOIN ar ON rl.station_code = ar.station_code)"""


@query("impute_seasonal", f"""WITH {DAILY_SPARSE}, {THREE.format(src='daily')}, {SEAS.format(need=730)}
  SELECT station_code, p.station, p.date,
    {r(f'coalesce(p.value, seas_value, quad, {LINEAR}, prev_value, next_value)', 2)} AS value, p.value IS NULL AS imputed
  FROM poly p JOIN seas s USING (station_code, pos)""")
def _(spark, sf):
    d = ops.impute_seasonal(src.daily_sparse(spark, sf))
    return shown(d, ["station_code", "station", "date", "imputed"], ["value"], 2)


@query("impute_auto", f"""WITH {DAILY_SPARSE}, {THREE.format(src='daily')}, {SEAS.format(need=730)},
  c AS (SELECT p.*, seas_value, n_known, coalesce(next_pos, max(pos) OVER (PARTITION BY p.station_code) + 1) - coalesce(prev_pos, 0) - 1 AS len
    FROM poly p JOIN seas s USING (station_code, pos)),
  k AS (SELECT *, CASE WHEN value IS NULL THEN CASE WHEN n_known < 30 THEN 'medium' WHEN len <= 3 THEN 'small'
    WHEN len <= 30 THEN 'medium' ELSE 'large' END END AS fill_class FROM c)
  SELECT station_code, station, date, fill_class,
    {r(f'''coalesce(value, CASE fill_class WHEN 'small' THEN {LINEAR} WHEN 'medium' THEN quad
       ELSE coalesce(seas_value, quad) END, {LINEAR}, prev_value, next_value)''', 2)} AS value,
    value IS NULL AS imputed FROM k""")
def _(spark, sf):
    d = ops.impute_auto(src.daily_sparse(spark, sf))
    return shown(d, ["station_code", "station", "date", "fill_class", "imputed"], ["value"], 2)


@query("impute_auto_edges", f"""WITH {DAILY_SPARSE}, f AS (SELECT station_code, min(pos) AS lo, max(pos) AS hi FROM daily GROUP BY 1),
  len AS (SELECT station_code, CASE station_code % 3 WHEN 0 THEN 2 WHEN 1 THEN 20 ELSE 60 END AS k, lo, hi FROM f),
  gap AS (SELECT d.station_code, d.station, d.date, k, pos > hi - k AS at_end, pos < lo + k AS at_start FROM daily d JOIN len USING (station_code))
  SELECT station_code, station, date, CASE WHEN k <= 3 THEN 'small' WHEN k <= 30 THEN 'medium' ELSE 'large' END AS fill_class
  FROM gap WHERE at_end OR at_start""")
def _(spark, sf):
    """Stations whose first and last 2, 20 or 60 rows are missing: the gaps are classed by their own length."""
    d = src.daily_sparse(spark, sf)
    ends = d.groupBy("station_code").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    k = F.when(F.col("station_code") % 3 == 0, 2).when(F.col("station_code") % 3 == 1, 20).otherwise(60)
    cut_off = d.join(ends, "station_code").withColumn("k", k)
    edge = (F.col("pos") > F.col("hi") - F.col("k")) | (F.col("pos") < F.col("lo") + F.col("k"))
    # All other rows are known, so that the edges are gaps of exactly that length.
    dirty = cut_off.withColumn("edge", edge).withColumn("value", F.when(~F.col("edge"), F.coalesce("value", F.lit(1.0)))).drop("lo", "hi", "k")
    done = ops.impute_auto(dirty.drop("edge"))
    return done.where("fill_class IS NOT NULL").select("station_code", "station", "date", "fill_class")


REPORT = f"""{BLOCKS}, {TRIM}, {linear('trimmed', 'done')},
  b AS (SELECT station_code, station, count(*) AS total_count, count(*) - count(value) AS original_missing FROM daily GROUP BY 1, 2),
  t AS (SELECT station_code, count(*) AS cleaned_count, count(*) - count(value) AS cleaned_missing FROM trimmed GROUP BY 1),
  d AS (SELECT station_code, count(*) FILTER (imputed AND value IS NOT NULL) AS imputed_count,
    count(*) - count(value) AS remaining_missing FROM done GROUP BY 1),
  j AS (SELECT b.*, coalesce(cleaned_count, 0) AS cleaned_count, coalesce(cleaned_missing, 0) AS cleaned_missing,
    coalesce(imputed_count, 0) AS imputed_count, coalesce(remaining_missing, 0) AS remaining_missing
    FROM b LEFT JOIN t ON b.station_code = t.station_code LEFT JOIN d ON b.station_code = d.station_code),
  report AS MATERIALIZED (SELECT *, total_count - cleaned_count AS rows_removed,
    {r('''CAST(original_missing AS DOUBLE) / total_count * 100''', 2)} AS missing_pct,
    {r('''coalesce(CAST(imputed_count AS DOUBLE) / nullif(cleaned_missing, 0), 0.0) * 100''', 2)} AS imputed_pct,
    CASE WHEN original_missing = 0 THEN 'none' WHEN cleaned_missing = 0 THEN 'cleaning_only' ELSE 'linear' END AS method,
    CASE WHEN cleaned_count = 0 THEN 'failed' WHEN remaining_missing > 0 THEN 'partial' ELSE 'success' END AS status FROM j)"""


def _report(spark, sf):
    d = src.daily_sparse(spark, sf)
    trimmed = ops.trim_large_blocks(d, 30)
    return ops.imputation_report(d, trimmed, ops.impute_linear(trimmed), "linear")


@query("imputation_report", f"WITH {DAILY_SPARSE}, {REPORT} SELECT * FROM report")
def _(spark, sf):
    return _report(spark, sf)


@query("imputation_summary", f"""WITH {DAILY_SPARSE}, {REPORT}
  SELECT coalesce(method, 'all') AS method, count(*) AS total_stations,
    count(*) FILTER (status = 'success') AS successful_stations,
    CAST(sum(original_missing) AS BIGINT) AS total_original_missing, CAST(sum(imputed_count) AS BIGINT) AS total_imputed,
    max(original_missing) AS max_missing, min(original_missing) AS min_missing, {r('avg(original_missing)', 2)} AS avg_missing,
    max(imputed_count) AS max_imputed, min(imputed_count) AS min_imputed, {r('avg(imputed_count)', 2)} AS avg_imputed,
    {r('''CAST(count(*) FILTER (status = 'success') AS DOUBLE) / count(*) * 100''', 2)} AS success_rate,
    {r('''coalesce(CAST(sum(imputed_count) AS DOUBLE) / nullif(CAST(sum(original_missing) AS DOUBLE), 0), 0.0) * 100''', 2)} AS overall_imputation_rate
  FROM report GROUP BY ROLLUP (method)""")
def _(spark, sf):
    return ops.imputation_summary(_report(spark, sf))


# The system's rows one after the other: eliminated forwards, then filled in backwards.
SPLINE = f"""{DAILY_SPARSE},
  kn AS MATERIALIZED (SELECT station_code, CAST(pos AS DOUBLE) AS x, value AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY station_code) AS n,
    lag(CAST(pos AS DOUBLE)) OVER w AS xb, lag(value) OVER w AS yb, lead(CAST(pos AS DOUBLE)) OVER w AS xa, lead(value) OVER w AS ya
    FROM daily WHERE value IS NOT NULL WINDOW w AS (PARTITION BY station_code ORDER BY pos)),
  eq AS MATERIALIZED (SELECT *, xa - x AS h, (ya - y) / (xa - x) AS s, CASE WHEN i = 2 THEN 4 ELSE 3 END * (x - xb) + CASE WHEN i = n - 1 THEN 4 ELSE 3 END * (xa - x) AS d,
    4 * ((ya - y) / (xa - x) - (y - yb) / (x - xb)) AS r, x - xb AS hb FROM kn WHERE i > 1 AND i < n),
  fw AS (
   SELECT station_code, i, d AS p, r AS q FROM eq WHERE i = 2
   UNION ALL SELECT e.station_code, e.i, e.d - e.hb * e.hb / p, e.r - e.hb * q / p FROM fw JOIN eq e ON e.station_code = fw.station_code AND e.i = fw.i + 1),
  fe AS MATERIALIZED (SELECT fw.*, h, n FROM fw JOIN eq USING (station_code, i)),
  bw AS (
   SELECT station_code, i, q / p AS c FROM fe WHERE i = n - 1
   UNION ALL SELECT f.station_code, f.i, (f.q - f.h * c) / f.p FROM bw JOIN fe f ON f.station_code = bw.station_code AND f.i = bw.i - 1),
  pc AS MATERIALIZED (SELECT e.station_code, e.i, e.n, e.x, e.y, b.c, CASE WHEN e.i = e.n - 1 THEN e.s - b.c * e.h ELSE e.s - (3 * b.c + a.c) * e.h / 4 END AS b
    FROM eq e JOIN bw b ON b.station_code = e.station_code AND b.i = e.i LEFT JOIN bw a ON a.station_code = e.station_code AND a.i = e.i + 1),
  {near('daily', 'nr')},
  placed AS (SELECT nr.*, least(greatest(CASE WHEN 2 * pos < prev_pos + next_pos THEN k.i ELSE k.i + 1 END, 2), k.n - 1) AS i
    FROM nr LEFT JOIN kn k ON k.station_code = nr.station_code AND k.x = nr.prev_pos)"""


@query("impute_spline", f"""WITH RECURSIVE {SPLINE}
  SELECT t.station_code, station, date, value IS NULL AS imputed,
   {r(f'coalesce(value, CASE WHEN next_pos IS NOT NULL THEN p.y + p.b * (pos - p.x) + p.c * pow(pos - p.x, 2) END, {LINEAR}, prev_value, next_value)', 2)} AS value
  FROM placed t LEFT JOIN pc p ON p.station_code = t.station_code AND p.i = t.i""")
def _(spark, sf):
    d = splines.impute_spline(cut(src.daily_sparse(spark, sf)), size=300)
    return shown(d, ["station_code", "station", "date", "imputed"], ["value"], 2)
