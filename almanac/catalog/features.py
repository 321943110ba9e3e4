"""Queries for window features, weights, samples and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.registry import query
from almanac.catalog.sql import FILLED, corr, r
from almanac.functions.expr import long, rnd, shown
from almanac.operators import features as ops
from almanac.operators.reshape import tail_rows
from almanac.sources import tables as src

ID = ["station_code", "station", "date"]
KEYS = ["station_code", "station"]
W = "(PARTITION BY station_code ORDER BY pos)"


def cols_sql(names, digits=4):
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


@query("lag_features", f"WITH {FILLED}, l AS (SELECT *, " + ", ".join(
    f"lag(value, {k}) OVER {W} AS lag_{k}" for k in range(1, 8)) + f""" FROM filled)
  SELECT station_code, station, date, {r('value')} AS target, {cols_sql([f'lag_{k}' for k in range(1, 8)])} FROM l WHERE lag_7 IS NOT NULL""")
def _(spark, sf):
    return shown(ops.lag_features(src.filled(spark, sf)), ID, ["target", *[f"lag_{k}" for k in range(1, 8)]])


def _pct(n, p):
    rank = (n - 1) * p / 100.0
    lo = int(rank)
    return f"(s{n}[{lo + 1}] + (s{n}[{min(lo + 2, n)}] - s{n}[{lo + 1}]) * {rank - lo!r})"


def _rolling_sql(windows):
    lists = ", ".join(
        f"list(value) OVER (PARTITION BY station_code ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS l{n}, "
        f"avg(value) OVER (PARTITION BY station_code ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}, "
        f"stddev_pop(value) OVER (PARTITION BY station_code ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS d{n}, "
        f"sum(rise) OVER (PARTITION BY station_code ORDER BY pos ROWS BETWEEN {n - 2} PRECEDING AND CURRENT ROW) AS u{n}"
        for n in windows)
    outs = []
    for n in windows:
        def z(e):
            return f"CASE WHEN pos >= {n} THEN {e} ELSE 0.0 END"
        def moment(k, off):
            return f"CASE WHEN pos >= {n} AND d{n} > 1e-9 THEN list_avg(list_transform(l{n}, lambda x: pow((x - m{n}) / d{n}, {k}))) - {off} ELSE 0.0 END"
        vals = {"mean": z(f"m{n}"), "std": z(f"d{n}"), "min": z(f"s{n}[1]"), "max": z(f"s{n}[-1]"), "range": z(f"s{n}[-1] - s{n}[1]"),
                "median": z(_pct(n, 50)), "skew": moment(3, "0.0"), "kurt": moment(4, "3.0"),
                **{f"p{p}": z(_pct(n, p)) for p in ops.PERCENTILES}, "var": z(f"d{n} * d{n}"),
                "mad": z(f"list_avg(list_transform(l{n}, lambda x: abs(x - m{n})))"), "up": z(f"CAST(u{n} AS DOUBLE) / {n - 1}")}
        outs += [f"{r(e)} AS {k}_{n}" for k, e in vals.items()]
    srt = ", ".join(f"list_sort(l{n}) AS s{n}" for n in windows)
    return f"""WITH {FILLED}, rises AS (SELECT *, CASE WHEN value > lag(value) OVER {W} THEN 1 ELSE 0 END AS rise FROM filled),
      fr AS (SELECT *, {lists} FROM rises), so AS (SELECT *, {srt} FROM fr)
      SELECT station_code, station, date, {', '.join(outs)} FROM so"""


@query("rolling_stats", _rolling_sql(ops.ROLLING))
def _(spark, sf):
    names = [f"{c}_{n}" for n in ops.ROLLING for c in ops.ROLLING_NAMES]
    return shown(ops.rolling_stats(src.filled(spark, sf)), ID, names)


@query("rolling_mean_std7", f"""WITH {FILLED}, a AS (SELECT station_code, avg(value) AS m, stddev_pop(value) AS s FROM filled GROUP BY 1),
  w AS (SELECT *, avg(value) OVER f AS m7, stddev_pop(value) OVER f AS s7 FROM filled
   WINDOW f AS (PARTITION BY station_code ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
  SELECT station_code, station, date, {r('CASE WHEN pos > 7 THEN m7 ELSE m END')} AS rolling_mean,
   {r('CASE WHEN pos > 7 THEN s7 ELSE s END')} AS rolling_std FROM w JOIN a USING (station_code)""")
def _(spark, sf):
    return shown(ops.rolling_mean_std7(src.filled(spark, sf)), ID, ["rolling_mean", "rolling_std"])


_SP = ("mean", "std", "max", "min", "range", "autocorr")


@query("seasonal_pattern", f"""WITH {FILLED}, ph AS (SELECT station_code, station, period, (pos - 1) % period AS phase, avg(value) AS m, count(*) AS c
   FROM filled, (VALUES (7), (30), (365)) p(period) GROUP BY ALL),
  lg AS (SELECT *, lag(m) OVER (PARTITION BY station_code, period ORDER BY phase) AS b FROM ph),
  st AS (SELECT station_code, station, period, sum(c) AS n, avg(m) AS mean, stddev_pop(m) AS std, max(m) AS max, min(m) AS min,
   max(m) - min(m) AS "range", {corr('m', 'b')} AS autocorr FROM lg GROUP BY ALL)
  SELECT station_code, station, period, {', '.join(f'''{r(f'CASE WHEN n >= 2 * period THEN coalesce("{c}", 0.0) ELSE 0.0 END')} AS seasonal_{c}''' for c in _SP)} FROM st""")
def _(spark, sf):
    return shown(ops.seasonal_pattern(src.filled(spark, sf)), [*KEYS, "period"], [f"seasonal_{c}" for c in _SP])


def _trend_sql():
    fr, out = [], []
    for n in ops.TREND:
        f = f"(PARTITION BY station_code ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        fr.append(f"list(value) OVER {f} AS l{n}, avg(value) OVER {f} AS m{n}, var_pop(value) OVER {f} AS vp{n}")
        h, mu2 = (n - 1) / 2, (n * n - 1) / 12
        suu, quart = n * mu2, n * (n * n - 1) * (n * n - 4) / 180
        sl = f"(list_sum(list_transform(l{n}, lambda x, i: (i - 1 - {h}) * x)) / {suu!r})"
        qa = f"(list_sum(list_transform(l{n}, lambda x, i: (pow(i - 1 - {h}, 2) - {mu2!r}) * (x - m{n}))) / {quart!r})"
        z = lambda e, n=n: f"CASE WHEN pos >= {n} THEN {e} ELSE 0.0 END"
        vals = {"slope": z(sl), "intercept": z(f"m{n} - {sl} * {h}"), "quad_a": z(qa), "quad_b": z(f"{sl} - {qa} * {n - 1}"),
                "r2": f"CASE WHEN pos >= {n} AND vp{n} > 1e-18 THEN pow({sl}, 2) * {suu!r} / (vp{n} * {n}) ELSE 0.0 END",
                "direction": f"CASE WHEN pos < {n} THEN 0.0 WHEN {sl} > 1e-9 THEN 1.0 ELSE -1.0 END"}
        out += [f"{r(e)} AS {k}_{n}" for k, e in vals.items()]
    return f"WITH {FILLED}, fr AS (SELECT *, {', '.join(fr)} FROM filled) SELECT station_code, station, date, {', '.join(out)} FROM fr"


@query("trend_window", _trend_sql())
def _(spark, sf):
    return shown(ops.trend_window(src.filled(spark, sf)), ID, [f"{c}_{n}" for n in ops.TREND for c in ops.TREND_NAMES])


def _vol_sql():
    fr, out = [], []
    for n in ops.VOLATILITY:
        f = f"(PARTITION BY station_code ORDER BY pos ROWS BETWEEN {n - 2} PRECEDING AND CURRENT ROW)"
        fr.append(f"list(ret) OVER {f} AS l{n}, avg(ret) OVER {f} AS m{n}, stddev_pop(ret) OVER {f} AS d{n}, var_pop(ret) OVER {f} AS v{n}, "
                  f"avg(abs(ret)) OVER {f} AS ma{n}, max(abs(ret)) OVER {f} AS mx{n}, avg(ret * ret) OVER {f} AS ms{n}, stddev_pop(ret * ret) OVER {f} AS ds{n}")
        mom = lambda k, off, n=n: f"CASE WHEN pos >= {n} AND d{n} > 1e-9 THEN list_avg(list_transform(l{n}, lambda x: pow((x - m{n}) / d{n}, {k}))) - {off} ELSE 0.0 END"
        z = lambda e, n=n: f"CASE WHEN pos >= {n} THEN {e} ELSE 0.0 END"
        vals = {"std": z(f"d{n}"), "mean_abs": z(f"ma{n}"), "max_abs": z(f"mx{n}"), "var": z(f"v{n}"), "skew": mom(3, "0.0"),
                "kurt": mom(4, "3.0"), "mean_sq": z(f"ms{n}"), "std_sq": z(f"ds{n}")}
        out += [f"{r(e)} AS {k}_{n}" for k, e in vals.items()]
    return f"""WITH {FILLED}, re AS (SELECT *, (value - lag(value) OVER {W}) / lag(value) OVER {W} AS ret FROM filled),
      fr AS (SELECT *, {', '.join(fr)} FROM re) SELECT station_code, station, date, {', '.join(out)} FROM fr"""


@query("volatility", _vol_sql())
def _(spark, sf):
    return shown(ops.volatility(src.filled(spark, sf)), ID, [f"{c}_{n}" for n in ops.VOLATILITY for c in ops.VOLATILITY_NAMES])


def _mom_sql():
    lags, out = [], []
    for n in ops.MOMENTUM:
        lags.append(f"lag(value, {n}) OVER {W} AS a{n}, lag(value, {2 * n}) OVER {W} AS b{n}, sum(rise) OVER "
                    f"(PARTITION BY station_code ORDER BY pos ROWS BETWEEN {max(n - 2, 0)} PRECEDING AND CURRENT ROW) AS u{n}")
        roc = f"coalesce((value - a{n}) / nullif(a{n}, 0), 0.0)"
        out += [f"{r(f'CASE WHEN pos >= {n + 1} THEN {roc} ELSE 0.0 END')} AS roc_{n}",
                f"{r(f'CASE WHEN pos >= {2 * n + 1} THEN {roc} - coalesce((a{n} - b{n}) / nullif(b{n}, 0), 0.0) ELSE 0.0 END')} AS accel_{n}",
                f"{r(f'CASE WHEN pos >= {n + 1} THEN CAST(u{n} AS DOUBLE) / {n - 1} ELSE 0.0 END' if n > 1 else '0.0')} AS strength_{n}"]
    return f"""WITH {FILLED}, ri AS (SELECT *, CASE WHEN value > lag(value) OVER {W} THEN 1 ELSE 0 END AS rise FROM filled),
      la AS (SELECT *, {', '.join(lags)} FROM ri) SELECT station_code, station, date, {', '.join(out)} FROM la"""


@query("momentum", _mom_sql())
def _(spark, sf):
    return shown(ops.momentum(src.filled(spark, sf)), ID, [f"{c}_{n}" for n in ops.MOMENTUM for c in ops.MOMENTUM_NAMES])


@query("position_stats", f"""WITH {FILLED},
  g AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3
    FROM filled WINDOW w AS (PARTITION BY station_code ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT a.station_code, a.pos, avg(CASE WHEN b.value < a.value THEN 1.0 ELSE 0.0 END) AS rk
    FROM filled a JOIN filled b ON a.station_code = b.station_code AND b.pos <= a.pos WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2)
  SELECT g.station_code, station, date, {r('CASE WHEN s > 1e-9 THEN (value - m) / s ELSE 0.0 END')} AS z_score,
   {r('coalesce(s / nullif(m, 0), 0.0)')} AS coef_variation, {r('rk')} AS percentile_rank,
   CAST(CASE WHEN value IS NOT NULL THEN CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END END AS INTEGER) AS is_outlier
  FROM g LEFT JOIN k ON g.station_code = k.station_code AND g.pos = k.pos""")
def _(spark, sf):
    return shown(ops.position_stats(src.filled(spark, sf)), [*ID, "is_outlier"], ["z_score", "coef_variation", "percentile_rank"])


@query("entropy", f"""WITH {FILLED}, b AS (SELECT station_code, min(value) AS lo, max(value) AS hi, count(*) AS n, least(10, count(*) // 10) AS bins FROM filled GROUP BY 1),
  c AS (SELECT f.station_code, station, n, least(floor((value - lo) / ((hi - lo) / bins)), bins - 1) AS bin, count(*) AS c
    FROM filled f JOIN b ON f.station_code = b.station_code GROUP BY ALL)
  SELECT station_code, station, n, count(*) AS bins_used, {r('sum(-(CAST(c AS DOUBLE) / n) * ln(CAST(c AS DOUBLE) / n))')} AS entropy FROM c GROUP BY 1, 2, 3""")
def _(spark, sf):
    return shown(ops.entropy(src.filled(spark, sf)), [*KEYS, "n", "bins_used"], ["entropy"])


@query("autocorrelation", f"WITH {FILLED}, l AS (SELECT *, " + ", ".join(f"lag(value, {k}) OVER {W} AS l{k}" for k in ops.LAGS) +
       " FROM filled) SELECT station_code, station, " + ", ".join(f"{r(corr('value', f'l{k}'))} AS ac_{k}" for k in ops.LAGS) +
       " FROM l GROUP BY 1, 2")
def _(spark, sf):
    return shown(ops.lag_correlations(src.filled(spark, sf), ops.LAGS), KEYS, [f"ac_{k}" for k in ops.LAGS])


@query("dominant_period", f"""WITH {FILLED}, p AS (SELECT a.station_code, a.station, g.lag, a.value AS x, b.value AS y
    FROM filled a, (SELECT unnest(range(1, 20)) AS lag) g, filled b WHERE b.station_code = a.station_code AND b.pos = a.pos - g.lag),
  c AS (SELECT station_code, station, lag, coalesce({corr('x', 'y')}, 0.0) AS ac FROM p GROUP BY 1, 2, 3),
  k AS (SELECT *, lag(ac) OVER w AS b, lead(ac) OVER w AS a FROM c WINDOW w AS (PARTITION BY station_code ORDER BY lag)),
  s AS (SELECT station_code, station, min(CASE WHEN ac > b AND ac > a AND ac >= 0.1 THEN lag END) AS p,
    arg_min(ac, CASE WHEN ac > b AND ac > a AND ac >= 0.1 THEN lag END) AS a FROM k GROUP BY 1, 2)
  SELECT station_code, station, CAST(coalesce(p, 0) AS INTEGER) AS dominant_period,
   {r('CASE WHEN p IS NULL THEN 0.0 ELSE a END')} AS peak_autocorr FROM s""")
def _(spark, sf):
    return shown(ops.dominant_period(src.filled(spark, sf)), [*KEYS, "dominant_period"], ["peak_autocorr"])


@query("spectral_features", f"""WITH {FILLED}, n AS (SELECT station_code, station, count(*) AS n FROM filled GROUP BY 1, 2),
  f AS (SELECT n.station_code, n.station, n.n, unnest(range(0, n.n // 2)) AS k FROM n),
  d AS (SELECT f.station_code, f.station, f.n, f.k,
    pow(sum(s.value * cos(2 * pi() * ((f.k * (s.pos - 1)) % f.n) / f.n)), 2) + pow(sum(s.value * sin(2 * pi() * ((f.k * (s.pos - 1)) % f.n) / f.n)), 2) AS pw
    FROM f JOIN filled s ON s.station_code = f.station_code GROUP BY 1, 2, 3, 4),
  t AS (SELECT station_code, station, n, sum(pw) AS total, sum(k * pw) / sum(pw) AS centroid, arg_max(k, CASE WHEN k > 0 THEN pw END) AS dom FROM d GROUP BY 1, 2, 3),
  c AS (SELECT station_code, k, sum(pw) OVER (PARTITION BY station_code ORDER BY k) AS cum FROM d),
  o AS (SELECT c.station_code, min(c.k) AS roll FROM c JOIN t ON c.station_code = t.station_code WHERE cum >= 0.85 * total GROUP BY 1),
  b AS (SELECT d.station_code, sqrt(sum(pow(d.k - centroid, 2) * pw) / any_value(total)) AS bw FROM d JOIN t ON d.station_code = t.station_code GROUP BY 1)
  SELECT t.station_code, station, {r('CAST(dom AS DOUBLE) / n')} AS dominant_frequency, {r('total / n', 3)} AS power_per_row,
   {r('centroid', 3)} AS centroid, {r('bw', 3)} AS bandwidth, {r('CAST(roll AS DOUBLE) / n')} AS rolloff
  FROM t JOIN o ON t.station_code = o.station_code JOIN b ON t.station_code = b.station_code""")
def _(spark, sf):
    d = ops.spectral_features(src.filled(spark, sf))
    return d.select(*KEYS, *[rnd(c, 4 if c in ("dominant_frequency", "rolloff") else 3).alias(c)
                             for c in ("dominant_frequency", "power_per_row", "centroid", "bandwidth", "rolloff")])


@query("feature_row")
def _(spark, sf):
    d = ops.feature_row(src.filled(spark, sf))
    return shown(d, [*KEYS, "n"], [c for c in d.columns if c not in (*KEYS, "n")], 6)


def _weights(raw, digits=6, where="", lags=0, blend=None):
    wt = "raw / m" if blend is None else f"{1 - blend} + {blend} * raw / m"
    return f"""WITH {FILLED}, n AS (SELECT station_code, max(pos) - {lags} AS n FROM filled GROUP BY 1),
      p AS (SELECT f.station_code, station, date, f.pos - {lags} AS pos, n FROM filled f JOIN n USING (station_code) {where}),
      w AS (SELECT *, {raw} AS raw FROM p), t AS (SELECT station_code, avg(raw) AS m FROM w GROUP BY 1)
      SELECT station_code, station, date, {r(wt, digits)} AS weight FROM w JOIN t USING (station_code)"""


@query("exp_weights", _weights("exp(-0.1 * (n - pos))"))
def _(spark, sf):
    return shown(ops.exp_weights(src.filled(spark, sf)), ID, ["weight"], 6)


@query("linear_weights", _weights("1 + 1.0 * (CAST(pos - 1 AS DOUBLE) / (n - 1))"))
def _(spark, sf):
    return shown(ops.linear_weights(src.filled(spark, sf)), ID, ["weight"], 6)


@query("sample_weights", _weights("exp(-0.1 * (n - pos))", where="WHERE f.pos > 7", lags=7, blend=0.5))
def _(spark, sf):
    return shown(ops.sample_weights(src.filled(spark, sf)), ID, ["weight"], 6)


DRAW = """CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) * 100000 + datediff('day', DATE '1970-01-01', date)"""
_KEYED = "CAST(station_code AS VARCHAR) || '|' || station || '|' || strftime(date, '%Y-%m-%d')"


def draw(salt):
    return DRAW.format(text=f"'{salt}|' || {_KEYED}")


@query("recency_sampling", f"""WITH {FILLED}, a AS (SELECT *, max(pos) OVER (PARTITION BY station_code) - pos AS age FROM filled),
  b AS (SELECT *, CASE WHEN age < 30 THEN 'recent' WHEN age < 60 THEN 'medium' WHEN age < 90 THEN 'far'
    WHEN age < 180 THEN 'distant' ELSE 'very_distant' END AS band FROM a),
  k AS (SELECT *, row_number() OVER (PARTITION BY station_code, band ORDER BY {draw('recency')}) AS rk, count(*) OVER (PARTITION BY station_code, band) AS size FROM b)
  SELECT station_code, station, date, {r('value')} AS value, band FROM k
  WHERE rk <= greatest(1, floor(size * CASE band WHEN 'recent' THEN 1.0 WHEN 'medium' THEN 0.8 WHEN 'far' THEN 0.6 WHEN 'distant' THEN 0.4 ELSE 0.2 END + 1e-9))""")
def _(spark, sf):
    return long(ops.recency_sampling(src.filled(spark, sf)), "band")


# the share kept per band is fixed even though the rows are drawn by hash
@query("recency_sampling_shares", f"""WITH {FILLED}, n AS (SELECT station_code, max(pos) AS n FROM filled GROUP BY 1),
  b AS (SELECT f.station_code, station, n - pos AS age FROM filled f JOIN n USING (station_code)),
  k AS (SELECT station_code, station, CASE WHEN age < 30 THEN 'recent' WHEN age < 60 THEN 'medium' WHEN age < 90 THEN 'far'
    WHEN age < 180 THEN 'distant' ELSE 'very_distant' END AS band FROM b)
  SELECT station_code, station, band, CAST(greatest(1, floor(count(*) * CASE band WHEN 'recent' THEN 1.0 WHEN 'medium' THEN 0.8
    WHEN 'far' THEN 0.6 WHEN 'distant' THEN 0.4 ELSE 0.2 END + 1e-9)) AS BIGINT) AS kept FROM k GROUP BY 1, 2, 3""")
def _(spark, sf):
    return ops.recency_sampling(src.filled(spark, sf)).groupBy(*KEYS, "band").agg(F.count(F.lit(1)).alias("kept"))


@query("stratified_sample", f"""WITH {FILLED}, q AS (SELECT station_code, {", ".join(f"quantile_cont(value, {p / 100}) AS p{p}" for p in (10, 25, 50, 75, 90))},
    stddev_pop(value) AS sd, count(*) AS n FROM filled GROUP BY 1),
  big AS MATERIALIZED (SELECT f.station_code, station, date, value, q.* EXCLUDE (station_code) FROM filled f JOIN q USING (station_code) WHERE n > 1500),
  near AS ({" UNION ALL ".join(f"SELECT station_code, station, date, value, 'p{p}' AS part FROM big WHERE abs(value - p{p}) < sd * 0.5" for p in (10, 25, 50, 75, 90))}),
  picked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_code, part ORDER BY {DRAW.format(text=f"'near|' || part || '|' || {_KEYED}")}) AS rk FROM near) WHERE rk <= 300),
  fill AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY {draw('fill')}) AS rk FROM big),
  every AS (SELECT station_code, station, date, value, part FROM picked
   UNION ALL SELECT station_code, station, date, value, 'fill' FROM fill WHERE rk <= 1500 - (SELECT count(*) FROM picked p WHERE p.station_code = fill.station_code)
   UNION ALL SELECT f.station_code, station, date, value, 'all' FROM filled f JOIN q USING (station_code) WHERE n <= 1500)
  SELECT station_code, station, date, {r('value')} AS value, part FROM every""")
def _(spark, sf):
    return long(ops.stratified_sample(src.filled(spark, sf)), "part")


@query("train_test_split", f"""WITH {FILLED}, n AS (SELECT station_code, max(pos) AS n FROM filled GROUP BY 1)
  SELECT f.station_code, station, date, {r('value')} AS value, CASE WHEN pos <= floor(0.8 * n + 1e-9) THEN 'train' ELSE 'test' END AS part
  FROM filled f JOIN n ON f.station_code = n.station_code""")
def _(spark, sf):
    return long(ops.train_test_split(src.filled(spark, sf)), "part")


def _scale_sql(centre, spread):
    return f"""WITH {FILLED}, s AS (SELECT station_code, {centre} AS c, {spread} AS d FROM filled GROUP BY 1)
      SELECT f.station_code, station, date, {r('(value - c) / d', 6)} AS scaled, {r('value')} AS restored
      FROM filled f JOIN s ON f.station_code = s.station_code"""


def _scaled(spark, sf, how):
    d = ops.scale(src.filled(spark, sf), how)
    return d.select(*ID, rnd("scaled", 6).alias("scaled"), rnd("restored").alias("restored"))


@query("scale_standard", _scale_sql("avg(value)", "stddev_pop(value)"))
def _(spark, sf):
    return _scaled(spark, sf, "standard")


@query("scale_robust", _scale_sql("quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"))
def _(spark, sf):
    return _scaled(spark, sf, "robust")


@query("scale_minmax", _scale_sql("min(value)", "max(value) - min(value)"))
def _(spark, sf):
    return _scaled(spark, sf, "minmax")
