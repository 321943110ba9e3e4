"""Queries for orders of autoregressive moving-average models."""

from __future__ import annotations

from almanac.catalog.registry import query
from almanac.catalog.sql import FILLED, r
from almanac.functions.expr import shown
from almanac.operators import arma as ops
from almanac.sources import tables as src

KEYS = ["station_code", "station"]
_L = ops.LONG
_W = "OVER (PARTITION BY station_code ORDER BY pos)"
_NAMES = ["x1", "x2", "x3", "e1", "e2", "e3", "x"]
_LAGS = ", ".join(f"lag(x, {k}) {_W} AS x{k}" for k in range(1, _L + 1))
_DOT = " + ".join(f"a[{k}] * x{k}" for k in range(1, _L + 1))
_AT = lambda i, j: 7 * i + j + 1

# The recursion on lag products, then for each order its regressors eliminated one by one from the products.
ORDERS = f"""{FILLED},
  c AS MATERIALIZED (SELECT station_code, station, pos, value - avg(value) OVER (PARTITION BY station_code) AS x FROM filled),
  l AS MATERIALIZED (SELECT *, {_LAGS} FROM c),
  g AS (SELECT station_code, [sum(x * x), {", ".join(f"sum(x * coalesce(x{k}, 0))" for k in range(1, _L + 1))}] AS g FROM l GROUP BY 1),
  lev AS (
   SELECT station_code, g, 0 AS m, CAST([] AS DOUBLE[]) AS a, g[1] AS err FROM g
   UNION ALL
   SELECT station_code, g, m + 1, list_append(list_transform(range(1, m + 1), lambda i: a[i] - k * a[m + 1 - i]), k), err * (1 - k * k)
   FROM (SELECT *, (g[m + 2] - coalesce(list_sum(list_transform(range(1, m + 1), lambda i: a[i] * g[m + 2 - i])), 0)) / err AS k FROM lev WHERE m < {_L})),
  er AS MATERIALIZED (SELECT l.station_code, station, pos, x, x - ({_DOT}) AS e FROM l JOIN lev ON lev.station_code = l.station_code AND m = {_L} WHERE x{_L} IS NOT NULL),
  d AS (SELECT station_code, station, x, {", ".join(f"lag({v}, {k}) {_W} AS {v}{k}" for v in "xe" for k in (1, 2, 3))} FROM er),
  s AS MATERIALIZED (SELECT station_code, station, count(*) AS n, [{", ".join(f"sum({a} * {b})" for a in _NAMES for b in _NAMES)}] AS mat
   FROM d WHERE x3 IS NOT NULL GROUP BY 1, 2),
  o AS (SELECT p, q, list_concat(range(0, p), range(3, 3 + q)) AS pick FROM range(4) a(p), range(4) b(q)),
  el AS (
   SELECT station_code, station, n, CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, pick, mat, 1 AS step FROM s, o
   UNION ALL
   SELECT station_code, station, n, p, q, pick, list_transform(range(49), lambda t: mat[t + 1]
     - mat[7 * (t // 7) + pick[step] + 1] * mat[7 * pick[step] + t % 7 + 1] / mat[8 * pick[step] + 1]), step + 1
   FROM el WHERE step <= len(pick)),
  orders AS MATERIALIZED (SELECT station_code, station, n, p, q, mat[49] / n AS sigma2, n * ln(mat[49] / n) + 2 * (p + q + 1) AS aic,
   n * ln(mat[49] / n) + ln(n) * (p + q + 1) AS bic FROM el WHERE step = len(pick) + 1)"""


@query("arma_orders", f"""WITH RECURSIVE {ORDERS}
  SELECT station_code, station, n, p, q, {r('sigma2')} AS sigma2, {r('aic', 3)} AS aic, {r('bic', 3)} AS bic FROM orders""")
def _(spark, sf):
    found = ops.arma_orders(src.filled(spark, sf))
    return shown(shown(found, [*KEYS, "n", "p", "q", "aic", "bic"], ["sigma2"]), [*KEYS, "n", "p", "q", "sigma2"], ["aic", "bic"], 3)


@query("arma_order_selection", f"""WITH RECURSIVE {ORDERS}, k AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY bic, p, q) AS rk FROM orders)
  SELECT station_code, station, n, p, q, {r('sigma2')} AS sigma2, CAST(16 AS BIGINT) AS tried FROM k WHERE rk = 1""")
def _(spark, sf):
    return shown(ops.arma_order_selection(src.filled(spark, sf)), [*KEYS, "n", "p", "q", "tried"], ["sigma2"])
