"""SQL text shared by the reference results: the derived series as named subqueries."""

from __future__ import annotations


def r(expr: str, digits: int = 4) -> str:
    """Rounded double, never a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE) + 1e-9, {digits}) + 0.0)"


def corr(x: str, y: str) -> str:
    px = f"CASE WHEN ({y}) IS NOT NULL THEN ({x}) END"
    py = f"CASE WHEN ({x}) IS NOT NULL THEN ({y}) END"
    return f"(covar_pop({px}, {py}) / nullif(stddev_pop({px}) * stddev_pop({py}), 0))"


SERIES = """series AS MATERIALIZED (
  SELECT s_nationkey AS station_code, n_name AS station, CAST(l_shipdate AS DATE) AS date,
         avg(l_quantity) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3)"""

SPARSE = """sparse AS MATERIALIZED (
  SELECT c_nationkey AS station_code, n_name AS station, CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3)"""


def spine(src: str, out: str) -> str:
    return f"""{out} AS MATERIALIZED (
  SELECT g.station_code, g.station, g.date, v.value, datediff('day', g.lo, g.date) + 1 AS pos
  FROM (SELECT station_code, station, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
        FROM (SELECT station_code, station, min(date) AS lo, max(date) AS hi FROM {src} GROUP BY 1, 2)) g
  LEFT JOIN {src} v ON g.station_code = v.station_code AND g.station = v.station AND g.date = v.date)"""


def near(src: str, out: str) -> str:
    """Known points around each row of a complete calendar."""
    return f"""{out}_k AS (SELECT *, CASE WHEN value IS NOT NULL THEN pos END AS kp FROM {src}),
{out} AS MATERIALIZED (
  SELECT * EXCLUDE (kp),
    last_value(kp IGNORE NULLS) OVER b AS prev_pos, last_value(value IGNORE NULLS) OVER b AS prev_value,
    first_value(kp IGNORE NULLS) OVER a AS next_pos, first_value(value IGNORE NULLS) OVER a AS next_value
  FROM {out}_k
  WINDOW b AS (PARTITION BY station_code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY station_code ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


LINEAR = """CASE WHEN value IS NOT NULL THEN value ELSE prev_value + (next_value - prev_value)
  * (CAST(pos - prev_pos AS DOUBLE) / CAST(next_pos - prev_pos AS DOUBLE)) END"""


def linear(src: str, out: str) -> str:
    return f"""{near(src, out + '_n')},
{out} AS MATERIALIZED (
  SELECT station_code, station, date, pos, value IS NULL AS imputed,
         coalesce({LINEAR}, prev_value, next_value) AS value
  FROM {out}_n)"""


DAILY = f"{SERIES},\n{spine('series', 'daily')}"
DAILY_SPARSE = f"{SPARSE},\n{spine('sparse', 'daily')}"
FILLED = f"{DAILY},\n{linear('daily', 'filled')}"
FILLED_SPARSE = f"{DAILY_SPARSE},\n{linear('daily', 'filled')}"

RAIN = f"""wet AS (
  SELECT c_nationkey AS station_code, n_name AS station, CAST(o_orderdate AS DATE) AS date,
         CAST(count(*) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3),
{spine('wet', 'rain0')},
rain AS MATERIALIZED (SELECT * EXCLUDE (value), coalesce(value, 0.0) AS value FROM rain0)"""

_MARKS = ["*", "nan", "NaN", ""]
_CELLS = ",\n  ".join(
    f"coalesce(max(CASE WHEN day(date) = {d} THEN CAST(CAST(round(value, 2) AS DECIMAL(12,2)) AS VARCHAR) END), "
    f"'{_MARKS[d % 4]}') AS \"Día{d:02d}\"" for d in range(1, 32)
)
WIDE = f"""{SERIES},
wide AS MATERIALIZED (
  SELECT station_code AS "Código", station AS "Estación", year(date) AS "Año", month(date) AS "Mes",
  {_CELLS}
  FROM series GROUP BY 1, 2, 3, 4)"""
# the wide table read back as a long series: values with two decimals
LONG2 = f"""{SERIES},
long2 AS MATERIALIZED (
  SELECT station_code, station, date, CAST(CAST(round(value, 2) AS DECIMAL(12,2)) AS DOUBLE) AS value FROM series)"""

THRESHOLDS = f"""thresholds AS MATERIALIZED (
  SELECT station_code, station, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.10) AS p10,
         quantile_cont(value, 0.90) AS p90, quantile_cont(value, 0.95) AS p95
  FROM series GROUP BY 1, 2)"""
