"""Queries for reshaping, filters, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.catalog.registry import query
from almanac.catalog.sql import DAILY, FILLED, LONG2, SERIES, WIDE, r
from almanac.functions.expr import long, rnd
from almanac.operators import reshape as ops
from almanac.sources import tables as src

DAY_COLS = [f"Día{d:02d}" for d in range(1, 32)]


@query("clean_sentinels", f"""WITH {WIDE}
SELECT "Código" AS station_code, "Estación" AS station, CAST("Año" AS INTEGER) AS year, CAST("Mes" AS INTEGER) AS month,
""" + ",\n".join(
    f"""TRY_CAST(CASE WHEN trim("Día{d:02d}") NOT IN ('*','nan','NaN','') THEN trim("Día{d:02d}") END AS DOUBLE) AS d{d:02d}"""
    for d in range(1, 32)) + "\nFROM wide")
def _(spark, sf):
    df = ops.clean_sentinels(src.wide(spark, sf), DAY_COLS)
    return df.select(
        F.col("Código").alias("station_code"), F.col("Estación").alias("station"),
        F.col("Año").alias("year"), F.col("Mes").alias("month"),
        *[F.col(f"Día{d:02d}").alias(f"d{d:02d}") for d in range(1, 32)],
    )


@query("unpivot_days", f"WITH {LONG2} SELECT station_code, station, date, value FROM long2")
def _(spark, sf):
    return ops.unpivot_days(src.wide(spark, sf), DAY_COLS, "Código", "Estación", "Año", "Mes")


@query("impossible_dates", f"""WITH {LONG2}, s AS (SELECT station_code, station, count(*) AS cells FROM long2 GROUP BY 1, 2),
  x AS (SELECT station_code, count(*) AS impossible FROM long2 WHERE day(date) = 28 AND month(date) IN (2, 4, 6, 9, 11) GROUP BY 1),
  e AS (SELECT station_code, count(*) AS extra FROM long2 WHERE day(date) = 28 GROUP BY 1),
  l AS (SELECT station_code, count(*) AS gone FROM long2 WHERE day(date) = 31 GROUP BY 1)
  SELECT s.station_code, station, cells + extra - coalesce(gone, 0) AS cells, coalesce(impossible, 0) AS impossible,
   {r('CAST(coalesce(impossible, 0) AS DOUBLE) / (cells + extra - coalesce(gone, 0))')} AS share
  FROM s JOIN e USING (station_code) LEFT JOIN x USING (station_code) LEFT JOIN l USING (station_code)""")
def _(spark, sf):
    """The 28th of every month stands on its 31st too, which short months don't have."""
    raw = src.wide(spark, sf).withColumn("Día31", F.col("Día28"))
    d = ops.impossible_dates(raw, DAY_COLS, "Código", "Estación", "Año", "Mes")
    return d.select("station_code", "station", "cells", "impossible", rnd("share").alias("share"))


@query("calendar_spine", f"WITH {DAILY} SELECT station_code, station, date, pos, {r('value')} AS value FROM daily")
def _(spark, sf):
    return long(src.daily(spark, sf), "pos")


def _gaps(src_sql, keys, t):
    return f"""gaps AS (SELECT {keys}, epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY {keys} ORDER BY t) AS us
      FROM (SELECT DISTINCT {keys}, CAST({t} AS TIMESTAMP) AS t FROM {src_sql})),
    g AS (SELECT {keys}, us / 1000000.0 AS gap_seconds FROM gaps WHERE us IS NOT NULL)"""


_FREQ = """CASE WHEN gap_seconds <= 3600 THEN 'H' WHEN gap_seconds <= 86400 THEN 'D'
  WHEN gap_seconds <= 604800 THEN 'W' WHEN gap_seconds BETWEEN 2419200 AND 2764800 THEN 'M'
  WHEN gap_seconds > 2764800 AND gap_seconds <= 7776000 THEN 'Q' ELSE 'Y' END"""


@query("detect_frequency", f"""WITH {SERIES}, {_gaps('series', 'station_code, station', 'date')},
  c AS (SELECT station_code, station, gap_seconds, count(*) AS n FROM g GROUP BY 1, 2, 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY n DESC, gap_seconds) AS rk FROM c)
  SELECT station_code, station, {r('gap_seconds', 3)} AS gap_seconds, {_FREQ} AS frequency FROM k WHERE rk = 1""")
def _(spark, sf):
    return ops.detect_frequency(src.series_table(spark, sf)).withColumn("gap_seconds", rnd("gap_seconds", 3))


@query("detect_frequency_events", f"""WITH {_gaps('events', 'event_type', 'ts')},
  c AS (SELECT event_type, gap_seconds, count(*) AS n FROM g GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, gap_seconds) AS rk FROM c)
  SELECT event_type, {r('gap_seconds', 6)} AS gap_seconds, {_FREQ} AS frequency FROM k WHERE rk = 1""")
def _(spark, sf):
    ev = src.table(spark, sf, "events").select("event_type", "ts")
    return ops.detect_frequency(ev, ["event_type"], "ts").withColumn("gap_seconds", rnd("gap_seconds", 6))


@query("frequency_consistency", f"""WITH {SERIES}, {_gaps('series', 'station_code, station', 'date')}
  SELECT station_code, station, count(*) AS gaps,
   {r("avg(CASE WHEN gap_seconds BETWEEN 77760.0 AND 95040.0 THEN 1.0 ELSE 0.0 END)")} AS share,
   avg(CASE WHEN gap_seconds BETWEEN 77760.0 AND 95040.0 THEN 1.0 ELSE 0.0 END) >= 0.8 AS consistent
  FROM g GROUP BY 1, 2""")
def _(spark, sf):
    return ops.frequency_consistency(src.series_table(spark, sf)).withColumn("share", rnd("share"))


def _rows(where):
    return f"WITH {SERIES} SELECT station_code, station, date, {r('value')} AS value FROM series WHERE {where}"


@query("filter_station", _rows("station = 'NATION_7'"))
def _(spark, sf):
    return long(ops.filter_station(src.series(spark, sf), "NATION_7"))


@query("filter_code", _rows("station_code = 11"))
def _(spark, sf):
    return long(ops.filter_code(src.series(spark, sf), 11))


@query("filter_date_range", _rows("date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'"))
def _(spark, sf):
    return long(ops.filter_date_range(src.series(spark, sf), "1997-03-01", "1998-02-28"))


@query("filter_stations_in", _rows("station IN ('NATION_3', 'NATION_5', 'NATION_21')"))
def _(spark, sf):
    return long(ops.filter_stations_in(src.series(spark, sf), ["NATION_3", "NATION_5", "NATION_21"]))


@query("limit_stations", _rows("station_code < 5"))
def _(spark, sf):
    return long(ops.limit_stations(src.series_table(spark, sf), 5))


@query("distinct_stations", f"""WITH {SERIES}
  SELECT DISTINCT station_code, station, count(*) OVER () AS n_stations
  FROM (SELECT DISTINCT station_code, station FROM series)""")
def _(spark, sf):
    s = ops.distinct_stations(src.series_table(spark, sf))
    return s.withColumn("n_stations", s.agg(F.count(F.lit(1))).scalar())


@query("dedupe_dates", f"""WITH dup AS (
    SELECT s_nationkey AS station_code, n_name AS station, CAST(l_shipdate AS DATE) AS date,
      l_quantity AS value, l_orderkey * 100 + l_linenumber AS arrival, l_extendedprice AS x
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
  k AS (SELECT *, row_number() OVER (PARTITION BY station_code, date ORDER BY arrival, x, value) AS rk FROM dup)
  SELECT station_code, station, date, value FROM k WHERE rk = 1""")
def _(spark, sf):
    line = src.table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice")
    supp = src.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = src.table(spark, sf, "nation").select("n_nationkey", "n_name")
    raw = (
        line.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_nationkey").alias("station_code"), F.col("n_name").alias("station"),
            F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("value"),
            F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("a"),
                     F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("q")).alias("arrival"),
        )
    )
    return ops.dedupe_dates(raw, "arrival").select("station_code", "station", "date", "value")


@query("union_stations", f"""WITH {SERIES} SELECT station_code, station, date, {r('value')} AS value,
  CASE WHEN station_code < 12 THEN 'low' END AS part FROM series""")
def _(spark, sf):
    s = src.series(spark, sf)
    low = s.filter("station_code < 12").withColumn("part", F.lit("low"))
    return long(ops.union_stations(low, s.filter("station_code >= 12")), "part")


@query("prepare_series", f"""WITH {LONG2} SELECT station_code, station, date, value FROM long2""")
def _(spark, sf):
    raw = src.daily(spark, sf).select(
        "station_code", "station", F.col("date").cast("string").alias("date"),
        F.coalesce(F.round("value", 2).cast("decimal(12,2)").cast("string"), F.lit("*")).alias("value"))
    return ops.prepare_series(raw)


def _tail(n):
    return f"""WITH {FILLED}, k AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY date DESC) AS age
      FROM filled) SELECT station_code, station, date, {r('value')} AS value, CAST(age AS INTEGER) AS age
      FROM k WHERE age <= {n}"""


@query("context_tail", _tail(30))
def _(spark, sf):
    return long(ops.tail_rows(src.filled(spark, sf), 30), "age")


@query("downsample_mean", f"""WITH {SERIES},
  s AS (SELECT station_code, min(date) AS lo FROM series GROUP BY 1)
  SELECT f.station_code, station,
    CAST(lo + CAST((datediff('day', lo, date) // 2) * 2 AS INTEGER) AS DATE) AS date,
    {r('avg(value)')} AS value, count(value) AS rows_merged
  FROM series f JOIN s ON f.station_code = s.station_code GROUP BY 1, 2, 3""")
def _(spark, sf):
    return ops.downsample_mean(src.series_table(spark, sf), 2).withColumn("value", rnd("value"))


@query("downsample_stride", f"""WITH {SERIES},
  k AS (SELECT *, row_number() OVER (PARTITION BY station_code ORDER BY date) AS pos,
        count(*) OVER (PARTITION BY station_code) AS n FROM series)
  SELECT station_code, station, date, {r('value')} AS value, pos, n FROM k
  WHERE (pos - 1) % 5 = 0""")
def _(spark, sf):
    return long(ops.downsample_stride(src.series(spark, sf), 5), "pos", "n")


@query("extract_station_code", """SELECT s_suppkey, nullif(regexp_extract(s_suppkey || '_' || s_name, '^(\\d+)', 1), '') AS code,
  nullif(regexp_extract(s_name, '^(\\d+)', 1), '') AS code_of_name FROM supplier""")
def _(spark, sf):
    s = src.table(spark, sf, "supplier")
    return s.select(
        "s_suppkey",
        ops.extract_station_code(F.concat_ws("_", F.col("s_suppkey").cast("string"), "s_name")).alias("code"),
        ops.extract_station_code(F.col("s_name")).alias("code_of_name"))


@query("sanitize_name", r"""WITH n AS (SELECT p_partkey, p_name || ', ' || p_brand || '. / ' || p_type AS name FROM part),
  k AS (SELECT *, regexp_replace(translate(name, ' /\', '___'), '[^\p{L}\p{N}_-]', '', 'g') AS kept FROM n)
  SELECT p_partkey, CASE WHEN length(kept) <= 50 THEN kept ELSE substr(kept, 1, 41) || '_' || substr(md5(name), 1, 8) END AS clean,
   CASE WHEN length(kept) <= 20 THEN kept ELSE substr(kept, 1, 11) || '_' || substr(md5(name), 1, 8) END AS short FROM k""")
def _(spark, sf):
    name = F.concat(F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit(". / "), F.col("p_type"))
    return src.table(spark, sf, "part").select(
        "p_partkey", ops.sanitize_name(name).alias("clean"), ops.sanitize_name(name, 20).alias("short"))


@query("continuous_segments", f"""WITH {SERIES},
  b AS (SELECT *, CASE WHEN datediff('day', lag(date) OVER w, date) > 1 THEN 1 ELSE 0 END AS broke
        FROM series WINDOW w AS (PARTITION BY station_code ORDER BY date))
  SELECT station_code, station, date, {r('value')} AS value,
    CAST(1 + sum(broke) OVER (PARTITION BY station_code ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
  FROM b""")
def _(spark, sf):
    return long(ops.continuous_segments(src.series(spark, sf)), "segment")


@query("calendar_spine_hourly", """WITH e AS (SELECT event_type AS station, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, value FROM events),
  hourly AS (SELECT station, h, sum(value) AS value FROM e GROUP BY 1, 2),
  g AS (SELECT station, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM hourly GROUP BY 1)
  SELECT g.station, 'H' AS frequency, strftime(g.h, '%Y-%m-%d %H:%M:%S') AS date,
   row_number() OVER (PARTITION BY g.station ORDER BY g.h) AS pos, (round(v.value, 4) + 0.0) AS value,
   CAST(CASE WHEN v.h IS NULL THEN 0 ELSE 1 END AS BIGINT) AS merged
  FROM g LEFT JOIN hourly v ON g.station = v.station AND g.h = v.h""")
def _(spark, sf):
    """Hourly sums per event type stay hourly on their calendar."""
    e = src.table(spark, sf, "events").groupBy(F.col("event_type").alias("station"), F.date_trunc("hour", "ts").alias("date")).agg(
        F.sum("value").alias("value"))
    d = ops.frequency_calendar(e, ["station"])
    return d.select("station", "frequency", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "pos",
                    F.round("value", 4).alias("value"), "merged")


@query("calendar_spine_weekly", f"""WITH {SERIES},
  w AS (SELECT station_code, station, date, value FROM series WHERE isodow(date) = 3 AND station_code % 5 <> 0),
  lo AS (SELECT station_code, min(date) AS lo, max(date) AS hi FROM w GROUP BY 1),
  s AS (SELECT w.*, datediff('day', lo, date) // 7 AS step, lo FROM w JOIN lo USING (station_code)),
  v AS (SELECT station_code, step, avg(value) AS value, count(*) AS merged FROM s GROUP BY 1, 2),
  g AS (SELECT station_code, lo, unnest(generate_series(0, datediff('day', lo, hi) // 7)) AS step FROM lo),
  n AS (SELECT DISTINCT station_code, station FROM w)
  SELECT g.station_code, station, 'W' AS frequency, CAST(lo + CAST(g.step * 7 AS INTEGER) AS DATE) AS date, CAST(g.step + 1 AS BIGINT) AS pos,
   {r('value')} AS value, coalesce(merged, 0) AS merged
  FROM g JOIN n USING (station_code) LEFT JOIN v ON g.station_code = v.station_code AND g.step = v.step""")
def _(spark, sf):
    """Weekly series: each reading falls into its station's own week, none is lost."""
    s = src.series(spark, sf).where("weekday(date) = 2 AND station_code % 5 <> 0")
    d = ops.frequency_calendar(s)
    return long(d.withColumn("date", F.col("date").cast("date")), "frequency", "pos", "merged")
