"""Projections, filters, reshaping, limits and set operations on station tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.plans import blocks

KEYS = ["station_code", "station"]

# Cell markers that mean "no measurement".
MISSING_MARKERS = ("*", "nan", "NaN", "")

# Spacing of each frequency as an interval and in seconds.
STEP_INTERVALS = {
    "H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY",
    "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTH", "Y": "INTERVAL 1 YEAR",
}
STEP_SECONDS = {"H": 3600, "D": 86400, "W": 604800, "M": 2592000, "Q": 7776000, "Y": 31536000}


def clean_cell(c: Column) -> Column:
    """Marker text to null, then to a finite number; other bad text is null too."""
    t = F.trim(c)
    number = F.when(~t.isin(*MISSING_MARKERS), t).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def clean_sentinels(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: clean_cell(F.col(c)) for c in cols})


def day_number(name: str) -> int:
    return int(re.search(r"(\d{1,2})$", name).group(1))


def unpivot_days(
    df: DataFrame, day_cols: list[str], code: str = "station_code", station: str = "station",
    year: str = "year", month: str = "month",
) -> DataFrame:
    """Monthly-wide rows to one row per measured day; impossible dates fall away."""
    cells = F.array(*[
        F.struct(F.lit(day_number(c)).alias("day"), clean_cell(F.col(c)).alias("value")) for c in day_cols
    ])
    measured = F.filter(cells, lambda cell: cell["value"].isNotNull())
    long = df.select(
        F.col(code).alias("station_code"), F.col(station).alias("station"),
        F.col(year).try_cast("int").alias("year"), F.col(month).try_cast("int").alias("month"),
        F.explode(measured).alias("cell"),
    )
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", "year", "month", F.col("cell.day")), "yyyy-MM-dd")
    return (
        long.filter(F.col("year").isNotNull() & F.col("month").isNotNull())
        .select(*KEYS, date.alias("date"), F.col("cell.value").alias("value"))
        .filter(F.col("date").isNotNull())
    )


def impossible_dates(
    df: DataFrame, day_cols: list[str], code: str = "station_code", station: str = "station",
    year: str = "year", month: str = "month",
) -> DataFrame:
    """(station_code, station, cells, impossible, share) of monthly-wide rows: measured cells, and those whose date doesn't exist.

    A day beyond its month's end, and any day of a row without a readable year and month, is impossible.
    """
    cells = F.array(*[F.struct(F.lit(day_number(c)).alias("day"), clean_cell(F.col(c)).alias("value")) for c in day_cols])
    measured = F.filter(cells, lambda cell: cell["value"].isNotNull())
    year_of, month_of = F.col(year).try_cast("int"), F.col(month).try_cast("int")
    last = F.dayofmonth(F.last_day(F.try_to_date(F.format_string("%04d-%02d-01", year_of, month_of), "yyyy-MM-dd")))
    good = F.size(F.filter(measured, lambda cell: (cell["day"] >= 1) & (cell["day"] <= F.coalesce(last, F.lit(0)))))
    rows = df.select(F.col(code).alias("station_code"), F.col(station).alias("station"), F.size(measured).alias("all"), good.alias("good"))
    out = rows.groupBy(*KEYS).agg(F.sum("all").alias("cells"), F.sum(F.col("all") - F.col("good")).alias("impossible"))
    return out.withColumn("share", F.coalesce(F.try_divide("impossible", "cells"), F.lit(0.0)))


def calendar_spine(df: DataFrame, keys: list[str] = KEYS, frequency: str = "D") -> DataFrame:
    """Every date from first to last per station, with ``pos`` from 1; values joined on.

    The calendar is laid out one block at a time, so a long station is spread over tasks
    before its days exist.
    """
    span = df.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    if frequency == "D":
        step = blocks.BLOCK
        spine = (
            span.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("hi", "lo") / step).cast("int"))))
            .withColumn("from", F.date_add("lo", F.col("b") * step))
            .withColumn("date", F.explode(F.sequence(
                "from", F.least(F.col("hi"), F.date_add("from", step - 1)), F.expr("INTERVAL 1 DAY"))))
            .select(*keys, "date", (F.datediff("date", "lo") + 1).cast("bigint").alias("pos"))
        )
    else:
        spine = span.select(
            *keys, F.posexplode(F.sequence("lo", "hi", F.expr(STEP_INTERVALS[frequency]))).alias("i", "date")
        ).select(*keys, "date", (F.col("i") + 1).cast("bigint").alias("pos"))
    return spine.join(df, [*keys, "date"], "left")


def frequency_calendar(df: DataFrame, keys: list[str] = KEYS, date: str = "date") -> DataFrame:
    """Each station on the calendar of its own most common gap: no reading is lost, those of one step are averaged.

    Steps are hours, days, weeks, months, quarters or years from the station's first instant; ``date``
    is the instant a step begins, ``pos`` its number from 1, ``merged`` the readings in it (0 in a gap).
    A station with one instant is daily.
    """
    at = F.col(date).cast("timestamp")
    span = (
        df.groupBy(*keys).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
        .join(detect_frequency(df, keys, date).select(*keys, "frequency"), keys, "left")
        .withColumn("frequency", F.coalesce("frequency", F.lit("D"))))
    seconds = F.lit(None)
    months = F.lit(None)
    for code in ("H", "D", "W"):
        seconds = F.when(F.col("frequency") == code, F.lit(STEP_SECONDS[code])).otherwise(seconds)
    for code, n in (("M", 1), ("Q", 3), ("Y", 12)):
        months = F.when(F.col("frequency") == code, F.lit(n)).otherwise(months)
    span = span.withColumns({"seconds": seconds.cast("bigint"), "months": months.cast("int")})

    def step(t: Column) -> Column:
        by_time = F.floor((F.unix_micros(t) - F.unix_micros("lo")) / (F.col("seconds") * 1_000_000))
        by_month = F.floor(F.months_between(t, "lo") / F.col("months"))
        return F.coalesce(by_time, by_month).cast("bigint")

    readings = (
        df.join(span, keys).withColumn("step", step(at)).groupBy(*keys, "step")
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("merged")))
    size = blocks.BLOCK
    numbers = (
        span.withColumn("last", step(F.col("hi")))
        .withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / size))))
        .withColumn("step", F.explode(F.sequence(F.col("b") * size, F.least(F.col("last"), F.col("b") * size + size - 1)))))
    begins = F.coalesce(
        F.timestamp_micros(F.unix_micros("lo") + F.col("step") * F.col("seconds") * 1_000_000),
        F.expr("lo + make_ym_interval(0, CAST(step * months AS INT))"))
    return (
        numbers.select(*keys, "frequency", "step", begins.alias("date"), (F.col("step") + 1).alias("pos"))
        .join(readings, [*keys, "step"], "left").drop("step")
        .withColumn("merged", F.coalesce("merged", F.lit(0)).cast("bigint")))


def date_gaps(df: DataFrame, keys: list[str] = KEYS, date: str = "date") -> DataFrame:
    """Distances in seconds between neighbouring dates of a station.

    Only distinct instants count. Minutes are the unit of splitting: each minute with rows
    knows the last instant before it, so no window spans a whole station's records.
    """
    t = df.select(*keys, F.col(date).cast("timestamp").alias("t")).distinct()
    by_minute = t.withColumn("d", F.date_trunc("minute", "t"))
    last = by_minute.groupBy(*keys, "d").agg(F.max("t").alias("minute_last"))
    w = Window.partitionBy(*keys).orderBy("d")
    before = last.select(*keys, "d", F.lag("minute_last").over(w).alias("t_in"))
    inner = Window.partitionBy(*keys, "d").orderBy("t")
    return (
        by_minute.withColumn("t_prev", F.lag("t").over(inner))
        .join(before, [*keys, "d"])
        .withColumn("t_prev", F.coalesce("t_prev", "t_in"))
        .filter(F.col("t_prev").isNotNull())
        .select(*keys, (F.unix_micros("t") - F.unix_micros("t_prev")).alias("micros"))
        .select(*keys, (F.col("micros") / F.lit(1_000_000.0)).alias("gap_seconds"))
    )


def frequency_code(seconds: Column) -> Column:
    return (
        F.when(seconds <= 3600, "H").when(seconds <= 86400, "D").when(seconds <= 604800, "W")
        .when(seconds.between(2419200, 2764800), "M")
        .when((seconds > 2764800) & (seconds <= 7776000), "Q").otherwise("Y")
    )


def detect_frequency(df: DataFrame, keys: list[str] = KEYS, date: str = "date") -> DataFrame:
    """Most common gap (the smallest on a tie) and its frequency code per station."""
    counts = date_gaps(df, keys, date).groupBy(*keys, "gap_seconds").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy(*keys).agg(
        F.min_by("gap_seconds", F.struct(-F.col("c"), F.col("gap_seconds"))).alias("gap_seconds")
    )
    return best.withColumn("frequency", frequency_code(F.col("gap_seconds")))


def frequency_consistency(df: DataFrame, frequency: str = "D", keys: list[str] = KEYS, date: str = "date") -> DataFrame:
    """Share of gaps within 10% of the expected one; consistent from 0.8 on."""
    e = float(STEP_SECONDS[frequency])
    near = F.when(F.col("gap_seconds").between(0.9 * e, 1.1 * e), 1.0).otherwise(0.0)
    return (
        date_gaps(df, keys, date).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("gaps"), F.avg(near).alias("share"))
        .withColumn("consistent", F.col("share") >= 0.8)
    )


def filter_station(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("station") == name)


def filter_code(df: DataFrame, code: int) -> DataFrame:
    return df.filter(F.col("station_code") == code)


def filter_date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def filter_stations_in(df: DataFrame, wanted, column: str = "station") -> DataFrame:
    """Rows whose station is in a list, or in a one-column DataFrame for long lists."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(wanted)))


def station_order(code: Column, name: Column) -> Column:
    """Numeric code, else the digits in the name, else 999999."""
    digits = F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint")
    return F.coalesce(code.cast("string").try_cast("bigint"), digits, F.lit(999999).cast("bigint"))


def limit_stations(df: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    first = (
        df.select(*keys).distinct()
        .orderBy(station_order(F.col(keys[0]), F.col(keys[1])), *[F.col(k) for k in keys])
        .limit(n)
    )
    return df.join(first, keys, "left_semi")


def distinct_stations(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.select(*keys).distinct()


def dedupe_dates(df: DataFrame, arrival: str, keys: list[str] = KEYS) -> DataFrame:
    """First arrival per station and date, as an aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, "date")]
    first = F.min_by(F.struct(*rest), F.col(arrival)).alias("r")
    return df.groupBy(*keys, "date").agg(first).select(*keys, "date", *[F.col(f"r.{c}").alias(c) for c in rest])


def union_stations(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def prepare_series(df: DataFrame, date: str = "date", value: str = "value") -> DataFrame:
    """Cast date and value, drop rows without a value; the writer or reader orders where it matters."""
    return (
        df.withColumn(date, F.col(date).try_cast("date")).withColumn(value, clean_cell(F.col(value).cast("string")))
        .filter(F.col(value).isNotNull())
    )


def tail_rows(df: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """Last ``n`` rows per key by date. Spark turns the rank filter into a window group limit,
    so each task keeps only its own last ``n`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return df.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def downsample_mean(df: DataFrame, days: int, keys: list[str] = KEYS) -> DataFrame:
    """Mean per bucket of ``days`` days from the first date, for every station whatever its length."""
    span = df.groupBy(*keys).agg(F.min("date").alias("lo"))
    return (
        df.join(span, keys)
        .withColumn("start", F.date_add("lo", (F.floor(F.datediff("date", "lo") / days) * days).cast("int")))
        .groupBy(*keys, F.col("start").alias("date"))
        .agg(F.avg("value").alias("value"), F.count("value").alias("rows_merged"))
    )


def downsample_stride(df: DataFrame, stride: int, keys: list[str] = KEYS) -> DataFrame:
    """Every ``stride``-th row of each station, for every station whatever its length."""
    return blocks.number_rows(df, keys).filter((F.col("pos") - 1) % stride == 0)


def extract_station_code(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit(""))


def sanitize_name(name: Column, length: int = 50) -> Column:
    """Blank and slashes to ``_``; other marks dropped. A longer name than ``length`` ends in a hash of the
    whole name, so that two names never share a file."""
    kept = F.regexp_replace(F.translate(name, " /\\", "___"), r"[^\p{L}\p{N}_-]", "")
    short = F.concat(F.substring(kept, 1, length - 9), F.lit("_"), F.substring(F.md5(name), 1, 8))
    return F.when(F.length(kept) <= length, kept).otherwise(short)


def continuous_segments(df: DataFrame, max_gap: int = 1, keys: list[str] = KEYS) -> DataFrame:
    """Segment numbers from 1, a new one after every gap longer than ``max_gap`` days."""
    numbered = blocks.number_rows(df, keys)
    in_order = Window.partitionBy(*keys).orderBy("pos")
    gap = numbered.withColumn(
        "broke", F.when(F.datediff("date", F.lag("date").over(in_order)) > max_gap, 1).otherwise(0)
    )
    return blocks.running_sums(gap, keys, {"breaks": F.col("broke")}).withColumn(
        "segment", (F.col("breaks") + 1).cast("bigint")
    ).drop("breaks", "broke")
