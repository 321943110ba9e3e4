"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rnd(c, digits: int = 4) -> Column:
    """Round a numeric column for reporting; nulls stay null.

    The small addend settles decimal ties that a double cannot hold exactly (12.34565 is
    stored a hair off), so that they round up whatever the rounding algorithm.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(1e-9), digits)


def div(a, b) -> Column:
    """Division that gives null on a zero divisor (ANSI mode would raise)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a.cast("double"), b.cast("double"))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation over complete pairs, null when one side is constant."""
    px = F.when(y.isNotNull(), x)
    py = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def flag(cond: Column) -> Column:
    """1/0 as INT, null condition counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_where(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def messages(*pairs: tuple[Column, str]) -> Column:
    """Comma-joined names of the conditions that hold, in the order given."""
    parts = [F.when(cond, F.lit(text)) for cond, text in pairs]
    return F.concat_ws(",", *parts)


def hash_unit(*cols) -> Column:
    """Repeatable pseudo-uniform number in (0, 1) from the row's keys, by a digest that any engine has."""
    text = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


def long(df: DataFrame, *extra) -> DataFrame:
    """Long series for reporting: keys, date, value to four digits, and more columns as they are."""
    return df.select("station_code", "station", "date", rnd("value").alias("value"), *extra)


def shown(df: DataFrame, plain: list[str], rounded: list[str], digits: int = 4) -> DataFrame:
    """Columns as they are, then the measured ones rounded for reporting."""
    return df.select(*plain, *[rnd(c, digits).alias(c) for c in rounded])
