"""Exact interpolated quantiles per group.

``series_quantiles`` uses Spark's ``percentile``, whose buffer holds a group's distinct
values. It is meant for daily station series: one value per station and date, so a group
is bounded by the days of the calendar, however much raw data stands behind it.

``exact_quantiles`` has no such bound on the group: ranks are found by counted pivots
(:mod:`almanac.plans.selection`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.plans.lineage import cut
from almanac.plans.selection import LIMIT, PIECES, order_statistics


def series_quantiles(df: DataFrame, keys: list[str], probs: dict[str, float], value: str = "value") -> DataFrame:
    """One row per key with a column for each ``{name: probability}``."""
    names = list(probs)
    q = F.percentile(F.col(value), F.array(*[F.lit(probs[n]) for n in names]))
    return (
        df.groupBy(*keys).agg(q.alias("q"))
        .select(*keys, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], probs: dict[str, float], value: str = "value", accuracy: int = PIECES, limit: int = LIMIT
) -> DataFrame:
    """Same result as ``series_quantiles`` for groups of any size. Every scan narrows a rank's range ``accuracy`` times."""
    names = list(probs)
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ranks = [((F.col("n") - 1) * F.lit(float(p))).alias(n) for n, p in probs.items()]
    sides = cut(counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("of"), r.alias("rank")) for n, r in zip(names, ranks)])).alias("e"))
                .select(*keys, "e.of", "e.rank"))
    wanted = sides.select(*keys, F.floor("rank").alias("rank_at")).union(sides.select(*keys, F.ceil("rank").alias("rank_at"))).distinct()
    found = cut(order_statistics(df, keys, wanted.withColumn("name", F.col("rank_at").cast("string")), value, limit, accuracy))
    a = found.select(*keys, F.col("name").cast("long").alias("lo_rank"), F.col("v").alias("a"))
    b = found.select(*keys, F.col("name").cast("long").alias("hi_rank"), F.col("v").alias("b"))
    both = (sides.withColumns({"lo_rank": F.floor("rank"), "hi_rank": F.ceil("rank")})
            .join(a, [*keys, "lo_rank"]).join(b, [*keys, "hi_rank"]))
    q = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.col("lo_rank"))
    return both.withColumn("q", q).groupBy(*keys).agg(*[F.max(F.when(F.col("of") == n, F.col("q"))).alias(n) for n in names])
