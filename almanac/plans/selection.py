"""Order statistics of groups of any size, by counted pivots.

Every wanted rank has a bracket. A round counts the values inside each bracket by pieces of it, combined
before the shuffle, and goes on with the piece that holds the rank, until a bracket has one
value or few enough rows to be taken whole. No task sorts a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.plans.lineage import cut

LIMIT = 2000
"""Rows of a bracket that are taken whole."""
PIECES = 256


def _even(c: Column) -> Column:
    return c.cast("double") / 2


def _scale(c: Column) -> Column:
    """Sign and exponent of a number as one number: even in the decades rather than in the numbers."""
    d = c.cast("double")
    return F.when(d == 0, 0.0).otherwise(F.signum(d) * (F.ln(F.abs(d)) + 746))


def _piece(v: Column, lo: Column, hi: Column, pieces: int, on: Callable[[Column], Column]) -> Column:
    """Number of the piece of [lo, hi], even on a scale, that holds v; never falls as v grows."""
    share = F.try_divide(on(v) - on(lo), on(hi) - on(lo))
    return F.coalesce(F.least(F.floor(share * pieces), F.lit(pieces - 1)), F.when(v > lo, pieces - 1).otherwise(0)).cast("int")


def _narrowed(values: DataFrame, open_: DataFrame, keys: list[str], pieces: int, on: Callable[[Column], Column]) -> DataFrame:
    """Brackets shrunk to the piece that holds their rank."""
    brackets = open_.groupBy(*keys).agg(F.collect_list(F.struct("name", "lo", "hi")).alias("brackets"))
    inside = F.filter("brackets", lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))
    counted = values.join(brackets, keys).select(*keys, "v", F.explode(inside).alias("b")).groupBy(
        *keys, F.col("b.name").alias("name"), _piece(F.col("v"), F.col("b.lo"), F.col("b.hi"), pieces, on).alias("piece")).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    found = counted.groupBy(*keys, "name").agg(F.sort_array(F.collect_list(F.struct("piece", "c", "lo", "hi"))).alias("pieces"))
    joined = open_.select(*keys, "name", "rank_at", "below").join(found, [*keys, "name"])
    upto = lambda i: F.aggregate(F.slice("pieces", 1, i), F.lit(0).cast("long"), lambda s, p: s + p["c"])
    placed = joined.withColumn("placed", F.transform("pieces", lambda p, i: F.struct((F.col("below") + upto(i)).alias("below"), p["c"].alias("inside"), p["lo"].alias("lo"), p["hi"].alias("hi"))))
    holds = F.filter("placed", lambda p: (p["below"] <= F.col("rank_at")) & (F.col("rank_at") < p["below"] + p["inside"]))
    return placed.select(*keys, "name", "rank_at", holds[0].alias("p")).select(*keys, "name", "rank_at", "p.*")


def order_statistics(df: DataFrame, keys: list[str], wanted: DataFrame, value: str = "value", limit: int = LIMIT, pieces: int = PIECES) -> DataFrame:
    """(keys, name, v): for every row of ``wanted`` (keys, name, rank_at) the value with rank_at others of its group before it.

    ``df`` is scanned once for the range, once per round and once for the brackets that are left; rounds cut
    brackets evenly by number and by decade in turn, so that few rounds do for steep groups too. Null and nan
    values don't count; ranks outside the group give no row.
    """
    named, keys = keys, [f"__key{i}" for i in range(len(keys))]
    own = [F.col(c).alias(k) for c, k in zip(named, keys)]
    v = F.col(value)
    values = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*own, v.alias("v"))
    ranges = values.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("inside"))
    state = cut(wanted.select(*own, "name", F.col("rank_at").cast("long").alias("rank_at")).join(ranges, keys)
                .where("rank_at >= 0 and rank_at < inside").select(*keys, "name", "rank_at", F.lit(0).cast("long").alias("below"), "inside", "lo", "hi"))
    wide = (F.col("inside") > limit) & (F.col("lo") < F.col("hi"))
    done, turn = state.where(~wide), 0
    while not (open_ := state.where(wide)).isEmpty():
        state = cut(_narrowed(values, open_, keys, pieces, _scale if turn % 2 else _even))
        done, turn = done.unionByName(state.where(~wide)), turn + 1
    single = done.where("lo = hi").select(*keys, "name", F.col("lo").alias("v"))
    several = done.where("lo < hi")
    brackets = several.groupBy(*keys).agg(F.collect_list(F.struct("name", "rank_at", "below", "lo", "hi")).alias("brackets"))
    inside = F.filter("brackets", lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))
    taken = values.join(brackets, keys).select(*keys, "v", F.explode(inside).alias("b")).groupBy(
        *keys, F.col("b.name").alias("name")).agg(F.sort_array(F.collect_list("v")).alias("vs"), F.first(F.col("b.rank_at") - F.col("b.below")).alias("at"))
    out = taken.select(*keys, "name", F.get("vs", F.col("at").cast("int")).alias("v")).unionByName(single)
    return out.select(*[F.col(k).alias(c) for c, k in zip(named, keys)], "name", "v")


def smallest(df: DataFrame, keys: list[str], wanted: DataFrame, order: str, **options) -> DataFrame:
    """The rows of every group whose ``order`` is among the ``size`` smallest, for ``wanted`` (keys, size); orders must differ.

    Only the one order value that divides a group is looked for, so no group is sorted, whatever its size.
    """
    last = order_statistics(df, keys, wanted.select(*keys, F.lit("last").alias("name"), (F.col("size") - 1).alias("rank_at")), order, **options)
    return df.join(wanted.select(*keys, "size"), keys).join(last.select(*keys, F.col("v").alias("__last")), keys, "left").where(
        (F.col("size") > 0) & (F.col("__last").isNull() | (F.col(order) <= F.col("__last")))).drop("__last", "size")
