"""Window work over station series, and how it is spread over tasks.

A daily series has one row per station and date, so a station never has more rows than the
calendar has days, however many raw records stand behind them: those are combined per
station and date before any shuffle. Cheap frames without bound (carry a value, running
sums, numbering) therefore run per station by default, in one pass and one shuffle.

Two tools split a station further:

* ``halo`` cuts positions into blocks (``block_size``) and copies the rows just outside a
  block into it. All frames of bounded reach use it, because their work per row is heavy.
* ``split=True`` on ``carry``, ``running_sums`` and ``number_rows`` combines one summary row
  per block and joins it back. It is for series without the daily bound, such as readings
  every second: no task then holds more than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 4096


def block_size(reach: int) -> int:
    """Small blocks balance tasks, but the copied rows should stay an eighth of a block at most."""
    return min(BLOCK, max(512, 8 * reach))


def block_window(keys: list[str], order: str = "pos") -> WindowSpec:
    return Window.partitionBy(*keys, "block").orderBy(order)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows by key and block over the session's shuffle partitions.

    The windows above reuse this exchange. It is explicit because frame work is heavy on CPU
    for its bytes, and adaptive coalescing, which looks at bytes, would put it into one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys, "block")


def halo(df: DataFrame, keys: list[str], before: int = 0, after: int = 0, size: int = 0) -> DataFrame:
    """Add ``block`` and ``core``; rows near an edge are copied to the blocks whose frames reach them."""
    size = size or block_size(before + after)
    own = F.floor((F.col("pos") - 1) / size)
    first = F.greatest(F.floor((F.col("pos") - 1 - after) / size), F.lit(0).cast("bigint"))
    last = F.floor((F.col("pos") - 1 + before) / size)
    out = (
        df.withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("core", F.col("block") == own)
    )
    return spread(out, keys)


def core(df: DataFrame) -> DataFrame:
    """Keep each row once, in its own block."""
    return df.filter("core").drop("block", "core")


def framed(df: DataFrame, keys: list[str], exprs, before: int = 0, after: int = 0, size: int = 0) -> DataFrame:
    """Evaluate bounded-reach window expressions ``exprs(window) -> {name: column}``."""
    w = block_window(keys)
    return core(halo(df, keys, before, after, size).withColumns(exprs(w)))


def centred_mean(df: DataFrame, keys: list[str], value: str, half: int, out: str) -> DataFrame:
    """Mean over ``half`` rows either side, and the frame's row count as ``{out}_rows``.

    Works inside the blocks of ``halo``; frames are cut at the ends of the series. Taken as
    differences of cumulative sums, so the cost per row does not grow with the width.
    """
    w = block_window(keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.col(value)
    cums = ("c_sum", "c_cnt", "c_row")
    cum = df.withColumns({
        "c_sum": F.sum(F.coalesce(v, F.lit(0.0))).over(upto), "c_cnt": F.count(v).over(upto),
        "c_row": F.row_number().over(w),
    }).withColumns({
        **{f"{c}_hi": F.coalesce(F.lead(c, half).over(w), F.last(c).over(whole)) for c in cums},
        **{f"{c}_lo": F.coalesce(F.lag(c, half + 1).over(w), F.lit(0)) for c in cums},
    })
    return cum.withColumns({
        out: F.try_divide(F.col("c_sum_hi") - F.col("c_sum_lo"), F.col("c_cnt_hi") - F.col("c_cnt_lo")),
        f"{out}_rows": F.col("c_row_hi") - F.col("c_row_lo"),
    }).drop(*[f"{c}{e}" for c in cums for e in ("", "_hi", "_lo")])


def number_rows(df: DataFrame, keys: list[str], date: str = "date", size: int = 0, split: bool = False) -> DataFrame:
    """1-based row numbers ``pos`` and row count ``n`` in date order within each key.

    Split, rows are counted per block of calendar days, the block counts are summed, and
    only the numbering inside a block needs a sort.
    """
    if not split:
        w = Window.partitionBy(*keys).orderBy(date)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({
            "pos": F.row_number().over(w).cast("bigint"), "n": F.count(F.lit(1)).over(whole),
        })
    size = size or BLOCK
    cut = df.withColumn("block", F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / size))
    counts = cut.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("rows_here"))
    w = Window.partitionBy(*keys).orderBy("block")
    whole = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys, "block",
        (F.sum("rows_here").over(w) - F.col("rows_here")).alias("offset"),
        F.sum("rows_here").over(whole).alias("n"),
    )
    inner = Window.partitionBy(*keys, "block").orderBy(date)
    return (
        cut.withColumn("rn", F.row_number().over(inner))
        .join(offsets, [*keys, "block"])
        .withColumn("pos", F.col("rn") + F.col("offset"))
        .drop("block", "rn", "offset")
    )


def running_sums(
    df: DataFrame, keys: list[str], sums: dict[str, Column], size: int = 0, split: bool = False
) -> DataFrame:
    """Inclusive running sums over ``pos`` for each ``{name: column}``."""
    rows = df.withColumns(dict(sums))
    if not split:
        w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums})
    size = size or BLOCK
    cut = rows.withColumn("block", F.floor((F.col("pos") - 1) / size))
    per_block = cut.groupBy(*keys, "block").agg(*[F.sum(c).alias(c) for c in sums])
    w = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_block.select(*keys, "block", *[F.sum(c).over(w).alias(f"{c}__in") for c in sums])
    inner = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({c: F.sum(c).over(inner) for c in sums}).join(earlier, [*keys, "block"])
    return out.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"{c}__in"), F.lit(0)) for c in sums}
    ).drop("block", *[f"{c}__in" for c in sums])


def _nearest(name: str, side: str, own_row: bool, keys: list[str]) -> Column:
    # looking ahead is looking back in descending order: a frame that runs to the end of the
    # partition would be re-evaluated from every row
    order = F.col("pos") if side == "back" else F.col("pos").desc()
    w = Window.partitionBy(*keys).orderBy(order)
    return F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0 if own_row else -1))


def carry(
    df: DataFrame, keys: list[str], specs: dict[str, tuple[str, str, bool]], size: int = 0, split: bool = False
) -> DataFrame:
    """Nearest non-null value of a column at or around each row, over frames without bound.

    ``specs`` maps an output name to (column, "back" or "ahead", true if the row itself counts).
    """
    if not split:
        return df.withColumns({out: _nearest(*spec, keys) for out, spec in specs.items()})
    size = size or BLOCK
    cut = df.withColumn("block", F.floor((F.col("pos") - 1) / size))
    ends, outside = [], []
    for out, (name, side, _own) in specs.items():
        at = F.when(F.col(name).isNotNull(), F.col("pos"))
        ends.append((F.max_by if side == "back" else F.min_by)(name, at).alias(out))
        order = F.col("block") if side == "back" else F.col("block").desc()
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        outside.append(F.last(out, ignorenulls=True).over(w).alias(f"{out}__in"))
    carried = cut.groupBy(*keys, "block").agg(*ends).select(*keys, "block", *outside)
    return (
        cut.withColumns({out: _nearest(*spec, [*keys, "block"]) for out, spec in specs.items()})
        .join(carried, [*keys, "block"])
        .withColumns({out: F.coalesce(F.col(out), F.col(f"{out}__in")) for out in specs})
        .drop("block", *[f"{out}__in" for out in specs])
    )


def neighbours(df: DataFrame, keys: list[str], value: str = "value", size: int = 0, split: bool = False) -> DataFrame:
    """Add the nearest known points around every row: ``prev_pos, prev_value, next_pos, next_value``."""
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(value).alias("v")))
    out = carry(
        df.withColumn("pt", point), keys,
        {"pt_prev": ("pt", "back", True), "pt_next": ("pt", "ahead", True)}, size, split,
    )
    return out.withColumns({
        "prev_pos": F.col("pt_prev.p"), "prev_value": F.col("pt_prev.v"),
        "next_pos": F.col("pt_next.p"), "next_value": F.col("pt_next.v"),
    }).drop("pt", "pt_prev", "pt_next")
