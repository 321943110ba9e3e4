"""Gaps filled by the quadratic spline through all known points of a series.

Pieces meet midway between known points; the first and the last piece reach over two points. Their
curvatures solve a tridiagonal system, cut into blocks of points: each block is shortened to its two
ends, the ends of a series are solved together, and each block is filled in again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions import chains
from almanac.operators.sifting import _padded
from almanac.plans import blocks, scans
from almanac.plans.lineage import cut

KEYS = ["station_code", "station"]
_SCHEMA = "block long, n int, first double, last double"


def _chains(points: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, block, t, y, edge_t, edge_y): inner points by blocks, each with the first point of the next block at its end.

    ``points`` have idx from 1 to n; inner are those from 2 to n - 1. ``edge_t`` and ``edge_y`` are the series' first two
    and last two points.
    """
    ends = points.groupBy(*keys).agg(*[F.max(F.when(cond, F.col(c))).alias(f"{c}_{name}") for c in ("pos", "value") for name, cond in (
        ("a", F.col("idx") == 1), ("b", F.col("idx") == 2), ("c", F.col("idx") == F.col("n") - 1), ("d", F.col("idx") == F.col("n")))])
    inner = points.where("n >= 3 and idx > 1 and idx < n")
    own = F.floor((F.col("idx") - 2) / size)
    # The first point of a block closes the block before it.
    both = inner.withColumn("block", F.explode(F.when((own > 0) & ((F.col("idx") - 2) % size == 0), F.array(own - 1, own)).otherwise(F.array(own))))
    packed = both.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("double").alias("t"), F.col("value").alias("y")))).alias("rows"))
    return packed.join(ends, keys).select(
        *keys, "block", F.col("rows.t").alias("t"), F.col("rows.y").alias("y"),
        F.array(*[F.col(f"pos_{c}").cast("double") for c in "abcd"]).alias("edge_t"), F.array(*[F.col(f"value_{c}") for c in "abcd"]).alias("edge_y"))


def _links(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t, y, n = _padded(list(zip(pdf["t"], pdf["y"])))
            chain = chains.shorten(t, y, n, chains.QUADRATIC)
            yield pdf[[*keys, "block", "edge_t", "edge_y"]].assign(n=n, link=list(np.stack([chain.d0, chain.u, chain.d1, chain.r0, chain.r1], axis=1)))
    return run


def _edges(keys: list[str]):
    """Curvatures at both ends of every block; a last block of one point, which the block before it has too, has one."""
    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for a, b in zip(starts, np.r_[starts[1:], len(pdf)]):
            own = pdf.iloc[a:b]
            links = [tuple(link) for link, n in zip(own["link"], own["n"]) if n > 1]
            t, y = own["edge_t"].iloc[0], own["edge_y"].iloc[0]
            slope = lambda i: (y[i + 1] - y[i]) / (t[i + 1] - t[i])  # noqa: E731, B023
            ends = (4 * (t[1] - t[0]), -4 * slope(0), 4 * (t[3] - t[2]), 4 * slope(2))
            c = chains.solve_ends(len(links) + 1, links, ends)
            out.append(own[[*keys, "block", "n"]].assign(first=c[:len(own)], last=c[np.minimum(np.arange(len(own)) + 1, len(c) - 1)]))
        return pd.concat(out)
    return run


def _curvatures(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t, y, n = _padded(list(zip(pdf["t"], pdf["y"])))
            c = chains.fill(t, n, chains.shorten(t, y, n, chains.QUADRATIC), pdf["first"].to_numpy(float), pdf["last"].to_numpy(float))
            yield pdf[[*keys, "block", "t", "y", "edge_t", "edge_y"]].assign(c=[c[i, :k] for i, k in enumerate(n)])
    return run


def quadratic_pieces(points: DataFrame, keys: list[str] = KEYS, size: int = 0) -> DataFrame:
    """(keys, at, y, slope, c): the piece y + slope (x - at) + c (x - at)^2 of every inner point of ``points`` (keys, pos, value, idx, n).

    Series of fewer than three points have no piece.
    """
    size = size or blocks.BLOCK
    kinds = dict(points.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    arrays = "edge_t array<double>, edge_y array<double>"
    rows = cut(_chains(points, keys, size))
    links = rows.mapInPandas(_links(keys), f"{head}, block long, {arrays}, n int, link array<double>")
    edges = scans.whole_groups(links, keys, ["block"], _edges(keys), f"{head}, {_SCHEMA}")
    bent = rows.join(edges.drop("n"), [*keys, "block"]).mapInPandas(
        _curvatures(keys), f"{head}, block long, t array<double>, y array<double>, {arrays}, c array<double>")
    # The slope at a point follows from its own curvature and the next one's, at the last inner point from the last gap.
    last = F.size("t") == F.col("i") + 1
    h, rise = F.get("t", F.col("i") + 1) - F.col("e.t"), F.get("y", F.col("i") + 1) - F.col("e.y")
    inside = rise / h - (3 * F.col("e.c") + F.get("c", F.col("i") + 1)) * h / 4
    end_h = F.col("edge_t")[3] - F.col("e.t")
    at_end = (F.col("edge_y")[3] - F.col("e.y")) / end_h - F.col("e.c") * end_h
    pieces = bent.select(*keys, "t", "y", "c", "edge_t", "edge_y", F.posexplode(F.arrays_zip("t", "y", "c")).alias("i", "e"))
    closing = last & (F.col("e.t") == F.col("edge_t")[2])
    # A point that closes a block begins the next one, which has its slope.
    return pieces.where(~last | closing).select(
        *keys, F.col("e.t").cast("long").alias("at"), F.col("e.y").alias("y"), F.when(closing, at_end).otherwise(inside).alias("slope"),
        F.col("e.c").alias("c")).dropDuplicates([*keys, "at"])


def impute_spline(df: DataFrame, keys: list[str] = KEYS, size: int = 0, split: bool = False) -> DataFrame:
    """``df`` with gaps filled by the quadratic spline through all known points, and ``imputed``; nearest value at the edges.

    The spline passes through every known point with a continuous slope. Two known points give the line
    between them, one its value; a series without any stays without. ``split`` is for series without the daily bound.
    """
    known = cut(blocks.number_rows(df.where("value is not null").select(*keys, "date", "value", F.col("pos").alias("own")), keys, split=split)
                .select(*keys, "date", "value", F.col("pos").alias("idx"), "n", F.col("own").alias("pos")))
    pieces = quadratic_pieces(known, keys, size)
    bounds = known.where("n >= 3").groupBy(*keys).agg(
        F.max(F.when(F.col("idx") == 2, F.col("pos"))).alias("second"), F.max(F.when(F.col("idx") == F.col("n") - 1, F.col("pos"))).alias("last_but_one"))
    near = blocks.neighbours(df, keys, split=split).join(bounds, keys, "left")
    nearest = F.when(2 * F.col("pos") < F.col("prev_pos") + F.col("next_pos"), F.col("prev_pos")).otherwise(F.col("next_pos"))
    at = F.least(F.greatest(nearest, F.col("second")), F.col("last_but_one"))
    gap = F.col("value").isNull() & F.col("prev_pos").isNotNull() & F.col("next_pos").isNotNull() & F.col("second").isNotNull()
    rows = near.withColumn("at", F.when(gap, at)).join(pieces, [*keys, "at"], "left")
    x = F.col("pos") - F.col("at")
    line = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * F.try_divide(
        (F.col("pos") - F.col("prev_pos")).cast("double"), (F.col("next_pos") - F.col("prev_pos")).cast("double"))
    filled = F.coalesce("value", F.when(gap, F.col("y") + F.col("slope") * x + F.col("c") * x * x), line, "prev_value", "next_value")
    return rows.select(*keys, "date", "pos", filled.alias("value"), F.col("value").isNull().alias("imputed"))
