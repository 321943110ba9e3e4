"""Associative scans over the blocks of series, and grouped work in streams of whole groups.

A series is cut into blocks; every block is one element, an array of numbers. Elements are
combined ``FAN`` at a time up a tree and handed down again, so no task holds a series' elements.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.plans.lineage import cut

FAN = 64


def whole_groups(df: DataFrame, group: list[str], order: list[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``fn(rows, starts)`` on streams of whole groups: rows in order, ``starts`` the first row of each group.

    Groups must be small; many of them make one call, unlike with ``applyInPandas``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            number = pdf.groupby(group, sort=False, dropna=False).ngroup().to_numpy()
            at = int(np.searchsorted(number, number[-1]))
            if at:
                yield fn(pdf.iloc[:at].reset_index(drop=True), np.flatnonzero(np.r_[True, np.diff(number[:at]) != 0]))
            rest = pdf.iloc[at:]
        if rest is not None and len(rest):
            yield fn(rest.reset_index(drop=True), np.zeros(1, int))

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)


def segment_fold(e: np.ndarray, starts: np.ndarray, combine: Callable) -> np.ndarray:
    """The product of each segment's rows, combined pairwise."""
    ends = np.r_[starts[1:], len(e)]
    size = ends - starts
    while size.max(initial=1) > 1:
        own = np.repeat(np.arange(len(size)), size)
        rank = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
        left = rank % 2 == 0
        has = left & (rank + 1 < size[own])
        out = e[left].copy()
        i = np.flatnonzero(has)
        out[has[left]] = combine(e[i], e[i + 1])
        e, size = out, (size + 1) // 2
    return e


def segment_scan(e: np.ndarray, starts: np.ndarray, combine: Callable) -> np.ndarray:
    """Inclusive products from the start of each segment, in rounds of doubling reach."""
    rank = np.arange(len(e)) - np.repeat(starts, np.diff(np.r_[starts, len(e)]))
    out, reach = e.copy(), 1
    while reach <= rank.max(initial=0):
        i = np.flatnonzero(rank >= reach)
        out[i] = combine(out[i - reach], out[i])
        reach *= 2
    return out


def totals(elements: DataFrame, keys: list[str], combine: Callable, fan: int = FAN) -> DataFrame:
    """(keys, e): the product of each series' elements (keys, block, e) in the order of blocks."""
    most = elements.agg(F.max("block")).first()[0]
    kinds = dict(elements.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block long, e array<double>"

    def fold(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = pdf.iloc[starts][[*keys, "up"]].rename(columns={"up": "block"})
        return out.assign(e=list(segment_fold(np.stack(pdf["e"].to_numpy()), starts, combine)))

    rows = elements.select(*keys, "block", "e")
    while True:
        rows = whole_groups(rows.withColumn("up", F.floor(F.col("block") / fan)), [*keys, "up"], ["block"], fold, schema)
        most = (most or 0) // fan
        if most == 0:
            return rows.drop("block")


def before_blocks(elements: DataFrame, keys: list[str], combine: Callable, start: np.ndarray, fan: int = FAN) -> DataFrame:
    """(keys, block, e): ``start`` times the product of all earlier elements of the series.

    ``elements`` (keys, block, e) should be a written table, as every level of the tree reads the one below.
    """
    most = elements.agg(F.max("block")).first()[0] or 0
    kinds = dict(elements.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    rows = elements.select(*keys, "block", "e").withColumn("up", F.floor(F.col("block") / fan))

    def handed(e: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Exclusive products, beginning with ``first`` of each segment."""
        inclusive = segment_scan(e, starts, combine)
        size = np.diff(np.r_[starts, len(e)])
        outer = np.repeat(first, size, axis=0)
        out = outer.copy()
        inner = np.ones(len(e), bool)
        inner[starts] = False
        i = np.flatnonzero(inner)
        out[i] = combine(outer[i], inclusive[i - 1])
        return out

    if most < fan:
        def down(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            first = np.repeat(start[None, :], len(starts), axis=0)
            return pdf[[*keys, "block"]].assign(e=list(handed(np.stack(pdf["e"].to_numpy()), starts, first)))
        return whole_groups(rows, [*keys, "up"], ["block"], down, f"{head}, block long, e array<double>")

    def fold(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = pdf.iloc[starts][[*keys, "up"]].rename(columns={"up": "block"})
        return out.assign(e=list(segment_fold(np.stack(pdf["e"].to_numpy()), starts, combine)))

    upper = cut(whole_groups(rows, [*keys, "up"], ["block"], fold, f"{head}, block long, e array<double>"))
    outer = before_blocks(upper, keys, combine, start, fan).withColumnRenamed("block", "up").withColumnRenamed("e", "outer")

    def join_down(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        first = np.stack(pdf["outer"].to_numpy()[starts])
        return pdf[[*keys, "block"]].assign(e=list(handed(np.stack(pdf["e"].to_numpy()), starts, first)))
    return whole_groups(rows.join(outer, [*keys, "up"]), [*keys, "up"], ["block"], join_down, f"{head}, block long, e array<double>")
