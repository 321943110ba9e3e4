"""Exact top-k search: tiled products of queries and shards, partial selection, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD = 1 << 15
TILE = 1 << 12
STEP = 512
FAN = 16
EXACT = float(1 << 53)


def finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v as array of doubles) of the vectors without null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best of each row with ties to smaller ids; ``ids`` ascend. Rows with the query's own id take no part."""
    low, high = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
    rows = np.arange(len(own))
    floor = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
    for r in np.flatnonzero(high > low):
        scores[r, low[r]:high[r]] = floor
    least = np.partition(scores, len(ids) - min(k, len(ids)), axis=1)[:, len(ids) - min(k, len(ids))]
    for r in rows:
        n = min(k, len(ids) - (high[r] - low[r]))
        keep = np.flatnonzero(scores[r] >= least[r])
        if high[r] > low[r]:
            keep = keep[(keep < low[r]) | (keep >= high[r])]
        keep = keep[np.argsort(-scores[r][keep], kind="stable")][:n]
        yield r, keep, scores[r][keep]


def tile_product(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best shard rows for each query of one tile. Products stay exact whole numbers."""
    found = {"query_id": [], "vec_id": [], "score": []}
    if not len(queries) or not len(shard):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in found})
    shard = shard.sort_values("id")
    for size, q in queries.groupby(queries["v"].str.len()):
        s = shard[shard["v"].str.len() == size]
        if not len(s):
            continue
        a, b = np.stack(q["v"].to_numpy()), np.stack(s["v"].to_numpy())
        # Doubles hold whole numbers below 2**53 exactly, so the fast product is exact there.
        if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(size, 1) >= EXACT:
            a, b = a.astype(np.int64), b.astype(np.int64)
        ids, own = s["id"].to_numpy(), q["id"].to_numpy()
        for at in range(0, len(a), STEP):
            for r, keep, score in _best(a[at:at + STEP] @ b.T, ids, own[at:at + STEP], k):
                found["query_id"].append(np.full(len(keep), own[at + r]))
                found["vec_id"].append(ids[keep])
                found["score"].append(score.astype(np.int64))
    return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in found.items()})


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k largest inner products of every query.

    Both inputs are (id, v) with whole-number doubles. Rows meet as a grid: shards
    of about ``shard`` candidates against tiles of about ``tile`` queries, each cell one task's
    group, so no side is ever held whole. Each cell keeps its k best per query (partial
    selection); lists are then merged ``FAN`` shards at a time until one is left per query.

    Candidates with the query's own id take no part. Rows that repeat an id count as rows: a candidate may
    come twice in a list, and queries of one id share one list. Ties go to the smaller id; vectors of
    different lengths have no product and don't meet; fewer candidates than k give fewer rows;
    empty inputs give none. Products must fit 64 bits.
    """
    n_shards = max(1, -(-candidates.count() // shard))
    n_tiles = max(1, -(-queries.count() // tile))

    def grid(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))))

    c = grid(candidates.select("id", "v"), "shard", n_shards, "tile", n_tiles)
    q = grid(queries.select("id", "v"), "tile", n_tiles, "shard", n_shards).select(
        F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("shard").alias("q_shard"), F.col("tile").alias("q_tile"))

    def cell(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return tile_product(left.rename(columns={"q_id": "id", "q_v": "v"}), right, k).assign(shard=key[0])

    lists = q.groupBy("q_shard", "q_tile").cogroup(c.groupBy("shard", "tile")).applyInPandas(
        cell, "query_id long, vec_id long, score long, shard int")
    while True:
        order = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        n_shards = -(-n_shards // FAN)
        lists = (lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
                 .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if n_shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
