"""Hard negatives: scores cut into slots at the positives' limits, the best kept per slot, windows read from suffix merges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.rows import small
from almanac.plans.lineage import cut

SHARD = 1 << 15
TILE = 1 << 12
STEP = 256
FAN = 16
EXACT = float(1 << 53)
LISTS = "anchor_id long, slot int, vec_id long, score long, shard int"


def labelled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v as array of doubles) of the rows with an id, a label and a vector of finite components.

    Of rows that repeat an id the one with the smallest label and vector counts.
    """
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    again = cut(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if again.isEmpty():
        return rows
    settled = (rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.*"))
    return rows.join(again, "id", "left_anti").unionByName(settled)


def products(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Exact whole-number products of every row of ``a`` with every row of ``b``."""
    a, b = np.stack(a.to_numpy()), np.stack(b.to_numpy())
    # Doubles hold whole numbers below 2**53 exactly, so the fast product is exact there.
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) >= EXACT:
        a, b = a.astype(np.int64), b.astype(np.int64)
    return (a @ b.T).astype(np.int64)


def best_allowed(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed scores of every row, ties to smaller columns."""
    n = scores.shape[1]
    masked = np.where(allowed, scores, np.iinfo(np.int64).min)
    least = np.partition(masked, n - min(k, n), axis=1)[:, n - min(k, n)]
    r, c = np.nonzero(allowed & (masked >= least[:, None]))
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first]


def _cell_lists(anchors: pd.DataFrame, rows: pd.DataFrame, slots: Callable, k: int) -> pd.DataFrame:
    """The k best rows per anchor and slot of one cell; ``slots`` gives (slot, allowed) masks of a strip of scores."""
    out = {"anchor_id": [], "slot": [], "vec_id": [], "score": []}
    rows = rows.sort_values("id")
    for size, a in anchors.groupby(anchors["v"].str.len()):
        b = rows[rows["v"].str.len() == size]
        if not len(b):
            continue
        ids = b["id"].to_numpy(np.int64)
        for at in range(0, len(a), STEP):
            strip = a.iloc[at:at + STEP]
            scores = products(strip["v"], b["v"])
            own = strip["id"].to_numpy(np.int64)
            for slot, allowed in slots(strip, b, scores):
                r, c = best_allowed(scores, allowed, k)
                out["anchor_id"].append(own[r])
                out["slot"].append(np.full(len(r), slot, np.int64))
                out["vec_id"].append(ids[c])
                out["score"].append(scores[r, c])
    return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})


def _merged(lists: DataFrame, k: int, shards: int) -> DataFrame:
    """The k best per anchor and slot over all shards, ``FAN`` shards at a time, with ``rank`` from 1."""
    while True:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        order = Window.partitionBy("anchor_id", "slot", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        shards = -(-shards // FAN)
        if shards <= 1:
            return lists.drop("shard")
        lists = lists.drop("rank")


def _spread(of: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(of), n).cast("int")


def _all_of(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))


def _grid(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], cell: Callable) -> DataFrame:
    """``cell`` on the anchors and rows of every cell; anchors go by names of their own, as they may come from the same table."""
    own = left.select([F.col(c).alias(f"anchor_{c}") for c in [*keys, *columns]])

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return cell(key, a.rename(columns=lambda c: c.removeprefix("anchor_")), b)

    return own.groupBy(*[f"anchor_{c}" for c in keys]).cogroup(
        right.select([c for c in [*keys, *columns] if c in right.columns]).groupBy(*keys)).applyInPandas(run, LISTS)


def best_positives(rows: DataFrame, anchors: DataFrame, k: int = 5, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """(anchor_id, rank, positive_id, positive_score): the k best other rows of every anchor's own label.

    Only rows of equal labels meet. A label of more than ``shard`` rows has a grid of its own, of
    shards against tiles of anchors; the others share cells by a hash of the label.
    """
    counted = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard)
    asked = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("asked"))
    # At most one row for every ``shard`` rows of the table.
    hot = small(counted.join(asked, "label", "left").select(
        "label", F.ceil(F.col("n") / shard).alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("asked", F.lit(0)) / tile)).alias("tiles")))
    groups = max(1, -(-rows.count() // shard))

    def dealt(df: DataFrame) -> DataFrame:
        return (df.join(hot, "label", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn(
            "group", F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("label"), F.lit(groups))).otherwise(F.xxhash64("label")))
            .withColumn("tiles", F.coalesce("tiles", F.lit(1))))

    right = dealt(rows.select("id", "label", "v")).withColumn("shard", _spread(F.col("id"), F.col("shards"))).withColumn("tile", _all_of(F.col("tiles")))
    left = dealt(anchors.select("id", "label", "v")).withColumn("tile", _spread(F.col("id"), F.col("tiles"))).withColumn("shard", _all_of(F.col("shards")))

    def slots(strip, b, scores):
        same = strip["label"].to_numpy()[:, None] == b["label"].to_numpy()[None, :]
        yield 0, same & (strip["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :])

    def cell(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _cell_lists(a, b, slots, k).assign(shard=key[1])

    lists = _grid(left, right, ["group", "shard", "tile"], ["id", "label", "v"], cell)
    most = hot.agg(F.max("shards")).first()[0] or 1
    return _merged(lists, k, int(most)).select(
        "anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))


def slot_lists(rows: DataFrame, anchors: DataFrame, k: int, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """(anchor_id, slot, vec_id, score, rank): the k best rows of another label in every slot of every anchor.

    ``anchors`` have descending ``upper`` limits and the ``lower`` limits that belong to them. Slot j
    (from 1) holds the scores of at most upper[j] and above upper[j + 1]: the slots are disjoint
    though the windows overlap. Scores below all of lower[:j] serve no window that reaches into slot j.
    """
    n_shards, n_tiles = max(1, -(-rows.count() // shard)), max(1, -(-anchors.count() // tile))
    right = rows.select("id", "label", "v").withColumn("shard", _spread(F.col("id"), F.lit(n_shards))).withColumn("tile", _all_of(F.lit(n_tiles)))
    left = (anchors.select("id", "label", "v", "upper", "lower").withColumn("tile", _spread(F.col("id"), F.lit(n_tiles)))
            .withColumn("shard", _all_of(F.lit(n_shards))))

    def slots(strip, b, scores):
        other = strip["label"].to_numpy()[:, None] != b["label"].to_numpy()[None, :]
        n = strip["upper"].str.len().to_numpy()
        least = np.iinfo(np.int64).min
        limits = np.full((len(strip), n.max() + 1), least)
        lower = np.full((len(strip), n.max()), np.iinfo(np.int64).max)
        for r, (up, low) in enumerate(zip(strip["upper"], strip["lower"])):
            limits[r, :len(up)], lower[r, :len(low)] = up, low
        lower = np.minimum.accumulate(lower, axis=1)
        for j in range(n.max()):
            below, above, floor = limits[:, j, None], limits[:, j + 1, None], lower[:, j, None]
            yield j + 1, other & (scores <= below) & (scores > above) & (scores >= floor)

    def cell(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _cell_lists(a, b, slots, k).assign(shard=key[0])

    lists = _grid(left, right, ["shard", "tile"], ["id", "label", "v", "upper", "lower"], cell)
    return _merged(lists, k, n_shards)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100,
                   shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    ``rows`` and ``anchors`` are (id, label, v) with whole-number doubles and unique ids, see
    :func:`labelled`. A score is the inner product with the anchor; higher scores come first, ties
    by smaller id. An anchor's positives are its first ``positives`` other rows of its label; for
    each, the first ``negatives`` rows of other labels whose score is from ``lower`` to ``upper``
    percent of the positive's. (A negative positive score has no such rows if lower < upper.)

    The positives' upper limits cut an anchor's scores into disjoint slots. Every cell of a grid of
    shards and anchor tiles keeps its best per slot, lists are merged as a tree, and a window's
    rows are the first ones of its slot and all lower slots: merged from the lowest slot up, one
    list answers each window. So a row is scored once however many windows overlap.

    Fewer rows than asked give fewer; an anchor without positives, vectors of other lengths and
    empty tables give none. Products must fit 64 bits; ``upper`` must be above 0.
    """
    # Every anchor's table of at most ``positives`` rows. Limits are whole scores: no score lies between a limit and its percent.
    score = "CAST(positive_score AS DECIMAL(20, 0))"
    best = cut(best_positives(rows, anchors, positives, shard, tile).select(
        "*", F.expr(f"CAST(floor({score} * {upper} / 100) AS BIGINT)").alias("up"),
        F.expr(f"CAST(ceil({score} * {lower} / 100) AS BIGINT)").alias("low")))
    limits = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "up", "low"))).alias("l")).select(
        F.col("anchor_id").alias("id"), F.col("l.up").alias("upper"), F.col("l.low").alias("lower"))
    found = slot_lists(rows, cut(anchors.join(limits, "id")), negatives, shard, tile)
    # A slot's list descends, and every score of a slot is above those of the next one.
    entry = F.struct((-F.col("score")).alias("less"), F.col("vec_id"))
    by_slot = found.groupBy("anchor_id").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("slot") == j, entry))).alias(f"slot{j}") for j in range(1, positives + 1)])
    merged = F.col(f"slot{positives}")
    suffixes = [merged]
    for j in range(positives - 1, 0, -1):
        merged = F.slice(F.concat(f"slot{j}", merged), 1, negatives)
        suffixes.insert(0, merged)
    windows = by_slot.select("anchor_id", F.array(*suffixes).alias("suffix"))
    inside = F.filter(F.element_at("suffix", F.col("rank")), lambda x: -x["less"] >= F.col("low"))
    return (best.join(windows, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "row"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("row.vec_id").alias("negative_id"),
                    "positive_score", (-F.col("row.less")).alias("negative_score")))
