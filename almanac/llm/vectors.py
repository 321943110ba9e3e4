"""Embedding near-dedup: sorted projection passes, and exact links inside what they join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.graph import components
from almanac.llm.topk import finite
from almanac.plans.lineage import cut

BLOCK = 2048
RECALL = 0.99
STEP = 512


def passes_for(n: int, threshold: float, block: int = BLOCK, recall: float = RECALL) -> int:
    """Passes until a pair with that cosine has met in a window with probability ``recall``.

    Two vectors at angle a get the same random bit with probability 1 - a / pi, and meet if they
    share about as many leading bits as leave two blocks of vectors.
    """
    bits = max(0.0, math.log2(max(1, n) / (2 * block)))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if p > recall else math.ceil(math.log(1 - recall) / math.log(1 - p))


def _units(rows: pd.Series) -> np.ndarray:
    """Vectors of length one; the largest component is divided out first, so squares don't overflow."""
    m = np.stack(rows.to_numpy()).astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def mean_directions(vectors: DataFrame) -> DataFrame:
    """(dim, mean, length): the mean of all vectors of a dimension, each taken at length one, and that mean's squared length."""
    def sums(batches):
        total = {}
        for pdf in batches:
            for dim, own in pdf.groupby(pdf["v"].str.len()):
                n, so_far = total.get(dim, (0, 0.0))
                total[dim] = n + len(own), so_far + _units(own["v"]).sum(axis=0)
        if total:
            yield pd.DataFrame({"dim": list(total), "n": [n for n, _ in total.values()], "total": [x for _, x in total.values()]})

    def fold(pdf):
        mean = np.stack(pdf["total"].to_numpy()).sum(axis=0) / pdf["n"].sum()
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "mean": [mean], "length": [float(mean @ mean)]})

    # A row per task and dimension.
    return vectors.select("v").mapInPandas(sums, "dim int, n long, total array<double>").groupBy("dim").applyInPandas(
        fold, "dim int, mean array<double>, length double")


def rest_cosine(threshold: float, length: float) -> float:
    """Cosine of a pair at the threshold once a mean of that squared length is taken off both; not below 0."""
    left = max(1e-9, 1 - length)
    return max(0.0, 1 - (1 - threshold) / left)


def keys(vectors: DataFrame, means: DataFrame, passes: int) -> DataFrame:
    """(pass, dim, key, rep): 64 random sign bits of every vector's deviation from the mean direction, for every pass.

    Without that, vectors of a common cone would share most of their bits.
    """
    def run(batches):
        for pdf in batches:
            for dim, own in pdf.groupby(pdf["v"].str.len()):
                unit = _units(own["v"]) - np.asarray(own["mean"].iloc[0])
                for p in range(passes):
                    planes = np.random.default_rng([p, dim]).standard_normal((dim, 64))
                    bits = np.packbits(unit @ planes >= 0, axis=1).view(">i8").ravel()
                    yield pd.DataFrame({"pass": p, "dim": dim, "key": bits.astype(np.int64), "rep": own["rep"].to_numpy()})
    joined = vectors.select("rep", "v", F.size("v").alias("dim")).join(means.select("dim", "mean"), "dim")
    return joined.mapInPandas(run, "pass int, dim int, key long, rep long")


def ranked(sortable: DataFrame, *order: str) -> DataFrame:
    """Rows with ``rank`` from 0 in the given order, by one range exchange and one number per partition."""
    deal = cut(sortable.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = deal.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (deal.withColumn("part", part).join(F.broadcast(offsets), "part")
            .withColumn("rank", F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "offset"))


def _joined(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric link matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def window_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """For the rows of a block and of the block before it: (src, dst) to the smallest row each is joined with."""
    src, dst = [], []
    for _, own in pdf.drop_duplicates("rep").sort_values("rep").groupby(pdf["v"].str.len()):
        unit, rep = _units(own["v"]), own["rep"].to_numpy()
        linked = np.empty((len(rep), len(rep)), bool)
        for at in range(0, len(rep), STEP):
            linked[at:at + STEP] = unit[at:at + STEP] @ unit.T >= threshold
        linked |= linked.T
        some = np.flatnonzero(linked.sum(axis=1) > 1)
        if len(some):
            label = some[_joined(linked[np.ix_(some, some)])]
            src.append(rep[some][label < some])
            dst.append(rep[label][label < some])
    none = np.zeros(0, np.int64)
    return pd.DataFrame({"src": np.concatenate([none, *src]), "dst": np.concatenate([none, *dst])})


def _count(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> np.ndarray:
    """For every row of ``a``, how many vectors it is linked with, each row of ``b`` standing for ``n`` equal ones."""
    left, right, n = _units(a["v"]), _units(b["v"]), b["n"].to_numpy(np.float64)
    out = np.zeros(len(a))
    for at in range(0, len(a), STEP):
        out[at:at + STEP] = (left[at:at + STEP] @ right.T >= threshold) @ n
    return out.astype(np.int64)


def link_counts(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(rep, links): other vectors within the threshold, among all of the same component (rep, component, v, n).

    Components of up to ``block`` rows are taken together in groups of about that size. A larger
    one is cut into blocks that meet as a grid, one group per pair of blocks.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    groups = F.greatest(F.lit(1), F.lit(members.count() // block))
    cuts = F.ceil(F.col("size") / block)
    own = F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    grid = (members.join(sizes, "component").withColumn("cuts", cuts.cast("int")).withColumn("own", own).withColumn("other", other)
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            .withColumn("group", F.when(F.col("cuts") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), groups))))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        out = []
        for _, c in pdf.groupby("component"):
            a, b = c[c["own"] == i], c[c["own"] == j]
            if i == j:
                out.append(pd.DataFrame({"rep": a["rep"], "links": _count(a, a, threshold) - 1}))
            elif len(a) and len(b):
                out.append(pd.DataFrame({"rep": a["rep"], "links": _count(a, b, threshold)}))
                out.append(pd.DataFrame({"rep": b["rep"], "links": _count(b, a, threshold)}))
        return pd.concat(out) if out else pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})

    parts = grid.groupBy("group", "i", "j").applyInPandas(run, "rep long, links long")
    return parts.groupBy("rep").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                 block: int = BLOCK, passes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Equal vectors are taken as one with a count. Each pass sorts the vectors by 64 random sign
    bits of what is left without the mean direction, and compares every vector with its own block of ``block`` neighbours and the one before;
    verified pairs are joined across passes. Links are then counted among all vectors of a
    component, so a group wider than a window still gets its exact counts.

    Null, zero and non-finite vectors, and rows without an id, link with nothing: n_links 0 and
    their own component, kept. Vectors of different lengths don't meet. Rows that repeat an id
    count as rows. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("raw"))
    usable = finite(rows, "vec_id", "raw").where(F.exists("v", lambda x: x != 0))
    reps = cut(usable.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
               .select(F.col("least").alias("rep"), "n", "v"))
    means = cut(mean_directions(reps))
    if passes is None:
        longest = means.agg(F.max("length")).first()[0] or 0.0
        passes = passes_for(reps.count(), rest_cosine(threshold, longest), block)
    rank = ranked(keys(reps, means, passes), "pass", "dim", "key", "rep")
    own = F.floor(F.col("rank") / block).cast("long")
    near = rank.select("rep", F.explode(F.array(own, own + 1)).alias("block"))
    links = cut(near.join(reps.select("rep", "v"), "rep").groupBy("block").applyInPandas(
        lambda pdf: window_links(pdf, threshold), "src long, dst long").distinct())
    label = components(links).withColumnRenamed("id", "rep")
    members = cut(reps.join(label, "rep"))
    counts = link_counts(members, threshold, block)
    found = (reps.join(label, "rep", "left").join(counts, "rep", "left")
             .select("v", F.coalesce("component", "rep").alias("component"),
                     F.coalesce("links", F.col("n") - 1).alias("links")))
    usable_v = F.when(F.col("vec_id").isNotNull(), F.col("raw"))
    return (rows.withColumn("v", usable_v).join(found, "v", "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
