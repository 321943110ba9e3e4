"""MinHash near-dedup of weighted shingles by improved consistent weighted sampling.

A text is a bag of five-word shingles. A shingle weighs its count in the text times
1 + ln((N + 1) / (df + 1)) / ln(SLOTS), where df is the number of texts with its slot: as usual
for hashed TF-IDF, document frequencies are kept for ``SLOTS`` hash slots, counted over all N
texts. The table's size is fixed and shares df / N don't change with the size of the input.

For every hash the sampling draws, for each shingle of weight w, gamma variates r and c and a
uniform b from the shingle's hash alone; with t = floor(ln w / r + b), the shingle with the least
c * exp(-r * (t + 1 - b)) is taken, together with t. Two texts take the same pair with the
probability of their weighted Jaccard similarity. Samples are banded; texts that share a band
are candidates; candidates are verified by the exact weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.graph import components
from almanac.llm.hashing import counted, mix, seeds, shingles, slices, word_hashes
from almanac.llm.rows import one_text_per_id
from almanac.plans.lineage import TEXT_BATCH, cut

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
BANDS = 10
ROWS = 3
CHUNK = 1 << 14
GRID = 2048
AGREE = 0.6
"""Share of equal samples that a pair as similar as 0.8 misses once in some hundred times, one of 0.85 once in ten thousand."""

_LEVELS = 1 << 12
_ODD = seeds(256, 41) | np.uint64(1)
_EVEN = seeds(256, 42)


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution with shape two: the inverse of 1 - (1 + x) exp(-x)."""
    u = (np.arange(_LEVELS) + 0.5) / _LEVELS
    low, high = np.zeros(_LEVELS), np.full(_LEVELS, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low.astype(np.float32)


_R = _gamma_quantiles()
_INVERSE_R = 1 / _R


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with counts, and where each text's begin."""
    return counted(*shingles(*word_hashes(texts)))


def samples(values: np.ndarray, log_weights: np.ndarray, starts: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """``n`` 32-bit samples of each bag; a bag without shingles has zeros."""
    out = np.zeros((len(starts) - 1, n), np.uint32)
    some = np.flatnonzero(np.diff(starts) > 0)
    if not len(some):
        return out
    first = starts[some]
    owner = np.repeat(np.arange(len(some)), np.diff(np.append(first, len(values))))
    score, chosen_t = np.empty(len(values), np.float32), np.empty(len(values), np.float32)
    for i in range(n):
        for at in range(0, len(values), CHUNK):
            x = values[at:at + CHUNK] * _ODD[i]
            x += _EVEN[i]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            r_at = (x & np.uint64(_LEVELS - 1)).astype(np.int16)
            b = ((x >> np.uint64(12)) & np.uint64(_LEVELS - 1)).astype(np.float32)
            b *= np.float32(1 / _LEVELS)
            u = ((x >> np.uint64(24)) & np.uint64((1 << 20) - 1)).astype(np.float32)
            u += np.float32(0.5)
            v = (x >> np.uint64(44)).astype(np.float32)
            v += np.float32(0.5)
            u *= np.float32(2.0 ** -20)
            v *= np.float32(2.0 ** -20)
            u *= v
            t = np.floor(log_weights[at:at + CHUNK] * _INVERSE_R[r_at] + b)
            score[at:at + CHUNK] = np.log(-np.log(u)) - _R[r_at] * (t + 1 - b)
            chosen_t[at:at + CHUNK] = t
        least = np.minimum.reduceat(score, first)
        hits = np.flatnonzero(score == least[owner])
        own, pick = np.unique(owner[hits], return_index=True)
        k = hits[pick]
        out[some[own], i] = (mix(values[k] + (chosen_t[k].astype(np.int64) << 48).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Texts per slot, and texts with a shingle, over all rows; summed on executors, ``SLOTS`` numbers in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                values, _, starts = bags(part.column("text"))
                owner = np.repeat(np.arange(part.num_rows, dtype=np.uint64), np.diff(starts))
                slot, _, _ = counted(values >> np.uint64(48 - SLOT_BITS), starts) if len(values) else (values, 0, 0)
                total += np.bincount(slot.astype(np.int64), minlength=SLOTS)
                texts += len(np.unique(owner))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(total[hit], texts))], ["slot", "n"])

    sums = (docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
            .toArrow().to_pandas())
    df = np.zeros(SLOTS, np.int64)
    slot, n = sums["slot"].to_numpy(np.int64), sums["n"].to_numpy(np.int64)
    df[slot[slot >= 0]] = n[slot >= 0]
    return df, int(n[slot < 0].sum())


def rarity(df: np.ndarray, texts: int) -> np.ndarray:
    return (1 + np.log((texts + 1) / (df + 1)) / np.log(SLOTS)).astype(np.float32)


def _weights(values: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    return counts.astype(np.float32) * table[(values >> np.uint64(48 - SLOT_BITS)).astype(np.int64)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted values, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    return float(both / max(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - both, 1e-300))


def signatures(docs: DataFrame, table) -> DataFrame:
    """doc_id, content (128-bit fingerprint of the bag), sample and band keys of every text with a word."""
    place = seeds(BANDS * ROWS, 43) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, counts, starts = bags(part.column("text"))
                own = samples(values, np.log(_weights(values, counts, table.value)), starts)
                keep = np.flatnonzero(np.diff(starts) > 0)
                each = mix(values + mix(counts.astype(np.uint64) << np.uint64(48)))
                prints = np.stack([np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (each, mix(each + np.uint64(7)))])
                prints = (prints[:, starts[1:]] - prints[:, starts[:-1]])[:, keep]
                keys = mix((own[keep].astype(np.uint64) * place).reshape(len(keep), BANDS, ROWS).sum(axis=2, dtype=np.uint64))
                flat = lambda m, kind: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(keep)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                     flat(own[keep].view(np.int32), pa.int32()), flat(keys.view(np.int64), pa.int64())],
                    ["doc_id", "print_a", "print_b", "sample", "keys"])
    return docs.mapInArrow(run, "doc_id long, print_a long, print_b long, sample array<int>, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, table, threshold: float) -> DataFrame:
    """The (src, dst) of ``pairs`` whose texts are as similar as ``threshold``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, tuple] = {}  # within a batch: a leader's text comes once for each of its members

            def bag(column: str, row: int, text: str):
                if text not in seen:
                    values, counts, _ = bags(pa.array([text]))
                    seen[text] = (values, _weights(values, counts, table.value))
                return seen[text]
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                seen.clear()
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                keep = [similarity(bag("a", i, x), bag("b", i, y)) >= threshold for i, (x, y) in enumerate(zip(a, b))]
                yield pa.RecordBatch.from_arrays([part.column("src"), part.column("dst")], ["src", "dst"]).filter(pa.array(keep))

    a = texts.select(F.col("doc_id").alias("src"), F.col("text").alias("a"))
    b = texts.select(F.col("doc_id").alias("dst"), F.col("text").alias("b"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def _unlinked(a: pd.DataFrame, b: pd.DataFrame, table: np.ndarray, threshold: float) -> pd.DataFrame:
    """Links between rows of ``a`` and ``b`` in different components, one for each two components.

    Rows whose samples agree too little are left out first. The rest of a row's similarities are
    summed in one go over the lists of rows of ``b`` that have each of its shingles.
    """
    empty = pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})
    if not len(a) or not len(b):
        return empty
    x, y = np.stack(a["sample"].to_numpy()), np.stack(b["sample"].to_numpy())
    comp_a, comp_b = a["component"].to_numpy(), b["component"].to_numpy()
    apart = comp_a[:, None] != comp_b[None, :]
    near = np.zeros(apart.shape, bool)
    for at in range(0, len(x), 256):
        rows = x[at:at + 256]
        hits = sum((rows[:, k:k + 1] == y[None, :, k]).astype(np.int8) for k in range(x.shape[1]))
        near[at:at + 256] = (hits >= AGREE * x.shape[1]) & apart[at:at + 256]
    mine, theirs = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(mine):
        return empty
    near = near[np.ix_(mine, theirs)]

    def weighted(texts):
        values, counts, starts = bags(pa.array(texts, pa.string()))
        return values, _weights(values, counts, table).astype(np.float64), starts
    va, wa, sa = weighted(a["text"].iloc[mine])
    vb, wb, sb = weighted(b["text"].iloc[theirs])
    owner = np.repeat(np.arange(len(theirs)), np.diff(sb))
    order = np.argsort(vb, kind="stable")
    vb, owner, wb_sorted = vb[order], owner[order], wb[order]
    low, high = np.searchsorted(vb, va), np.searchsorted(vb, va, side="right")
    total_a = np.add.reduceat(wa, sa[:-1])
    total_b = np.add.reduceat(wb, sb[:-1])
    src, dst, done = [], [], set()
    for r in range(len(mine)):
        lo, hi = low[sa[r]:sa[r + 1]], high[sa[r]:sa[r + 1]]
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], np.minimum(np.repeat(wa[sa[r]:sa[r + 1]], n), wb_sorted[at]), len(theirs))
        for c in np.flatnonzero(near[r] & (both >= threshold * (total_a[r] + total_b - both))):
            i, j = a.index[mine[r]], b.index[theirs[c]]
            pair = (comp_a[mine[r]], comp_b[theirs[c]])
            if pair not in done:
                done |= {pair, pair[::-1]}
                src.append(a["id"].at[i])
                dst.append(b["id"].at[j])
    return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})


def residual_links(banded: DataFrame, label: DataFrame, texts: DataFrame, table, threshold: float) -> DataFrame:
    """Links that the leaders left out: between rows of one bucket in different components.

    Only buckets of three rows or more, in two components or more, have any: in smaller ones the
    leader's checks were all. A bucket is cut into blocks of ``GRID`` rows that meet as a grid, one
    group per pair of blocks, whatever its size; buckets of one block are taken together in groups.
    """
    rows = banded.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = cut(rows.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
                .where("lo <> hi and n > 2").select("band", "key", "n", F.ceil(F.col("n") / GRID).cast("int").alias("cuts")))
    small = mixed.where("cuts = 1").agg(F.sum("n")).scalar()
    groups = F.greatest(F.lit(1), F.coalesce(small, F.lit(0)) / F.lit(2 * GRID)).cast("int")
    grid = (rows.join(mixed.withColumn("groups", groups), ["band", "key"])
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            .withColumn("bucket", F.xxhash64("band", "key"))
            .withColumn("group", F.when(F.col("cuts") > 1, F.col("bucket")).otherwise(F.pmod("bucket", "groups")))
            .select("group", "cuts", "i", "j", "band", "key", "own", "id", "component", "sample")
            .join(texts.select(F.col("doc_id").alias("id"), "text"), "id"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, i, j = key
        found = [_unlinked(own[own["own"] == i], own[own["own"] == j], table.value, threshold) for _, own in pdf.groupby(["band", "key"])]
        return pd.concat(found)

    return grid.groupBy("group", "cuts", "i", "j").applyInPandas(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the group), n_class, kept for every row with a doc_id.

    Texts with equal bags are one class from the start, whatever their number. Classes meet in
    bands: each is checked against its bucket's smallest id, which is one pair per class and band
    for a bucket of any size; pairs of a bucket that are then still in different groups, and whose
    samples agree enough, are checked as well. Groups are the connected components of the links.

    A text without a word (null, empty, punctuation only) is in a class of its own. Texts of one to
    four words have one shingle and so link only with equal ones. Rows that repeat a doc_id count
    as one, by their smallest text; rows without an id are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = one_text_per_id(docs)
    table = spark.sparkContext.broadcast(rarity(*document_frequencies(plain)))  # SLOTS numbers
    signed = cut(signatures(plain, table), TEXT_BATCH)
    classes = signed.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("rep"))
    of_doc = cut(signed.select("doc_id", "print_a", "print_b").join(classes, ["print_a", "print_b"]).select("doc_id", "rep"))
    reps = signed.join(of_doc.where("doc_id = rep"), "doc_id").select(F.col("doc_id").alias("id"), "sample", "keys")
    banded = reps.select("id", "sample", F.posexplode("keys").alias("band", "key"))
    leaders = banded.groupBy("band", "key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(banded.join(leaders.drop("n"), ["band", "key"]))  # rows of buckets with two classes or more
    pairs = shared.where("id <> leader").select(F.col("id").alias("src"), F.col("leader").alias("dst")).distinct()
    texts = cut(plain.join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    links = cut(verified(pairs, texts, table, threshold), TEXT_BATCH)
    label = components(links)
    left = cut(residual_links(shared.drop("leader"), label, texts, table, threshold))
    if not left.isEmpty():
        label = components(links.unionAll(left))
    members = (plain.select("doc_id").join(of_doc.select("doc_id", "rep"), "doc_id", "left")
               .join(label.withColumnRenamed("id", "rep"), "rep", "left")
               .select("doc_id", F.coalesce("component", "rep", "doc_id").alias("class_id")))
    members = cut(members)
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_class"))
    return members.join(sizes, "class_id").select("doc_id", "class_id", "n_class", (F.col("doc_id") == F.col("class_id")).alias("kept"))
