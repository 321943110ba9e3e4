"""Averaged subword vectors with a softmax on top: shared parts of the two text classifiers.

A text is its white-space separated pieces, lower-cased. Each piece has hashed features: itself
and its character n-grams between the marks ``<`` and ``>``; pairs of neighbouring pieces may
add a feature each. Every feature has a learned vector; a text's vector is their mean; a softmax
over two classes reads it. All vectors and the softmax are trained together by stochastic
gradient descent in numpy, on a bounded sample of the labelled rows.

At scoring the softmax's difference is applied to each feature's vector once, which leaves one
number per feature; a text's score is the mean of its features' numbers. That is the same
function, and the model is a fixed table of ``2**bits`` numbers at any size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.hashing import mix, seeds, slices
from almanac.plans.lineage import cut

_PLACE = seeds(16, 21) | np.uint64(1)


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    dim: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    pairs: bool = True
    min_texts: int = 5
    prior: float = 1.0
    """How much of the log-odds of label 1 among all labelled rows is added to balanced scores."""
    rows: int = 2000
    """Most labelled rows of each class to train on: those with the smallest hash of their id."""
    epochs: int = 8
    batch: int = 16
    rate: float = 0.3
    adapt: bool = True
    """Each feature's step shrinks with the slopes it has seen, so rare features learn as far as common ones."""
    scale: float = 30.0
    """Factor on the mean before the softmax: a text's few telling features are a small share of all."""
    seed: int = 1
    strip: bool = False
    """Drop ASCII punctuation at both ends of a piece."""
    chance: float = 0.0
    """Features whose shares of the two classes' texts differ by fewer standard errors are left out (0: none).

    In a long text a few telling features drown in the mean of all; those that tell nothing add only
    what was learned by heart.
    """


@dataclass
class Model:
    table: np.ndarray = field(repr=False)
    bias: float = 0.0


def pieces(texts: pa.Array, strip: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, each text's pieces as positions in them, and where each text begins."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(lists)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if strip:
        names = pc.ascii_trim(names, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    empty = pc.equal(names, "").to_numpy(zero_copy_only=False)
    keep = ~empty[codes] if len(codes) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(counts)), counts)[keep]
    return names.to_pylist(), codes[keep], np.searchsorted(owner, np.arange(len(counts) + 1))


def piece_features(names: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots of every piece, the piece of each, and a 64-bit hash per piece."""
    joined = np.frombuffer(("<" + "><".join(names) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) + 2 for x in names], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(names)), sizes)
    whole = np.zeros(len(joined), np.uint64)
    scrambled = mix(joined)
    within = np.arange(len(joined)) - (ends - sizes)[owner]
    whole = np.add.reduceat(scrambled * mix(within.astype(np.uint64) | np.uint64(1) << np.uint64(40)), ends - sizes)
    hashes = mix(whole)
    slots, owners = [hashes >> np.uint64(64 - s.bits)], [np.arange(len(names))]
    for n in s.grams:
        if len(joined) < n:
            continue
        acc = np.zeros(len(joined) - n + 1, np.uint64)
        for j in range(n):
            acc += joined[j:len(joined) - n + 1 + j] * _PLACE[j]
        inside = np.flatnonzero(np.arange(len(acc)) + n <= ends[owner[:len(acc)]])
        slots.append(mix(acc[inside] + np.uint64(n << 56)) >> np.uint64(64 - s.bits))
        owners.append(owner[inside])
    return np.concatenate(slots).astype(np.int64), np.concatenate(owners), hashes


def pair_slots(hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Slots of neighbouring pieces and the text of each; a piece that follows itself has one shared slot."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    same = owner[1:] == owner[:-1]
    a, b = hashes[codes[:-1]][same], hashes[codes[1:]][same]
    slot = mix(a * _PLACE[8] + b * _PLACE[9]) >> np.uint64(64 - s.bits)
    return np.where(a == b, np.uint64(1), slot).astype(np.int64), owner[1:][same]


def features(batch: pa.RecordBatch, s: Settings) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct slots of each text with their shares of its features."""
    names, codes, starts = pieces(batch.column("text"), s.strip)
    texts = batch.num_rows
    if not len(codes):
        return [np.zeros(0, np.int64)] * texts, [np.zeros(0)] * texts
    slots, owners, hashes = piece_features(names, s)
    order = np.argsort(owners, kind="stable")
    slots, first = slots[order], np.searchsorted(owners[order], np.arange(len(names) + 1))
    owner = np.repeat(np.arange(texts), np.diff(starts))
    word, n = np.unique(owner * len(names) + codes, return_counts=True)
    sizes = np.diff(first)[word % len(names)]
    at = np.repeat(first[word % len(names)] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    keys = np.repeat(word // len(names), sizes) << s.bits | slots[at]
    weight = np.repeat(n, sizes)
    if s.pairs:
        pair, pair_text = pair_slots(hashes, codes, starts, s)
        keys = np.concatenate([keys, pair_text << s.bits | pair])
        weight = np.concatenate([weight, np.ones(len(pair), np.int64)])
    keys, at = np.unique(keys, return_inverse=True)
    count = np.bincount(at, weight, len(keys))
    text = keys >> s.bits
    share = count / np.bincount(text, count, texts)[text]
    cuts = np.searchsorted(text, np.arange(1, texts))
    return np.split(keys & ((1 << s.bits) - 1), cuts), np.split(share, cuts)


def sample(docs: DataFrame, marks: DataFrame, s: Settings) -> tuple[pd.DataFrame, float]:
    """Features of at most ``s.rows`` rows of each class, made on the executors, and the log-odds of label 1
    among all labelled rows, from (doc_id, text) and (doc_id, label). Only ids are shuffled to choose them."""
    labelled = docs.select("doc_id").join(marks, "doc_id").where("label in (0, 1)")
    chosen = [labelled.where(F.col("label") == v).select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.rows)
              for v in (0, 1)]
    ids = chosen[0].unionAll(chosen[1])  # at most twice s.rows ids
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, shares = features(part, s)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label").cast(pa.int32()),
                     pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                     pa.array([x.astype(np.float32) for x in shares], pa.list_(pa.float32()))],
                    ["doc_id", "label", "ids", "shares"])
    made = texts.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, ids array<int>, shares array<float>")
    if s.chance:
        made = telling(cut(made), s)
    return (made.toArrow().to_pandas().sort_values("doc_id", ignore_index=True),
            float(np.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5))))


def telling(made: DataFrame, s: Settings) -> DataFrame:
    """``made`` (doc_id, label, ids, shares) with the features alone whose classes differ by more than chance.

    Texts with a feature are counted per class; only the telling slots, 2**bits at most, leave the executors.
    """
    sizes = {r["label"]: r["n"] for r in made.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return made
    counts = made.select("label", F.explode("ids").alias("slot")).groupBy("slot").agg(
        F.sum("label").alias("in_ones"), F.count(F.lit(1)).alias("n"))
    share = F.col("n") / (ones + zeros)
    apart = F.abs(F.col("in_ones") / ones - (F.col("n") - F.col("in_ones")) / zeros)
    kept = counts.where((F.col("n") >= s.min_texts) & (apart > s.chance * F.sqrt(share * (1 - share) * (1 / ones + 1 / zeros) + 1e-9)))
    mask = np.zeros(1 << s.bits, bool)
    mask[kept.select("slot").toArrow()["slot"].to_numpy()] = True
    shared = made.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, shares = batch.column("ids"), batch.column("shares")
            flat = lists.flatten().to_numpy()
            keep = shared.value[flat]
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[keep])),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(shares.flatten().to_numpy()[keep]))], ["doc_id", "label", "ids", "shares"])
    return made.mapInArrow(run, made.schema)


def train(rows: pd.DataFrame, s: Settings, odds: float = 0.0) -> Model:
    """Stochastic gradient descent in small batches with a falling rate; classes weigh the same in sum.

    ``odds`` are the log-odds of label 1 in the whole; the share ``s.prior`` of them is added at the
    end, all of them for probabilities as in the whole, less to miss fewer of a rare class. Without rows of both classes every text gets those odds.
    """
    rows = rows[rows["ids"].str.len() > 0]
    y = rows["label"].to_numpy(np.int64)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(1 << s.bits, np.float32), odds)
    rng = np.random.default_rng(s.seed)
    weight = (len(y) / (2 * np.bincount(y, minlength=2))).astype(np.float32)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.1, (2, s.dim)).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_top, seen_bias = np.zeros(1 << s.bits, np.float32), np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    ids, shares = rows["ids"].to_numpy(), rows["shares"].to_numpy()
    # Features of fewer texts than that can only be learned by heart; their vectors stay zero.
    texts = np.bincount(np.concatenate(ids), minlength=1 << s.bits)
    usual = texts >= s.min_texts
    vectors[~usual] = 0
    ids, shares = [x[usual[x]] for x in ids], [v[usual[x]].astype(np.float32) for x, v in zip(ids, shares)]
    order = rng.permutation(len(y))
    batches = []
    for at in range(0, len(y), s.batch):
        take = order[at:at + s.batch]
        take = take[[len(ids[t]) > 0 for t in take]]
        if not len(take):
            continue
        flat = [ids[t] for t in take]
        sizes = np.array([len(x) for x in flat])
        flat, share = np.concatenate(flat), np.concatenate([shares[t] for t in take]).astype(np.float32)
        text = np.repeat(np.arange(len(take), dtype=np.int32), sizes)
        by = np.argsort(flat, kind="stable").astype(np.int32)
        own = np.flatnonzero(np.diff(flat[by], prepend=-1)).astype(np.int32)
        batches.append((flat, share[:, None], np.concatenate([[0], np.cumsum(sizes)[:-1]]), text, by, flat[by][own], own, y[take]))
    del ids, shares, rows
    steps, step = s.epochs * len(batches), 0
    for _ in range(s.epochs):
        for b in rng.permutation(len(batches)):
            flat, share, first, text, by, slots, own, label = batches[b]
            rate, step = s.rate * (1 - step / steps), step + 1
            mean = s.scale * np.add.reduceat(vectors[flat] * share, first)
            logit = mean @ softmax.T + bias
            logit = np.exp(logit - logit.max(1, keepdims=True))
            wrong = logit / logit.sum(1, keepdims=True)
            wrong[np.arange(len(label)), label] -= 1
            wrong *= weight[label][:, None]
            slope = np.add.reduceat(((wrong @ softmax)[text] * share)[by], own)
            if not s.adapt:
                vectors[slots] -= rate * slope
                softmax -= 0.02 * rate * wrong.T @ mean
                bias -= 0.02 * rate * wrong.sum(0)
                continue
            seen[slots] += (slope ** 2).mean(1)
            vectors[slots] -= rate * slope / np.sqrt(seen[slots] + 1e-12)[:, None]
            top, base = wrong.T @ mean, wrong.sum(0)
            seen_top += top ** 2
            seen_bias += base ** 2
            softmax -= 0.1 * rate * top / np.sqrt(seen_top + 1e-12)
            bias -= 0.1 * rate * base / np.sqrt(seen_bias + 1e-12)
    return Model(s.scale * vectors @ (softmax[1] - softmax[0]), float(bias[1] - bias[0]) + s.prior * odds)


def score_texts(texts: pa.Array, model: Model, s: Settings) -> np.ndarray:
    """Probability of label 1 for each text; an empty or null text has the bias alone."""
    names, codes, starts = pieces(texts, s.strip)
    n_texts = len(texts)
    total, count = np.zeros(n_texts), np.zeros(n_texts)
    if len(codes):
        slots, owners, hashes = piece_features(names, s)
        value = np.bincount(owners, model.table[slots], len(names))
        size = np.bincount(owners, minlength=len(names)).astype(float)
        owner = np.repeat(np.arange(n_texts), np.diff(starts))
        total += np.bincount(owner, value[codes], n_texts)
        count += np.bincount(owner, size[codes], n_texts)
        if s.pairs:
            pair, text = pair_slots(hashes, codes, starts, s)
            total += np.bincount(text, model.table[pair], n_texts)
            count += np.bincount(text, minlength=n_texts)
    logit = total / np.maximum(count, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def score(docs: DataFrame, model: Model, s: Settings) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score_texts(part.column("text"), shared.value, s))], ["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def below(docs: DataFrame, model: Model, s: Settings, limit: float) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(score_texts(part.column("text"), shared.value, s) < limit))
    return docs.mapInArrow(run, docs.schema)


def held_out(modulus: int, remainder: int):
    """True where the id's remainder keeps the row's label from the fit; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
