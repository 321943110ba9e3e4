"""Language identification: known words by per-language log frequency, backing off to n-grams.

A word is a maximal run of bytes other than ASCII white space and punctuation in the lower-cased
text. A word known in any language scores its smoothed log relative frequency in each. For an
unseen word the longest character n-grams of it that are known anywhere are averaged; if none of
that length is known, shorter ones are tried, down to single characters.

Words and n-grams are counted over at most ``ROWS`` rows that may be learned from, dealt evenly
over languages: the documented bound on what is learned from and sent to executors. The model keeps
all that was counted. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.embedding_bag import held_out
from almanac.llm.hashing import mix, seeds, slices

ROWS = 6_000
LONGEST = 5
UNDETERMINED = "und"
_PLACE = seeds(8, 31) | np.uint64(1)
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words with a letter, each text's words as positions in them, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    names = pc.ascii_trim(coded.dictionary, _MARKS)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    letters = pc.match_substring_regex(names, r"\p{L}").to_numpy(zero_copy_only=False)
    keep = letters[codes] if len(codes) else np.zeros(0, bool)
    return names, codes[keep], np.repeat(np.arange(len(counts)), counts)[keep]


def _grams(names: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash per character n-gram of the words between spaces, and the word of each; the length is part of it."""
    chars = np.frombuffer((" " + "  ".join(names) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) + 2 for x in names], np.int64)
    if len(chars) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(names)), sizes)
    acc = np.zeros(len(chars) - n + 1, np.uint64)
    for j in range(n):
        acc += chars[j:len(chars) - n + 1 + j] * _PLACE[j]
    inside = np.flatnonzero(np.arange(len(acc)) + n <= np.cumsum(sizes)[owner[:len(acc)]])
    return mix(acc[inside] + np.uint64(n << 56)), owner[inside]


def _word_keys(names: list[str]) -> np.ndarray:
    chars = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) for x in names], np.int64)
    ends = np.cumsum(sizes)
    within = np.arange(len(chars)) - np.repeat(ends - sizes, sizes)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(chars) * mix(within.astype(np.uint64) + np.uint64(1 << 40)), dtype=np.uint64)])
    return mix(sums[ends] - sums[ends - sizes])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (length 0) and n-grams by language, for each slice."""
    for batch in batches:
        for part in slices(batch):
            names, codes, text = _words(part.column("text"))
            if not len(codes):
                continue
            tongue = part.column("lang").dictionary_encode()
            lang = tongue.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n_lang = len(tongue.dictionary)
            pair, count = np.unique(lang[text] * len(names) + codes, return_counts=True)
            used, at = np.unique(pair % len(names), return_inverse=True)
            words = names.take(pa.array(used)).to_pylist()
            rows = [(_word_keys(words)[at], np.zeros(len(at), np.int8), pair // len(names), count)]
            per = np.zeros((n_lang, len(words)))
            per[pair // len(names), at] = count
            for n in range(1, LONGEST + 1):
                key, owner = _grams(words, n)
                key, slot = np.unique(key, return_inverse=True)
                for own in range(n_lang):
                    total = np.bincount(slot, per[own][owner], len(key))
                    hit = np.flatnonzero(total)
                    rows.append((key[hit], np.full(len(hit), n, np.int8), np.full(len(hit), own), total[hit].astype(np.int64)))
            key, size, own, count = (np.concatenate(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(size.astype(np.int32)),
                 tongue.dictionary.take(pa.array(own)), pa.array(count.astype(np.int64))], ["key", "size", "lang", "n"])


class Model:
    """Log frequencies of hashed words and n-grams: sorted keys with a row of numbers per language."""

    def __init__(self, counts, langs: list[str]):
        self.langs = langs
        self.tables = []
        place = {name: i for i, name in enumerate(langs)}
        for size in range(LONGEST + 1):
            own = counts[counts["size"] == size]
            keys, at = np.unique(own["key"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
            n = np.zeros((len(keys), len(langs)))
            np.add.at(n, (at, own["lang"].map(place).to_numpy(np.int64)), own["n"].to_numpy(float))
            self.tables.append((keys, np.log((n + 0.1) / (n.sum(0) + 0.1 * max(1, len(keys))))))

    def _find(self, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, rows = self.tables[size]
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        return (known[at] == keys if len(known) else np.zeros(len(keys), bool)), at

    def words(self, names: list[str]) -> np.ndarray:
        """A row of scores per word."""
        out = np.zeros((len(names), len(self.langs)))
        known, at = self._find(0, _word_keys(names))
        out[known] = self.tables[0][1][at[known]]
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            keys, owner = _grams([names[i] for i in left], n)
            known, at = self._find(n, keys)
            count = np.bincount(owner[known], minlength=len(left))
            rows = self.tables[n][1][at[known]]
            for j in range(len(self.langs)):
                total = np.bincount(owner[known], rows[:, j], len(left))
                out[left, j] += np.where(count > 0, total / np.maximum(count, 1), 0)
            left = left[count == 0]
        return out


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """(text, lang) of at most ``rows`` rows with a language, dealt evenly over languages by a hash of the id."""
    usable = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang")
    first = Window.partitionBy("lang", "salt").orderBy(F.xxhash64("doc_id"), "doc_id")  # a frequent language in 64 parts
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (usable.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(64)))
           .withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= -(-rows // 16))
           .withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= rows)
           .orderBy("turn", "lang", "doc_id").limit(rows).select("doc_id", "lang"))
    return docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).select("text", "lang")


def fit(docs: DataFrame, rows: int = ROWS) -> Model:
    """Counts of all words and n-grams of at most ``rows`` rows."""
    counts = (sample(docs, rows).mapInArrow(_counts, "key long, size int, lang string, n long")
              .groupBy("key", "size", "lang").agg(F.sum("n").alias("n"))).toArrow().to_pandas()
    return Model(counts, sorted(counts["lang"].unique()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row; see ``language``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                names, codes, text = _words(part.column("text"))
                n = part.num_rows
                label, score = np.full(n, UNDETERMINED, object), np.zeros(n)
                if len(codes) and m.langs:
                    used, at = np.unique(codes, return_inverse=True)
                    each = m.words(names.take(pa.array(used)).to_pylist())[at]
                    count = np.bincount(text, minlength=n)
                    total = np.stack([np.bincount(text, each[:, j], n) for j in range(len(m.langs))], 1)
                    some = count > 0
                    rel = np.exp(total - total.max(1, keepdims=True))
                    best = total.argmax(1)
                    label[some] = np.array(m.langs, object)[best[some]]
                    score[some] = (rel.max(1) / rel.sum(1))[some]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(label, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the winner's posterior under even priors) for every row.

    It learns from ``text`` and non-null ``lang`` of rows whose id's crc32 doesn't leave
    ``remainder``; it predicts from ``text`` alone. A null text or one without a letter is ``und``
    with score 0, and so is every text if nothing could be learned. Ties go to the name first in
    order. Rows with null or repeated ids are treated like others; no rows give none.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    model = fit(plain.where(~held_out(modulus, remainder)))
    return predict(plain, model).select("doc_id", held_out(modulus, remainder).alias("held_out"), "lang_pred", "score")
