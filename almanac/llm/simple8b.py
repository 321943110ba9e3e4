"""Token-id files in word-aligned Simple-8b coding.

A 64-bit word holds a selector in its top four bits and a whole number of equally wide ids below.
Selectors 0 and 1 stand for 240 and 120 zeros. An id that needs more than 60 bits, or would look
like the mark, is escaped: a one-id word with all bits set, then the id in a word of its own.
A block is the words of some whole documents in order, with the place of every document's first
id, the number of ids, and the positions of escaped words, so that any block can be decoded by
itself with array operations.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.hashing import slices
from almanac.llm.memo import Memo, per_text
from almanac.plans.lineage import scratch_path

# Fixed values of the coding: ids in a word and bits of each, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
MARK = np.uint64((15 << 60) | ((1 << 60) - 1))
LARGEST = (1 << 60) - 2
BLOCK_IDS = 1 << 16
SLICE = 1 << 22
AT_ONCE = 1 << 13
"""Segments that a worker encodes at once."""


_SMALL = np.array([x.bit_length() for x in range(1 << 16)], np.int8)


def _width(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if ids.max() < 1 << 16:
        return _SMALL[ids.astype(np.int64)]
    out = np.zeros(len(ids), np.int8)
    for k in range(4):
        part = (ids >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        out = np.where(part > 0, _SMALL[part.astype(np.int64)] + 16 * k, out).astype(np.int8)
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids and the positions of words that hold an escaped id. The longest fitting run is packed."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    escaped = ids > LARGEST
    plain = np.where(escaped, np.uint64(0), ids) if escaped.any() else ids
    width = _width(plain)
    width[escaped] = 61
    select = np.full(n, 15, np.int8)
    low, top = width.min(), width.max()
    for s in range(14, -1, -1):
        if BITS[s] < low:
            break
        if BITS[s] >= top:
            select[:] = s
            continue
        # A run fits unless a wider id comes before its end; past the last id there is nothing wide.
        wide = np.flatnonzero(width > BITS[s])
        begins, ends = np.concatenate([[0], wide + 1]), np.append(wide, n + max(COUNTS))
        good = ends - begins >= COUNTS[s]
        if not good.any():
            break  # nor does a narrower and longer one
        begins, ends = begins[good], ends[good]
        size = np.maximum(np.minimum(ends - COUNTS[s] + 1, n) - begins, 0)
        select[np.repeat(begins - np.cumsum(size) + size, size) + np.arange(size.sum())] = s
    step = np.array(COUNTS)[select].tolist()
    begins, i = [], 0
    note = begins.append
    while i < n:
        note(i)
        i += step[i]
    begins = np.array(begins)
    select = select[begins]
    padded = np.concatenate([plain, np.zeros(max(COUNTS), np.uint64)])
    words = select.astype(np.uint64) << np.uint64(60)
    for s in np.unique(select):
        if BITS[s]:
            rows = np.flatnonzero(select == s)
            shift = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            words[rows] |= np.bitwise_or.reduce(padded[begins[rows][:, None] + np.arange(COUNTS[s])] << shift, axis=1)
    out = np.flatnonzero(escaped[begins])
    if len(out):
        words[out] = MARK
        words = np.insert(words, out + 1, ids[begins[out]])
    return words, out + 1 + np.arange(len(out))


def decode(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block."""
    raw = np.zeros(len(words), bool)
    raw[escapes] = True
    marks = np.delete(words, escapes) if len(escapes) else words
    select = (marks >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[select]
    begins = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) + 1, np.uint64)
    for s in np.unique(select):
        if BITS[s]:
            rows = np.flatnonzero(select == s)
            shift = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            out[begins[rows][:, None] + np.arange(COUNTS[s])] = (marks[rows][:, None] >> shift) & np.uint64((1 << BITS[s]) - 1)
    if len(escapes):
        out[begins[np.flatnonzero(marks == MARK)]] = words[escapes]
    return out[:n]


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    def ids(names: list[str]) -> list[list[int]]:
        # The tokenizer's objects are large beside their ids; the fast form leaves out the places of tokens in their text.
        return [x.ids for at in range(0, len(names), AT_ONCE)
                for x in tokenizer.encode_batch_fast(names[at:at + AT_ONCE], add_special_tokens=False)]
    return Memo(ids)


def tokenise(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts and where each text's begin.

    The vocabulary's pattern never joins characters across white space, so a text's ids are those
    of its white-space separated segments; each distinct segment is encoded once.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ids, sizes = _memo(path).ids(pc.list_flatten(lists))
    return ids, per_text(lists, sizes)


BLOCK = ("shard int, block int, n_ids long, doc_ids array<long>, starts array<long>, words binary, escapes array<int>")
_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("starts", pa.list_(pa.int64())), ("words", pa.binary()), ("escapes", pa.list_(pa.int32()))])


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1) -> None:
    """Write the ids of every text to files in ``folder``, in ascending doc_id order.

    Documents are dealt by id ranges; each task writes its range, the shard, as blocks of about
    ``BLOCK_IDS`` ids of whole documents (a longer document is a block of its own). Null texts
    are empty and have the end id alone; null ids come first; repeated ids stay, in any order;
    no documents give no blocks. Other columns are ignored.
    """
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size, block
            ids = np.concatenate([x for _, x in held])
            words, escapes = encode(ids)
            sizes = np.array([len(x) for _, x in held])
            row = [[shard], [block], [len(ids)], [[d for d, _ in held]], [(np.cumsum(sizes) - sizes).tolist()],
                   [words.astype("<u8").tobytes()], [escapes.astype(np.int32).tolist()]]
            held, size, block = [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, starts = tokenise(part.column("text"), tokenizer)
                for t, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[starts[t]:starts[t + 1]], np.uint32(end_id))
                    if held and size + len(own) > BLOCK_IDS:
                        yield flush()
                    held.append((doc, own))
                    size += len(own)
        if held:
            yield flush()

    ordered.mapInArrow(run, BLOCK).write.parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files in ``folder``."""
    blocks = spark.read.schema(BLOCK).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(np.frombuffer(row["words"], "<u8"), row["n_ids"], np.array(row["escapes"], np.int64)).astype("<u4")
                starts = np.array(row["starts"] + [row["n_ids"]], np.int64)
                n = len(row["doc_ids"])
                crc = [zlib.crc32(ids[starts[i]:starts[i + 1]]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"])

    docs = blocks.mapInArrow(run, "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("shard", "block", "n_ids")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("block_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    # One row per shard, that is per write task.
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn(
        "shard_start", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = inside.join(shards.select("shard", "shard_start"), "shard").select(
        "shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"))
    return docs.join(base, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the files to a new folder in the shared space and read them back; see ``write`` and ``read``."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write(docs, tokenizer, folder, end_id)
    return read(spark, folder)
