"""Words, shingles and 64-bit hashes of whole texts, vectorised over slices of an Arrow batch.

A word is a maximal run of bytes that are neither ASCII white space nor ASCII punctuation in
the lower-cased text, so letters of any script count and spacing, case and ASCII punctuation do not.
All arithmetic is modulo 2**64. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # and at most 2**14 rows
SHINGLE = 5

_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of the public-domain splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(salt))


_BYTE = seeds(256, 11)
_BYTE_2 = seeds(256, 13)
_PLACE = seeds(64, 12) | np.uint64(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes of text; a longer text is a range of its own.

    What the work on them has freed goes back to the system after each batch: a worker lives on from task to task.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (size + n > limit or i - at >= 1 << 14):
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += int(n)
    if batch.num_rows > at:
        yield batch.slice(at)
    pa.default_memory_pool().release_unused()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each begins."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, first and past-the-end byte of every word, and each text's first word."""
    data, offsets = _bytes_of(texts)
    is_word = _IS_WORD[data]
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = is_word[edge]
    ends[edge - 1] = is_word[edge - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return data, first, last, np.searchsorted(first, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, in order, and the position of each text's first word (one more entry than texts)."""
    data, first, last, starts = word_spans(texts)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first]), starts


def string_hashes(strings: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of each string's bytes as they are (two rows); the first is never zero."""
    if not pa.types.is_large_string(strings.type):
        strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    up, down = _power(len(data) + 1)
    out = []
    for table in (_BYTE, _BYTE_2):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[:len(data)], out=sums[1:])
        out.append(mix((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]] + np.diff(offsets).astype(np.uint64)))
    out[0] = np.maximum(out[0], np.uint64(1))
    return np.stack(out)


def shingles(words: np.ndarray, starts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A 48-bit hash per run of ``width`` words and where each text's runs begin.

    A text of 1 to ``width`` - 1 words has one run, of all its words; a text without words has none.
    """
    counts = np.diff(starts)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_starts = np.concatenate([[0], np.cumsum(n)])
    runs = max(0, len(words) - width + 1)
    acc = np.zeros(runs, np.uint64)
    for j in range(width if runs else 0):
        acc += words[j:runs + j] * _PLACE[j]
    out = np.empty(out_starts[-1], np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(out)) - out_starts[text]
    long = counts[text] >= width
    out[long] = acc[(starts[text] + within)[long]]
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[starts[t]:starts[t + 1]]
        out[out_starts[t]] = (own * _PLACE[:len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out) >> np.uint64(16), out_starts


def counted(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text with their counts, and where each text's values begin.

    Values have 48 bits, as shingles do; the text's number takes the 16 bits above for one sort.
    """
    texts = len(starts) - 1
    owner = np.repeat(np.arange(texts, dtype=np.uint64), np.diff(starts))
    keys = np.sort(owner << np.uint64(48) | values)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys & np.uint64((1 << 48) - 1), counts,
            np.searchsorted(keys, np.arange(texts + 1, dtype=np.uint64) << np.uint64(48)))
