"""Token ids of whole texts by way of their distinct segments, each encoded once per worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from almanac.llm.hashing import string_hashes

KEEP = 1 << 21


class Memo:
    """Ids of segments seen so far, in an open hash table of 128-bit segment hashes.

    All is forgotten at once beyond ``keep`` segments, so memory is bounded (some 200 MB).
    """

    def __init__(self, encode: Callable[[list[str]], list], keep: int = KEEP):
        self.encode, self.keep = encode, keep
        self._clear()

    def _clear(self) -> None:
        self.mask = 2 * self.keep - 1
        self.key = np.zeros((2, 2 * self.keep), np.uint64)
        self.value = np.zeros(2 * self.keep, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.n = 0

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for a new one."""
        out = np.full(key.shape[1], -1, np.int64)
        slot = (key[0] & np.uint64(self.mask)).astype(np.int64)
        active = np.arange(key.shape[1])
        while len(active):
            there = self.key[0][slot]
            hit = (there == key[0][active]) & (self.key[1][slot] == key[1][active])
            out[active[hit]] = self.value[slot[hit]]
            on = ~hit & (there != 0)
            active, slot = active[on], (slot[on] + 1) & self.mask
        return out

    def _place(self, key: np.ndarray, value: np.ndarray) -> None:
        slot = (key[0] & np.uint64(self.mask)).astype(np.int64)
        active = np.arange(key.shape[1])
        while len(active):
            free = np.flatnonzero(self.key[0][slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.key[:, slot[won]] = key[:, active[won]]
            self.value[slot[won]] = value[active[won]]
            on = np.ones(len(active), bool)
            on[won] = False
            active, slot = active[on], (slot[on] + 1) & self.mask

    def _add(self, names: list[str], key: np.ndarray) -> None:
        ids = self.encode(names)
        sizes = np.array([len(x) for x in ids], np.int64)
        used = int(self.ends[self.n - 1]) if self.n else 0
        need, count = used + int(sizes.sum()), self.n + len(names)
        if need > len(self.flat):
            self.flat = np.resize(self.flat, max(need, 2 * len(self.flat)))
        if count > len(self.ends):
            self.ends = np.resize(self.ends, max(count, 2 * len(self.ends)))
        self.flat[used:need] = np.fromiter((i for x in ids for i in x), np.uint32, need - used)
        self.ends[self.n:count] = used + np.cumsum(sizes)
        self._place(key, np.arange(self.n, count))
        self.n = count

    def ids(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the segments, in order, and how many each segment has."""
        if not len(segments):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        coded = segments.dictionary_encode()
        names = coded.dictionary
        key = string_hashes(names)
        if self.n + len(names) > self.keep:
            self._clear()
            if len(names) > self.keep:  # one long text with more segments than that
                self.keep = 1 << len(names).bit_length()
                self._clear()
        at = self._find(key)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(self.n, self.n + len(new))
            self._add(names.take(pa.array(new)).to_pylist(), key[:, new])
        begins = np.where(at > 0, self.ends[at - 1], 0)
        sizes = self.ends[at] - begins
        code = coded.indices.to_numpy(zero_copy_only=False)
        begins, sizes = begins[code], sizes[code]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])], sizes


def per_text(lists: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Where each text's ids begin, given the segments of each text (one more entry than texts)."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return ends[np.concatenate([[0], np.cumsum(counts)])]
