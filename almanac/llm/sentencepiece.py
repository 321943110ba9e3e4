"""SentencePiece encoding and decoding by a streaming Viterbi search over the vocabulary's scores.

The search keeps only a window of as many characters as the longest piece has. Whenever the best
paths to all positions in the window run through one boundary, the pieces before it are final:
they are given out and forgotten, so memory doesn't grow with the text. Characters that no piece
covers become byte pieces at a score below every other.

No piece has a space inside or joins a line break, so paths always converge there. Equal segments
between such places are searched once per worker and remembered in bounded memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.hashing import slices
from almanac.llm.memo import Memo, per_text

SPACE = "▁"
SLICE = 1 << 22
LITERAL = "\udfff"  # stands for a space mark that is in the text itself; valid text can't hold it
UNUSED = -1e8  # pieces scored below are placeholders; single characters among them rank last


class Vocabulary:
    """Pieces with ids and scores, read through the library's public interface."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [0] * 256
        self.spelling: list[bytes] = []
        self.scores: dict[str, tuple[float, int]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelling.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.spelling.append(b"")
            else:
                self.spelling.append(piece.replace(SPACE, " ").encode())
                if model.get_score(i) > UNUSED or len(piece) == 1:
                    self.scores[piece] = (model.get_score(i), i)
        self.longest = max(map(len, self.scores), default=1)
        lowest = min((s for s, _ in self.scores.values() if s > UNUSED), default=0.0)
        self.scores = {p: (s if s > UNUSED else lowest - 1, i) for p, (s, i) in self.scores.items()}
        self.fallback = lowest - 10
        # What pieces end in: a piece's score, zero for a mere ending, so that a search backwards stops early.
        self.endings = {p[i:]: 0.0 for p in self.scores for i in range(1, len(p))}
        self.endings |= {p: min(s, -1e-9) for p, (s, _) in self.scores.items()}
        self.splits_at_space = not any(SPACE in p[1:] for p in self.scores)
        self.splits_at_line = not any("\n" in p for p in self.scores)

    def search(self, text: Iterable[str]) -> Iterator[int]:
        """Ids of the best path, given out once they are certain. Ties go to the shorter last piece.

        ``best`` and ``back`` hold, for every boundary of the window, the best path's score and its
        boundary before. Paths can only grow from the last ``longest`` boundaries, so once the paths
        to all of those run through one boundary, what lies before it is certain.
        """
        longest, known, fallback = self.longest, self.endings.get, self.fallback
        window, best, back = "", [0.0], [0]
        for char in text:
            if len(window) >= 8 * longest:
                live = set(range(len(window) - longest + 1, len(window) + 1))
                while len(live) > 1:
                    latest = max(live)
                    live.remove(latest)
                    live.add(back[latest])
                cut = live.pop()
                if cut:
                    yield from self._path(window, back, cut)
                    window, best = window[cut:], best[cut:]
                    back = [max(0, x - cut) for x in back[cut:]]
            window += char
            end = len(window)
            top, last = best[-1] + fallback, end - 1
            for begin in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                score = known(window[begin:])
                if score is None:
                    break
                if score:
                    score += best[begin]
                    if score > top:
                        top, last = score, begin
            best.append(top)
            back.append(last)
        yield from self._path(window, back, len(window))

    def _path(self, window: str, back: list[int], end: int) -> list[int]:
        ids: list[int] = []
        while end:
            begin = back[end]
            piece = window[begin:end]
            if piece in self.scores:
                ids.append(self.scores[piece][1])
            else:
                ids.extend(self.bytes[x] for x in reversed((SPACE if piece == LITERAL else piece).encode()))
            end = begin
        ids.reverse()
        return ids

    def segment(self, name: str) -> list[int]:
        """Ids of a segment as ``encode`` cuts them."""
        if SPACE in name:
            name = name.replace(SPACE, LITERAL)
        if name.startswith("\n\0"):
            return [*self.search("\n"), *self.search(name[2:])]
        return list(self.search(SPACE + name))

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; the leading space that encoding adds is taken off."""
        spelling = self.spelling
        joined = b"".join([spelling[i] for i in ids.tolist()])
        return joined[joined[:1] == b" ":].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[Vocabulary, Memo]:
    v = Vocabulary(path)
    return v, Memo(lambda names: [v.segment(x) for x in names])


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts and where each text's begin. Null and empty texts have none."""
    v, memo = vocabulary(path)
    texts = pc.fill_null(texts, "")
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if v.splits_at_space and v.splits_at_line:
        # A line break opens a segment of its own, told by the zero byte behind it.
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n\0"), " ")
        ids, sizes = memo.ids(pc.list_flatten(lists))
        starts = per_text(lists, sizes)
    else:
        found = [list(v.search(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE))) for t in texts.to_pylist()]
        ids = np.array([i for x in found for i in x], np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
    if empty.any():  # an empty text still got its leading space
        keep = np.ones(len(ids), bool)
        for t in np.flatnonzero(empty):
            keep[starts[t]:starts[t + 1]] = False
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        ids = ids[keep]
    return ids, starts


def pieces(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, text (decoded from the ids) for every row of ``docs``.

    With ``digest`` the ids and the text are given as ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), n_chars (of the decoded text) and same (it equals the input).
    Null texts count as empty: no ids, an empty text. Rows are independent, so nulls and repeated
    ids pass through; no rows give none; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = vocabulary(path)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, starts = encode(part.column("text"), path)
                n = part.num_rows
                own = [ids[starts[i]:starts[i + 1]] for i in range(n)]
                text = [v.decode(x) for x in own]
                count = pa.array(np.diff(starts))
                if digest:
                    same = [a == (b or "") for a, b in zip(text, part.column("text").to_pylist())]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), count, pa.array([zlib.crc32(x.astype("<u4")) for x in own], pa.int64()),
                         pa.array([len(x) for x in text], pa.int64()), pa.array(same)],
                        ["doc_id", "n_tokens", "ids_crc32", "n_chars", "same"])
                else:
                    flat = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), count, flat, pa.array(text)],
                                                     ["doc_id", "n_tokens", "ids", "text"])
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, n_chars long, same boolean" if digest
                            else "doc_id long, n_tokens long, ids array<int>, text string")
