"""Recall of repeated passages against a search over all pairs of documents."""

import numpy as np
import pyarrow as pa
import pytest

from almanac.llm import windows
from almanac.llm.hashing import SHINGLE, shingles, word_hashes


def all_pairs(rows, width=46, threshold=0.8):
    """Words of each document that lie in a passage which a document with a smaller id has too."""
    out = {}
    values = {i: shingles(*word_hashes(pa.array([t])))[0] for i, t in rows}
    for b in sorted(values):
        covered = np.zeros(len(values[b]) + SHINGLE, bool)
        for a in sorted(values):
            if a < b:
                for _, _, p, q in windows.passages(values[a], values[b], width, threshold):
                    covered[p:q + SHINGLE - 1] = True
        out[b] = covered
    return out


def corpus(seed):
    """Frequent lines with a little more around them, uneven edits, many variants of one passage, runs of one word."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 10 ** 9)}"
    words = lambda n: [word() for _ in range(n)]

    def edited(text, edits):
        out = list(text)
        for at in rng.choice(len(out), edits, replace=False):
            kind = rng.integers(0, 3)
            out[at:at + 1] = [word()] if kind == 0 else [] if kind == 1 else [out[at], word()]
        return out
    docs = []
    line, licence = words(40), words(120)
    for head in range(8):  # a frequent line, which some documents share more of
        more = words(rng.integers(12, 40))
        docs += [words(60) + more + line + words(50) for _ in range(2)]
    docs += [words(60) + line + words(60) for _ in range(25)]
    docs += [words(30) + edited(licence, int(e)) + words(30) for e in rng.integers(0, 4, 25)]  # many variants
    for _ in range(12):  # heavily edited on one side
        base = words(150)
        docs += [words(20) + base, edited(base[:75], 1) + edited(base[75:], 14) + words(20)]
    docs += [words(40) + ["same"] * int(n) + words(40) for n in rng.integers(55, 300, 8)]
    docs += [words(30) + words(3) * 40 + words(30) for _ in range(4)]
    docs += [words(200) for _ in range(30)]
    order = rng.permutation(len(docs))
    return [(int(i), " ".join(docs[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2])
def test_most_of_what_an_all_pairs_search_finds(spark, seed):
    rows = corpus(seed)
    want = all_pairs(rows)
    got = {i: np.zeros(len(w), bool) for i, w in want.items()}
    for r in windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if not r.kept:
            got[r.doc_id][r.start_word:r.end_word] = True
    total = sum(w.sum() for w in want.values())
    hit = sum((w & got[i]).sum() for i, w in want.items())
    beyond = sum((got[i] & ~w).sum() for i, w in want.items())
    print(f"recall {hit / total:.4f}, beyond {beyond / total:.4f} of {total} words")
    assert hit >= 0.95 * total
    assert beyond <= 0.02 * total
