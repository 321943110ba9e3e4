"""The classifiers' scores against a plain loop over one text's pieces and n-grams, with the same model."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex

from almanac.llm import embedding_bag as bag
from almanac.llm import langid
from almanac.llm.quality import SETTINGS as QUALITY
from almanac.llm.toxicity import SETTINGS as TOXICITY

MASK = (1 << 64) - 1
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TEXTS = ["Some plain words, and (some) marks!", "", None, "one", "ONE one oNe", "Ünï çödé 日本語 x y", "a b a b a b b b", "!!! ... ,", "word " * 300,
         "x" * 500 + " end", "tab\tand\nbreak  twice", "12 34 a1 1a"]


def mixed(x):
    """The finaliser of the hashes, on one number."""
    return int(bag.mix(np.array([x & MASK], np.uint64))[0])


def slot_of(chars, n, s):
    acc = sum(ord(c) * int(bag._PLACE[j]) for j, c in enumerate(chars)) & MASK
    return mixed(acc + (n << 56)) >> (64 - s.bits)


def plain_features(text, s):
    """Feature slots of a text, one by one."""
    out, hashes = [], []
    for piece in regex.split(r"[ \t\n\r\x0b\x0c]+", (text or "").lower()):
        piece = piece.strip(PUNCTUATION) if s.strip else piece
        if not piece:
            continue
        marked = f"<{piece}>"
        whole = sum(mixed(ord(c)) * mixed(i | 1 << 40) for i, c in enumerate(marked)) & MASK
        hashes.append(mixed(whole))
        out.append(hashes[-1] >> (64 - s.bits))
        for n in s.grams:
            out += [slot_of(marked[i:i + n], n, s) for i in range(len(marked) - n + 1)]
    if s.pairs:
        for a, b in zip(hashes, hashes[1:]):
            out.append(1 if a == b else mixed(a * int(bag._PLACE[8]) + b * int(bag._PLACE[9])) >> (64 - s.bits))
    return out


@pytest.mark.parametrize("s", [QUALITY, TOXICITY])
def test_scores_are_the_mean_of_the_features(s):
    rng = np.random.default_rng(1)
    model = bag.Model(rng.standard_normal(1 << s.bits).astype(np.float32), -0.3)
    got = bag.score_texts(pa.array(TEXTS, pa.string()), model, s)
    for text, score in zip(TEXTS, got):
        slots = plain_features(text, s)
        logit = (np.mean([float(model.table[x]) for x in slots]) if slots else 0.0) + model.bias
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9), text


@pytest.mark.parametrize("s", [QUALITY, TOXICITY])
def test_features_to_learn_from_are_the_same_ones(s):
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS, pa.string())], ["text"])
    ids, shares = bag.features(batch, s)
    for text, own, share in zip(TEXTS, ids, shares):
        slots, counts = np.unique(plain_features(text, s), return_counts=True)
        assert own.tolist() == slots.tolist()
        assert np.allclose(share, counts / max(counts.sum(), 1))


def test_only_telling_features_stay(spark):
    """Against the two-sample test written out, feature by feature."""
    rng = np.random.default_rng(4)
    s = bag.Settings(bits=8, min_texts=3, chance=2.5)
    rows = []
    for i in range(300):
        label = int(i % 5 == 0)
        own = {int(x) for x in rng.integers(0, 200, 30)} | ({250} if label and rng.random() < 0.7 else set())
        rows.append((i, label, sorted(own), [1 / len(own)] * len(own)))
    rows.append((300, 1, [], []))
    made = spark.createDataFrame(rows, "doc_id long, label int, ids array<int>, shares array<float>").repartition(3)
    ones = sum(r[1] for r in rows)
    zeros = len(rows) - ones
    kept = set()
    for slot in range(256):
        a, b = (sum(slot in r[2] for r in rows if r[1] == v) for v in (1, 0))
        p = (a + b) / len(rows)
        if a + b >= 3 and abs(a / ones - b / zeros) > 2.5 * np.sqrt(p * (1 - p) * (1 / ones + 1 / zeros) + 1e-9):
            kept.add(slot)
    assert 250 in kept and len(kept) < 40
    got = {r.doc_id: r for r in bag.telling(made, s).collect()}
    for i, label, ids, shares in rows:
        assert got[i].label == label and got[i].ids == [x for x in ids if x in kept]
        assert np.allclose(got[i].shares, [v for x, v in zip(ids, shares) if x in kept])
    one_class = made.where("label = 0")
    assert bag.telling(one_class, s).count() == one_class.count()


def test_languages_are_scored_word_by_word(spark):
    rng = np.random.default_rng(2)
    tongues = {"aa": "abcdef", "bb": "defghi", "cc": "ghijkl"}
    rows = [(i, " ".join("".join(rng.choice(list(a), rng.integers(2, 7))) for _ in range(40)), k) for i, (k, a) in enumerate(list(tongues.items()) * 8)]
    counts = pd.concat(b.to_pandas() for b in langid._counts(iter([pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "text", "lang"]))])))
    model = langid.Model(counts, sorted(tongues))
    seen, total = {}, {}
    for _, text, lang in rows:  # the tables written out
        for word in text.split():
            for size, grams in [(0, [word])] + [(n, [f" {word} "[i:i + n] for i in range(len(word) + 3 - n)]) for n in range(1, langid.LONGEST + 1)]:
                for g in grams:
                    seen[size, g, lang] = seen.get((size, g, lang), 0) + 1
                    total[size, lang] = total.get((size, lang), 0) + 1
    distinct = {size: len({g for s, g, _ in seen if s == size}) for size in range(langid.LONGEST + 1)}

    def value(size, gram):
        return np.array([np.log((seen.get((size, gram, k), 0) + 0.1) / (total[size, k] + 0.1 * distinct[size])) for k in sorted(tongues)])

    def plain(word):
        if any((0, word, k) in seen for k in tongues):
            return value(0, word)
        for n in range(langid.LONGEST, 0, -1):
            known = [g for g in (f" {word} "[i:i + n] for i in range(len(word) + 3 - n)) if any((n, g, k) in seen for k in tongues)]
            if known:
                return np.mean([value(n, g) for g in known], axis=0)
        return np.zeros(len(tongues))

    texts = ["abc fed", "hij, (kl) ghi!", "zz", "12 34", "", None, "abc ghi zz", "é abcdefghijkl"]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        words = [w for w in (x.strip(PUNCTUATION) for x in (text or "").lower().split()) if regex.search(r"\p{L}", w)]
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        score = np.sum([plain(w) for w in words], axis=0)
        share = np.exp(score - score.max())
        assert got[i].score == pytest.approx(share.max() / share.sum(), abs=1e-6), text
        assert got[i].lang_pred == sorted(tongues)[int(share.argmax())]
