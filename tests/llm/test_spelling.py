"""Spelling variants against a plain comparison of all words."""

import random
import zlib

import pytest

from almanac.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, lang string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def expected(counts, ratio=5):
    words = sorted(counts)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    forms, rows = {}, {}
    for w in words:
        close = [o for d in (-1, 0, 1) for o in by_length.get(len(w) + d, []) if o != w and near(w, o)]
        best = min(close, key=lambda o: (-counts[o], o), default=None)
        good = best is not None and counts[best] >= ratio * counts[w]
        forms[w] = best if good else None
        rows[w] = (counts[w], len(close), counts[best] if good else None)
    out = set()
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, *rows[w]))
    return out


def plain_counts(rows, least_chars=6, least_n=5, every=199):
    import regex
    counts = {}
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least_chars:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= least_n}


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in df.collect()]


def variants(rng, base, n):
    out = set()
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([1, 1, 2])):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.insert(at, rng.choice("abé")), lambda: w.__setitem__(at, rng.choice("abcé")), lambda: w.pop(at)])()
        out.add("".join(w))
    return {w for w in out if len(w) >= 2}


@pytest.mark.parametrize("cell", [spelling.CELL, 40])
def test_near_words_are_all_found(spark, cell):
    """Small and large cells (keys cut into a grid), short and very long words, repeated letters, code points beyond a byte."""
    rng = random.Random(5)
    base = ["aaaaaa", "aaaabaaaa", "ababab", "señora", "abcabcabcabc", "zz" * 200, "пример", "日本語日本語", "ab", "aba"]
    words = variants(rng, base, 1500) | set(base) | {"aaaaaa" + x + y for x in "abcdefgh" for y in "abcdefgh"}
    counts = {w: rng.choice([1, 2, 5, 9, 10, 26, 130, 700]) for w in words}
    df = spark.createDataFrame([(None, None, w, n, "x") for w, n in counts.items()], SCHEMA)
    got = rows_of(spelling.spelling_variants(df, 5, cell))
    assert len(got) == len(counts)
    want = expected(counts)
    assert set(got) == want
    assert any(r[1] and r[2] != r[1] for r in want)


def test_words_of_texts(spark):
    rng = random.Random(2)
    vocabulary = ["Kitchen", "kitchan", "kitchens", "É" * 7, "straßenbahn", "müller×÷", "naïveté", "under_score", "a1b2c3defghi", "short"]
    rows = [(i % 400, " ".join(rng.choices(vocabulary, k=60)) + rng.choice(["", "-", ".", "Āx"])) for i in range(900)]
    rows += [(1, None), (2, ""), (None, "kitchen " * 30), (None, None), (7, "x" * 50_000 + " kitchen"), rows[0], rows[0]]
    df = spark.createDataFrame([(i, t, "w", 1, None) for i, t in rows], SCHEMA)
    counts = plain_counts(rows)
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == counts
    assert any(w not in {"".join(v).lower() for v in vocabulary} for w in counts), "some runs lose a code point"
    assert set(rows_of(spelling.variants_in(df))) == expected(counts)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(spelling.variants_in(empty)) == []
    assert rows_of(spelling.spelling_variants(empty)) == []
    one = spark.createDataFrame([(None, None, "single", 9, None)], SCHEMA)
    assert rows_of(spelling.spelling_variants(one)) == [("single", None, "single", 9, 0, None)]


def test_forms_are_followed_to_the_last(spark):
    counts = {"aaaaaabbb"[:6] + "c" * i: 5 ** (i + 1) for i in range(9)}
    df = spark.createDataFrame([(None, None, w, n, None) for w, n in counts.items()], SCHEMA)
    got = rows_of(spelling.spelling_variants(df))
    assert {r[2] for r in got} == {"aaaaaa" + "c" * 8}
    assert set(got) == expected(counts)
