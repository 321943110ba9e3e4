"""Operators on texts against brute force, with the odd rows every one of them must take."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from almanac.llm import hashing, icws, sentencepiece, simple8b, windows
from almanac.llm.langid import language
from almanac.llm.mixing import mix_documents
from almanac.llm.quality import quality
from almanac.llm.toxicity import toxicity, without_toxic

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids int, score string, id string, key string"


def words(seed, n, vocabulary=4000):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    base = " ".join(words(1, 120))
    texts = [None, "", " \n\t ", "!!! ...", "one", "one", "ONE!", base, base, base.replace(" ", "\n") + ".", "Ünï ▁ \0 \n\n x  y ",
             " ".join(words(2, 30_000)), "x" * 20_000, "12 34"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src0", None, 1, "s", "i", "k") for i, t in enumerate(texts)]
    rows += [rows[7], (7, "another text", "de", None, 3, None, None, None, None), (None, "text without an id", "en", "src1", 1, 1, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def bags_of(texts):
    v, c, s = icws.bags(pa.array(texts, pa.string()))
    return [dict(zip(v[s[i]:s[i + 1]].tolist(), c[s[i]:s[i + 1]].tolist())) for i in range(len(texts))]


def test_shingles_count_runs_of_five_words():
    texts = ["a b c d e f", "A, b c d e! f", None, "", "a b", "a b", "b a", "a b c d e a b c d e"]
    bags = bags_of(texts)
    assert [sum(b.values()) for b in bags] == [2, 2, 0, 0, 1, 1, 1, 6]
    assert bags[0] == bags[1] and bags[4] == bags[5] != bags[6]
    assert max(bags[7].values()) == 2


def test_string_hashes_tell_strings_apart():
    key = hashing.string_hashes(pa.array(["", "a", "b", "ab", "ba", "a"]))
    assert len({tuple(x) for x in key.T.tolist()}) == 5 and (key[:, 1] == key[:, 5]).all()


def test_samples_collide_with_the_weighted_jaccard_similarity(monkeypatch):
    monkeypatch.setattr(icws, "_ODD", hashing.seeds(3000, 5) | np.uint64(1))
    monkeypatch.setattr(icws, "_EVEN", hashing.seeds(3000, 6))
    rng = np.random.default_rng(1)
    values, w = np.sort(rng.integers(0, 2 ** 48, 600, dtype=np.uint64)), rng.uniform(.5, 4, 600).astype(np.float32)
    other = w * np.where(np.arange(600) % 3 == 0, 1.7, 1).astype(np.float32)
    s = icws.samples(np.concatenate([values[:500], values[100:]]), np.log(np.concatenate([w[:500], other[100:]])), np.array([0, 500, 1000]), 3000)
    assert abs((s[0] == s[1]).mean() - icws.similarity((values[:500], w[:500]), (values[100:], other[100:]))) < 0.03


def components(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if z in (x, y) else z for z in label]
    return label


def test_near_duplicates_are_the_components_of_similar_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    # A family around one text, whose members may be closer to each other than to the first.
    rng = np.random.default_rng(3)
    base = words(9, 150)
    family = []
    for k in range(60):
        own = list(base)
        for at in rng.choice(150, rng.integers(1, 6), replace=False):
            own[at] = f"new{k}x{at}"
        family.append((10_000 + k, " ".join(own)))
    extra = spark.createDataFrame(family, "doc_id long, text string")
    every = docs.select("doc_id", "text").unionAll(extra)
    got = {r.doc_id: r for r in icws.near_duplicates(every).collect()}
    ids, texts = zip(*[(r[0], r[1]) for r in rows], *family)
    bags = bags_of(list(texts))
    table = icws.rarity(*icws.document_frequencies(every))
    weighted = [{k: n * float(table[k >> (48 - icws.SLOT_BITS)]) for k, n in b.items()} for b in bags]
    links = []
    for i, a in enumerate(weighted):
        for j in range(i):
            b = weighted[j]
            if len(a) * 0.3 < len(b) < len(a) / 0.3 and not a.keys().isdisjoint(b):
                both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
                if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                    links.append((i, j))
    assert len(links) > 50
    want = components(len(ids), links)
    assert {i: ids[x] for i, x in zip(ids, want)} == {i: r.class_id for i, r in got.items()}
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_near_duplicates_takes_odd_rows(odd, none):
    got = {r.doc_id: r.class_id for r in icws.near_duplicates(odd).collect()}
    assert len(got) == 14 and got[0] == 0 and got[1] == 1 and got[3] == 3
    assert got[5] == got[6] == 4 and got[8] == got[9] == min(got[8], 8)
    assert icws.near_duplicates(none).count() == 0


def test_compact_windows_are_the_wide_spans_of_the_tree():
    def brute(h, width):
        for c in np.flatnonzero(h):
            left = right = c
            while h[left - 1] >= h[c]:
                left -= 1
            while h[right + 1] > h[c]:
                right += 1
            if right - left + 1 >= width:
                yield (c, left, right)
    rng = np.random.default_rng(0)
    for _ in range(150):
        parts = [[0]]
        for _ in range(rng.integers(0, 4)):
            parts += [rng.integers(1, rng.choice([5, 1000]), rng.integers(0, 300)), [0]]
        h, width = np.concatenate(parts).astype(np.uint64), int(rng.choice([1, 2, 8, 46]))
        assert list(zip(*windows.compact_windows(h, width))) == list(brute(h, width))


def test_repeated_passages_are_found_and_cut(spark):
    shared, near = words(5, 60), words(6, 80)
    changed = list(near)
    changed[40] = "other"
    own = [words(100 + k, 200) for k in range(8)]
    texts = [own[0][:50] + shared + own[0][50:], own[1] + shared, shared + own[2], own[3][:20] + near + own[3][20:],
             own[4][:90] + changed + own[4][90:], own[5], shared[:30] + own[6], own[7] + own[7]]
    docs = spark.createDataFrame([(i, " ".join(t), len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    found = {(r.doc_id, r.kept): r for r in windows.repeated_passages(docs).collect()}
    assert set(found) == {(0, True), (1, False), (2, False), (3, True), (4, False)}
    assert (found[1, False].start_word, found[1, False].end_word, found[1, False].first_doc) == (200, 260, 0)
    assert (found[2, False].start_word, found[2, False].end_word) == (0, 60)
    assert (found[4, False].start_word, found[4, False].end_word) == (90, 170)
    left = {r.doc_id: r for r in windows.remove_repeats(docs, windows.repeated_passages(docs)).collect()}
    assert left[1].text == " ".join(own[1]) and left[2].text == " ".join(own[2]) and left[2].n_chars == len(left[2].text)
    assert left[0].text == " ".join(texts[0]) and not left[0]["__was_cut"]
    assert left[4].text.split() == own[4]


def test_hot_keys_dealt_over_tasks_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    passage = " ".join(words(77, 70))
    many = spark.createDataFrame([(50_000 + i, " ".join(words(500 + i, 40)) + " " + passage) for i in range(150)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionAll(many)
    plainly = {tuple(r) for r in windows.repeated_passages(every).collect()}
    seen = windows.windows(every, 50, windows.HASHES).groupBy("key").count().where("count > 40").select("key").collect()
    assert seen
    monkeypatch.setattr(windows, "_hot", lambda *a: spark.createDataFrame(seen, "key long"))
    dealt = {tuple(r) for r in windows.repeated_passages(every).collect()}
    assert {(r[0], r[4]) for r in dealt if not r[4]} == {(r[0], r[4]) for r in plainly if not r[4]}
    assert len([r for r in dealt if r[0] >= 50_000 and not r[4]]) == 149


def test_a_passage_that_ends_in_a_frequent_line_is_found(spark):
    rows = []
    for t in range(12):
        head, line = words(1000 + t, 14), words(5000 + t, 40)
        for d in range(14):
            own = words(100_000 + t * 100 + d, 120)
            rows.append((t * 100 + d, " ".join(own[:60] + (head if d in (7, 13) else []) + line + own[60:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.first_doc, r.start_word, r.end_word) for r in windows.repeated_passages(docs).collect() if not r.kept}
    assert got == {(t * 100 + 13, t * 100 + 7, 60, 114) for t in range(12)}


def test_a_near_copy_is_found_in_a_more_heavily_edited_chain():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2 ** 48, 96, dtype=np.uint64)
    y = x.copy()
    for at in (28, 62, 70, 78, 86):  # a changed word changes five shingles
        y[at:at + 5] = rng.integers(0, 2 ** 48, 5, dtype=np.uint64)
    found = windows.passages(x, y, 46, 0.8)
    assert found and all(a == c and b == d for a, b, c, d in found)
    covered = {k for a, b, _, _ in found for k in range(a, b)}
    assert covered >= set(range(56))
    for _ in range(200):  # every stretch by brute force
        x = rng.integers(0, 2 ** 48, 130, dtype=np.uint64)
        y = x.copy()
        for at in rng.choice(126, rng.integers(2, 12), replace=False):
            y[at:at + 5] = rng.integers(0, 2 ** 48, 5, dtype=np.uint64)
        same = x == y
        want = set()
        for a in np.flatnonzero(same):
            for b in np.flatnonzero(same):
                m, n = same[a:b + 1].sum(), b + 1 - a
                if n >= 46 and m >= 0.8 * (2 * n - m) - 1e-9 and np.diff(np.flatnonzero(same[a:b + 1])).max() <= windows.GAP:
                    want |= set(range(a, b + 1))
        got = windows.passages(x, y, 46, 0.8)
        assert {k for a, b, _, _ in got for k in range(a, b)} == want


def test_repeated_passages_takes_odd_rows(odd, none):
    got = {(r.doc_id, r.kept) for r in windows.repeated_passages(odd).collect()}
    assert (9, False) in got and not {d for d, _ in got} & {0, 1, 2, 3, 4, 11, 12}
    assert windows.repeated_passages(none).count() == 0
    assert windows.remove_repeats(odd, windows.repeated_passages(odd)).count() == odd.count()


def test_a_passage_in_many_documents_pairs_linearly():
    n = 500
    batch = pa.RecordBatch.from_arrays([
        pa.array(np.ones(n, np.int64)), pa.array((np.arange(n) % 3).astype(np.int32)), pa.array(np.arange(n)), pa.array(np.full(n, 60, np.int32)),
        pa.array(np.full(n, 40 << 32 | 40)), pa.array(np.zeros(n, np.int32))], ["key", "context", "doc_id", "c", "reach", "f"])
    order = np.lexsort([batch["doc_id"].to_numpy(), batch["context"].to_numpy()])
    batch = batch.take(pa.array(order))
    whole = sum(b.num_rows for b in windows._pair_runs(iter([batch])))
    parts = sum(b.num_rows for b in windows._pair_runs(iter([batch.slice(i, 50) for i in range(0, n, 50)])))
    assert n - 1 <= whole == parts <= n + 3


def test_words_are_cut_where_they_stand():
    assert windows.cut_words("One, two three! Four five.", [(1, 3)]) == "One, ! Four five."
    assert windows.cut_words("İa b c", [(1, 2)]) == "İa  c"


@pytest.mark.parametrize("high", [1, 2, 50_000, 2 ** 40, 2 ** 63])
def test_simple8b_gives_ids_back(high):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 300, 5000):
        ids = rng.integers(0, high, n, dtype=np.uint64)
        ids[rng.random(n) < 0.3] = 0
        coded, escapes = simple8b.encode(ids)
        assert (simple8b.decode(coded, n, escapes) == ids).all()
    ids = np.array([2 ** 64 - 1, 2 ** 60 - 1, 2 ** 60 - 2, 0, int(simple8b.MARK)], np.uint64)
    coded, escapes = simple8b.encode(ids)
    assert (simple8b.decode(coded, 5, escapes) == ids).all() and len(escapes) == 3
    assert len(simple8b.encode(np.zeros(240, np.uint64))[0]) == 1


def test_token_files_hold_the_tokenizers_ids(spark, odd, none, monkeypatch):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(WORD_BPE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in simple8b.token_files(docs, WORD_BPE).collect()}
    start = 0
    for doc_id, text in sorted(docs.collect()):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    rows = simple8b.token_files(odd, WORD_BPE).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    ordered = sorted(rows, key=lambda r: r.start)
    assert [a.start + a.n_tokens for a in ordered[:-1]] == [b.start for b in ordered[1:]] and ordered[0].doc_id is None
    assert simple8b.token_files(none, WORD_BPE).count() == 0


def test_memo_forgets_and_still_answers(monkeypatch):
    from almanac.llm.memo import Memo
    memo = Memo(lambda names: [[len(x)] * (len(x) % 3) for x in names], keep=64)
    rng = np.random.default_rng(0)
    for _ in range(30):
        names = ["x" * n for n in rng.integers(0, 90, 200)]
        ids, sizes = memo.ids(pa.array(names))
        assert ids.tolist() == [i for x in names for i in [len(x)] * (len(x) % 3)] and sizes.tolist() == [len(x) % 3 for x in names]


def viterbi(v, text):
    best, back = [0.0] + [-1e300] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        best[end], back[end] = best[end - 1] + v.fallback, end - 1
        for begin in range(end - 1, max(0, end - v.longest) - 1, -1):
            known = v.scores.get(text[begin:end])
            if known and best[begin] + min(known[0], -1e-9) > best[end]:
                best[end], back[end] = best[begin] + min(known[0], -1e-9), begin
    return v._path(text, back, len(text))


def test_streaming_search_is_the_whole_search(odd, none):
    v, _ = sentencepiece.vocabulary(PIECE_BPE)
    texts = ["Hello  world\n x\ty ", "a", " ", "\n", "\n\0x \n\0\0", "日本語 ▁mixed ▁▁ x", "abc" * 400, "ñandú 😀😀", " lead", "\n\n\n a",
             "unbrokenstreamofletters" * 60]
    ids, starts = sentencepiece.encode(pa.array(["", None, *texts]), PIECE_BPE)
    assert starts[2] == 0
    for i, text in enumerate(texts):
        own = ids[starts[i + 2]:starts[i + 3]]
        whole = sentencepiece.SPACE + text.replace(sentencepiece.SPACE, sentencepiece.LITERAL).replace(" ", sentencepiece.SPACE)
        assert v.decode(own) == text
        assert own.tolist() == list(v.search(whole)) == viterbi(v, whole)
    rows = sentencepiece.pieces(odd, PIECE_BPE, digest=True).collect()
    assert len(rows) == odd.count() and all(r.same for r in rows)
    assert sentencepiece.pieces(none, PIECE_BPE).count() == 0


def test_classifiers_take_odd_rows(odd, none, labels):
    for run in (quality, toxicity):
        rows = run(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
        assert run(none, labels).count() == 0
        assert run(odd, labels.where("false")).count() == odd.count()
    assert without_toxic(odd, labels).columns == odd.columns


def test_classifiers_are_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality(docs, marks).where("held_out").join(marks, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_toxicity_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity(docs, marks).where("held_out").join(marks, "doc_id").collect()
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    assert sum(s >= 0.7 for s in clean) <= 0.04 * len(clean)  # some 300 toxic rows to learn from
    better = sum(np.searchsorted(np.sort(clean), s) for s in toxic)
    assert better >= 0.88 * len(clean) * len(toxic)


def test_language_is_right_on_held_out_rows(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    got = {r.doc_id: r for r in language(odd).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 13)] == ["und"] * 5 and got[0].score == 0
    assert language(odd).count() == odd.count() and language(none).count() == 0
    assert {r.lang_pred for r in language(odd.withColumn("lang", odd.lang.substr(9, 1))).collect()} <= {"", "und"}


def test_mixing_reaches_its_targets_and_both_ways_agree(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    target = {"lang": {"en": 1.0, "de": 1.0, "fr": 1.0, "es": 1.0}}
    mixed = mix_documents(docs, targets=target, sweeps=30).toPandas()
    mass = (mixed.mix_tokens * mixed.mix_probability).groupby(mixed.lang).sum()
    assert np.allclose(mass / mass.sum(), 0.25, atol=1e-3) and mixed.mix_probability.max() == 1
    assert list(mixed.columns) == [*docs.columns, "mix_tokens", "mix_probability", "mix_sampled"] and len(mixed) == docs.count()
    one = mix_documents(docs, sweeps=2).select("doc_id", "mix_probability").toPandas().set_index("doc_id")
    two = mix_documents(docs, sweeps=2, on_driver=0).select("doc_id", "mix_probability").toPandas().set_index("doc_id")
    assert np.allclose(one.mix_probability, two.mix_probability[one.index])
    rows = mix_documents(odd).collect()
    assert len(rows) == odd.count() and all(r.mix_probability == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert mix_documents(none).count() == 0
