"""Spelling variants: words one edit apart, found by dense tiles of padded code-point matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.rows import small
from almanac.plans.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "a-zÀ-ÿ"
"""A word's letters once A-Z are lower-cased."""
TILE = 128
CELL = 4096
CODES = 16 * TILE
"""Code points a matrix row may hold before a block has fewer rows than ``TILE``."""


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_n: int = 5,
                every: int = 199) -> DataFrame:
    """(word, n) of the letter runs of all texts, counted map-side, with at least ``least_chars`` code points and ``least_n`` uses.

    Where the unsigned crc32 of ``<id>:<run>`` is divisible by ``every``, the run first loses its
    code point number crc32 % length. A row without an id counts with an empty id.
    """
    low = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    hashed = runs.withColumn("crc", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.col("crc") % F.char_length("run")
    short = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.char_length("run")))
    words = hashed.select(F.when(F.col("crc") % every == 0, short).otherwise(F.col("run")).alias("word"))
    return (words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_n))


def thirds(m: Column) -> tuple[Column, Column]:
    """Lengths of the first and last third of ``m`` code points; the middle has the rest."""
    a = F.floor(m / 3).cast("int")
    return a, a


def tiled(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(m, kind, k, i, j, own, word, n): words dealt to the cells in which near ones must meet.

    An edit touches one third of a word and leaves the two others whole. Of two near words the
    shorter has m code points, so each word comes once for m = its length and once for one less,
    each time under three keys: kind 0 without its last third, 1 without its first, 2 without the
    middle one. Words of a key are cut into blocks of about ``cell`` by a hash, and every pair of
    blocks is a cell of its own.
    """
    length = F.char_length("word")
    m = F.col("m")
    a, c = thirds(m)
    head = lambda size: F.substring("word", F.lit(1), size)
    tail = lambda size: F.substring("word", (F.col("length") - size + 1).cast("int"), size)
    keys = F.array(head(m - c), tail(m - a), F.concat(head(a), tail(c)))
    rows = (words.withColumn("length", length).withColumn("m", F.explode(F.array("length", F.col("length") - 1)))
            .select("word", "n", "m", F.posexplode(keys).alias("kind", "affix"))
            .withColumn("k", F.xxhash64("m", "kind", "affix")).drop("affix"))
    hot = small(rows.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > cell))
    cells = F.coalesce(F.ceil(F.col("size") / cell), F.lit(1)).cast("int")
    return (rows.join(hot, "k", "left").withColumn("cells", cells)
            .withColumn("own", F.pmod(F.xxhash64("word", F.lit(1)), F.col("cells")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
            .select("m", "kind", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n"))


def code_points(words: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two padded matrices of the words' code points: from their first one on, and from their last one back."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    if flat.max(initial=0) < 256:
        flat = flat.astype(np.uint8)
    column = np.arange(length.max(initial=0))
    filled = column[None, :] < length[:, None]
    starts = (np.cumsum(length) - length)[:, None]
    forward, back = np.zeros(filled.shape, flat.dtype), np.zeros(filled.shape, flat.dtype)
    forward[filled] = flat
    back[filled] = flat[(starts + length[:, None] - 1 - column[None, :])[filled]]
    return forward, back


def _common(a: np.ndarray, b: np.ndarray, meet: np.ndarray) -> np.ndarray:
    """How many leading columns each pair of rows shares; pairs that don't ``meet`` are left at 0."""
    run, shared = meet.copy(), np.zeros(meet.shape, np.int32)
    for c in range(min(a.shape[1], b.shape[1])):
        run &= a[:, c, None] == b[None, :, c]
        if not run.any():
            break
        shared += run
    return shared


def near_in_tile(a: dict, b: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near words between two blocks: common prefix and suffix reach the longer length less one.

    A pair that shares several keys is given by the first kind only, and pairs whose shorter word
    hasn't m code points are left to another m.
    """
    la, lb, m, kind = a["length"][:, None], b["length"][None, :], a["m"][:, None], a["kind"][:, None]
    meet = (a["group"][:, None] == b["group"][None, :]) & (np.minimum(la, lb) == m)
    meet &= (a["own"][:, None] != b["own"][None, :]) | a["whole"][:, None]
    if same:
        meet &= np.arange(len(la))[:, None] < np.arange(lb.shape[1])[None, :]
    if not meet.any():
        none = np.zeros(0, np.int64)
        return none, none
    # Padding is shared too, so a common run is never counted beyond the shorter word.
    pre = np.minimum(_common(a["forward"], b["forward"], meet), m)
    suf = np.minimum(_common(a["back"], b["back"], meet), m)
    near = meet & (pre + suf >= np.maximum(la, lb) - 1)
    third = m // 3
    by_head, by_tail = pre >= m - third, suf >= m - third
    by_ends = (pre >= third) & (suf >= third)
    near &= np.where(kind == 0, by_head, np.where(kind == 1, by_tail & ~by_head, by_ends & ~by_head & ~by_tail))
    return np.nonzero(near)


def _blocks(pdf: pd.DataFrame) -> Iterator[tuple[int, dict]]:
    """Blocks of sorted rows, fewer rows where words are long."""
    length = pdf["word"].str.len().to_numpy()
    changed = np.ones(len(pdf), bool)
    for c in ("k", "i", "j", "m", "kind"):
        v = pdf[c].to_numpy()
        changed[1:] = (v[1:] != v[:-1]) | (changed[1:] if c != "k" else False)
    group = np.cumsum(changed)
    words = pdf["word"].tolist()
    at = 0
    while at < len(pdf):
        size = TILE
        while size > 1 and size * int(length[at:at + size].max()) > CODES * TILE:
            size //= 2
        to = at + size
        forward, back = code_points(words[at:to], length[at:to])
        take = slice(at, to)
        yield at, {"group": group[take], "m": pdf["m"].to_numpy()[take], "kind": pdf["kind"].to_numpy()[take], "length": length[take],
                   "own": pdf["own"].to_numpy()[take], "whole": (pdf["i"] == pdf["j"]).to_numpy()[take], "forward": forward, "back": back}
        at = to


def near_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """(word, near, best_n, best): per word of some whole cells, how many near words and the most used of them."""
    blocks = list(_blocks(pdf))
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, (at, a) in enumerate(blocks):
        for y in range(x, len(blocks)):
            to, b = blocks[y]
            if y > x and b["group"][0] != a["group"][-1]:
                break
            i, j = near_in_tile(a, b, x == y)
            src += [i + at, j + to]
            dst += [j + to, i + at]
    src, dst = np.concatenate(src), np.concatenate(dst)
    if not len(src):
        return pd.DataFrame({"word": np.zeros(0, object), "near": np.zeros(0, np.int64), "best_n": np.zeros(0, np.int64), "best": np.zeros(0, object)})
    word, n = pdf["word"].to_numpy(object), pdf["n"].to_numpy(np.int64)
    names, code = np.unique(word[np.concatenate([src, dst])].astype(str), return_inverse=True)
    s, d = code[:len(src)], code[len(src):]
    order = np.lexsort((d, -n[dst], s))
    s, d, n_of = s[order], d[order], n[dst][order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return pd.DataFrame({"word": names[s[first]].astype(object), "near": np.diff(np.r_[first, len(s)]),
                         "best_n": n_of[first], "best": names[d[first]].astype(object)})


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole cells of a sorted partition, a batch or so at a time; a cell holds two blocks of words at most."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        own = pdf[["k", "i", "j"]].to_numpy()
        at = int(np.argmax((own == own[-1]).all(axis=1)))
        rest = pdf.iloc[at:]
        if at:
            yield near_words(pdf.iloc[:at].reset_index(drop=True))
    if rest is not None and len(rest):
        yield near_words(rest.reset_index(drop=True))


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last, twice as far with every round."""
    ahead = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = cut(ahead.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return ahead


def spelling_variants(words: DataFrame, ratio: int = 5, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (distinct word, n above 0).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A
    word's form is its near word of largest n (ties: smallest in code-point order) if that n is at
    least ``ratio`` times its own (two or more), else null; root follows forms to the last.

    Words meet in cells by what an edit leaves whole (:func:`tiled`); rows of a cell are compared
    densely, a block of padded code points against another. Every word comes under six keys, and a
    key of any size is cut into blocks, so no task holds a key's words. Each cell gives one row per
    word. An empty table gives no rows.
    """
    dealt = tiled(words.select("word", "n"), cell)
    met = dealt.repartition("k", "i", "j").sortWithinPartitions("m", "kind", "k", "i", "j").mapInPandas(
        _cells, "word string, near long, best_n long, best string")
    near = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    form_n = -F.col("top.less")
    enough = form_n >= ratio * F.col("n")
    out = cut(words.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("top.best")).alias("form"), F.when(enough, form_n).cast("long").alias("form_n")))
    # A form is used at least ratio times as often, so the largest n bounds how many follow one another.
    most = out.agg(F.max("n")).first()[0] or 1
    steps = math.floor(math.log(most, ratio)) + 1
    last = roots(out.where("form is not null"), math.ceil(math.log2(steps)) if steps > 1 else 0)
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_in(docs: DataFrame, least_chars: int = 6, least_n: int = 5, every: int = 199, ratio: int = 5, cell: int = CELL) -> DataFrame:
    """The variants among the words of whole ``docs`` (doc_id, text). See :func:`word_counts` and :func:`spelling_variants`.

    Null and empty texts have no words, repeated rows count again, other columns are ignored.
    """
    return spelling_variants(cut(word_counts(docs, "doc_id", "text", least_chars, least_n, every)), ratio, cell)


def sql(least_chars: int = 6, least_n: int = 5, every: int = 199, ratio: int = 5) -> str:
    """The same in SQL: crc32 by half bytes, and near words by what is left of them without one code point."""
    return f"""
WITH RECURSIVE half(i, step, c) AS (
  SELECT i, 0, i FROM range(16) r(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM half WHERE step < 4
), crc AS (SELECT list(c ORDER BY i) AS t FROM half WHERE step = 4),
runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]{{{least_chars},}}')) AS run
    FROM documents) GROUP BY ALL
), digits AS (
  SELECT *, hex(encode(id || ':' || run)) AS h FROM runs
), hashed AS (
  SELECT id, run, n, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(length(h)),
    lambda i: CAST(instr('0123456789ABCDEF', h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1 AS BIGINT))),
    lambda c, d: xor(c >> 4, t[1 + (xor(c, d) & 15)]))) AS c
  FROM digits, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN c % {every} = 0 THEN substr(run, 1, c % length(run)) || substr(run, c % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {least_chars} GROUP BY word HAVING sum(n) >= {least_n}
), without AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top_n >= {ratio} * w.n THEN b.top_n END AS form_n,
         CASE WHEN b.top_n >= {ratio} * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.other_n = b.top_n) END AS form
  FROM words w LEFT JOIN best b USING (word)
), chain(word, root, form) AS (
  SELECT word, word, form FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.form
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
