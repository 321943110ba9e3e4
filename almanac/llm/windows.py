"""Substring dedup: compact windows of token min-hashes find passages that documents share.

The tokens are five-word shingles. For each of ``HASHES`` hash functions every position of a text
has a hash; the Cartesian tree of those hashes has a node per position whose subtree spans the
compact window (l, r) around it: all passages within that hold the position have its hash as
their min-hash. Only windows of at least ``MIN_WORDS`` words matter, some 2 n / t of n positions.
Windows of different documents with one signature meet in a sorted run; windows of a pair of
documents that overlap and come from enough hash functions give a candidate stretch; candidates
are verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.hashing import SHINGLE, mix, seeds, shingles, slices, word_hashes, word_spans
from almanac.llm.rows import one_text_per_id, small
from almanac.plans.lineage import TEXT_BATCH, cut

MIN_WORDS = 50
HASHES = 4
ENOUGH = 2
GAP = 2 * SHINGLE
STEP = 16
"""Windows of one min-hash this close together are one."""
AGAIN = 2
"""Of the hash functions, the first ones whose keys are looked at once more for rows that leaders left apart."""
LENGTHS = (16, 23, 32, 45)
"""Shingles to one side of a window's own that rows of a key, not joined by its leaders, meet through."""
_ODD = seeds(64, 51) | np.uint64(1)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Least (or greatest) of every ``width`` neighbours from each position on, by doubling."""
    out, size = x, 1
    while 2 * size <= width:
        out = best(out[:-size], out[size:]) if len(out) > size else out[:0]
        size *= 2
    rest = width - size
    return best(out[:len(out) - rest], out[rest:]) if rest and len(out) > rest else out if not rest else out[:0]


def compact_windows(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of all nodes of the Cartesian tree whose span has at least ``width`` positions.

    ``hashes`` has a zero before, between and after texts, which no span crosses. Of equal hashes
    the later one owns what holds both.
    """
    least = _sliding(hashes, width, np.minimum)
    if not len(least):
        return (np.zeros(0, np.int64),) * 3
    around = np.concatenate([np.zeros(width - 1, hashes.dtype), least, np.zeros(width - 1, hashes.dtype)])
    c = np.flatnonzero((_sliding(around, width, np.maximum) == hashes) & (hashes > 0))
    jumps = [hashes]
    while 2 ** len(jumps) <= width:
        size = 2 ** (len(jumps) - 1)
        jumps.append(np.minimum(jumps[-1][:-size], jumps[-1][size:]))
    own = hashes[c]
    left, right = c.copy(), c.copy()
    for edge, forward in ((left, False), (right, True)):
        for k in [len(jumps) - 1, *range(len(jumps) - 1, -1, -1)]:
            size, table, active = 2 ** k, jumps[k], np.arange(len(c))
            while len(active):
                at = edge[active] + 1 if forward else edge[active] - size
                inside = (at >= 0) & (at < len(table))
                value = table[np.where(inside, at, 0)]
                free = inside & (value > own[active] if forward else value >= own[active])
                active = active[free]
                edge[active] += size if forward else -size
                if k < len(jumps) - 1:
                    break
    wide = right - left + 1 >= width
    return c[wide], left[wide], right[wide]


def thinned(hashes: np.ndarray, text: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose equal min-hashes repeat within ``STEP`` positions as one: the first, with the reach of all.

    Where a text repeats a word or a few, a shingle comes at every position or so, each with a window of
    its own around the same surroundings. The one that stands for them reaches ``STEP`` further to both
    sides, as it may meet another text's repeats that far off their own diagonal.
    """
    near = (hashes[c[1:]] == hashes[c[:-1]]) & (text[1:] == text[:-1]) & (np.diff(c) < STEP)
    begins = np.flatnonzero(np.concatenate([[True], ~near]))
    from_first = c - c[begins][np.cumsum(np.concatenate([[True], ~near])) - 1]
    part = from_first // STEP
    new = np.concatenate([[True], ~near | (part[1:] != part[:-1])])
    at = np.flatnonzero(new)
    several = np.diff(np.append(at, len(c))) > 1
    low, high = np.minimum.reduceat(left, at), np.maximum.reduceat(right, at)
    return at, np.where(several, low - STEP, low), np.where(several, high + STEP, high)


def windows(docs: DataFrame, min_words: int, hashes: int) -> DataFrame:
    """A row per window: key (function and min-hash), context, doc_id, position and reach to both sides."""
    width = max(1, min_words - SHINGLE + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, starts = shingles(*word_hashes(part.column("text")))
                n = part.num_rows
                text = np.repeat(np.arange(n), np.diff(starts))
                place = np.arange(len(values)) + text + 1  # a zero before each text
                spread = np.zeros(len(values) + n + 1, np.uint64)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                begin = starts[:-1] + np.arange(n) + 1
                for f in range(hashes):
                    spread[place] = np.maximum(mix(values * _ODD[f] + np.uint64(f)), np.uint64(1))
                    c, left, right = compact_windows(spread, width)
                    if not len(c):
                        continue
                    at = np.searchsorted(place, c)
                    some, left, right = thinned(spread, text[at], c, left, right)
                    c, at = c[some], at[some]
                    left, right = np.maximum(left, begin[text[at]]), np.minimum(right, begin[text[at]] + np.diff(starts)[text[at]] - 1)
                    ahead = np.minimum(at + width // 2, starts[text[at] + 1] - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mix(spread[c] + np.uint64(f)).view(np.int64)), pa.array(values[ahead].astype(np.int64).astype(np.int32)),
                         pa.array(ids[text[at]]), pa.array((c - begin[text[at]]).astype(np.int32)),
                         pa.array(((c - left) << 32 | (right - c))), pa.array(np.full(len(c), f, np.int32))],
                        ["key", "context", "doc_id", "c", "reach", "f"])
    return docs.mapInArrow(run, "key long, context int, doc_id long, c int, reach long, f int")


def _pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs out of rows sorted by key, context, doc_id: each row with the first of its key and context;
    those firsts with the first of the key and with the one before. State is two rows, whatever a run's length.
    Every row of a key with two or more is an end of a pair; a and b may be one document."""
    names = ["key", "context", "doc_id", "c", "reach", "f"]
    first = lead = None  # of the key; of the key and context
    own = "key"  # what the key was before it was dealt
    for batch in batches:
        if "own" in batch.schema.names and own == "key":
            own, names = "own", [*names, "own"]
        t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        held = [x for x in (first, lead) if x is not None]
        t = {c: np.concatenate([np.array([x[c] for x in held], t[c].dtype), t[c]]) for c in names}
        n, h = len(t["key"]), len(held)
        row = np.arange(n)
        new_key = np.concatenate([[True], t["key"][1:] != t["key"][:-1]])
        new_sub = new_key | np.concatenate([[True], t["context"][1:] != t["context"][:-1]])
        of_key = np.maximum.accumulate(np.where(new_key, row, 0))
        of_sub = np.maximum.accumulate(np.where(new_sub, row, 0))
        before = of_sub[np.maximum(of_sub - 1, 0)]
        fresh = row[h:]
        leads = fresh[of_sub[fresh] == fresh]
        a = np.concatenate([of_sub[fresh], of_key[leads], before[leads]])
        b = np.concatenate([fresh, leads, leads])
        ok = (t["key"][a] == t["key"][b]) & (a != b)
        ok[len(fresh) + len(leads):] &= before[leads] != of_key[leads]
        a, b = a[ok], b[ok]
        swap = t["doc_id"][a] > t["doc_id"][b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        reach = lambda side, shift: (t["reach"][side] >> shift) & 0xFFFFFFFF
        before_c = np.minimum(reach(a, 32), reach(b, 32))
        after_c = np.minimum(reach(a, 0), reach(b, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(t[own][a]), pa.array(t["c"][a]), pa.array(t["c"][b]), pa.array(t["reach"][a]), pa.array(t["reach"][b]),
             pa.array(t["doc_id"][a]), pa.array(t["doc_id"][b]), pa.array((t["c"][a] - before_c).astype(np.int32)),
             pa.array((t["c"][a] + after_c).astype(np.int32)), pa.array((t["c"][b] - before_c).astype(np.int32)),
             pa.array((t["c"][b] + after_c).astype(np.int32)), pa.array(np.int32(1) << t["f"][a])],
            ["key", "a_c", "b_c", "a_reach", "b_reach", "a", "b", "a_from", "a_to", "b_from", "b_to", "fs"])
        first = {c: t[c][of_key[-1]] for c in names}
        lead = {c: t[c][of_sub[-1]] for c in names}


def _stretches(batches: Iterator[pa.RecordBatch], width: int, enough: int) -> Iterator[pa.RecordBatch]:
    """Interval join within each pair of documents (rows sorted by a, b, a_from): stretches of overlapping
    windows, kept if at least ``enough`` hash functions are among them."""
    names = ["a", "b", "a_from", "a_to", "b_from", "b_to", "fs"]
    held: dict[str, np.ndarray] = {}

    def found(t: dict[str, np.ndarray]) -> pa.RecordBatch:
        pair = np.cumsum(np.concatenate([[0], (t["a"][1:] != t["a"][:-1]) | (t["b"][1:] != t["b"][:-1])]))
        reach = np.maximum.accumulate(t["a_to"].astype(np.int64) + pair * (1 << 33)) - pair * (1 << 33)
        new = np.concatenate([[True], (np.diff(pair) > 0) | (t["a_from"][1:] > reach[:-1])])
        at = np.flatnonzero(new)
        fs = np.bitwise_or.reduceat(t["fs"], at)
        low, high = (f.reduceat(t[c], at) for f, c in ((np.minimum, "b_from"), (np.maximum, "b_to")))
        end = np.maximum.reduceat(t["a_to"], at)
        ok = (np.bitwise_count(fs) >= enough) & (end - t["a_from"][at] + 1 >= width) & (high - low + 1 >= width)
        return pa.RecordBatch.from_arrays(
            [pa.array(x[ok]) for x in (t["a"][at], t["b"][at], t["a_from"][at], end, low, high)],
            ["a", "b", "a_from", "a_to", "b_from", "b_to"])

    for batch in batches:
        t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        t = {c: np.concatenate([held[c], t[c]]) if held else t[c] for c in names}
        last = (t["a"] == t["a"][-1]) & (t["b"] == t["b"][-1])
        held = {c: t[c][last] for c in names}
        if not last.all():
            yield found({c: t[c][~last] for c in names})
    if held:
        yield found(held)


def dense(i: np.ndarray, j: np.ndarray, width: int, threshold: float) -> list[tuple[int, int]]:
    """First and last match of stretches of a chain that are ``width`` long and as similar as ``threshold``.

    With m matches over a and b shingles a stretch is similar enough if (1 + t) m - t (a + b) >= 0, a
    difference of running sums; so each match has a farthest end. Given are the fewest of these
    stretches that together cover what all of them cover.
    """
    rise = (1 + threshold) * np.arange(len(i)) - threshold * (i + j)
    best_after = np.maximum.accumulate(rise[::-1])[::-1]
    far = np.searchsorted(-best_after, -(rise - (1 - threshold) - 1e-9), side="right") - 1
    starts = np.flatnonzero((i[far] - i + 1 >= width) & (j[far] - j + 1 >= width))
    out, at = [], 0
    while at < len(starts):
        p = starts[at]
        end = far[p]
        out.append((p, end))
        inside = np.searchsorted(starts, end, side="right")
        further = at + np.flatnonzero(far[starts[at:inside]] > end)
        at = further[far[starts[further]].argmax()] if len(further) else inside
    return out


def passages(x: np.ndarray, y: np.ndarray, width: int, threshold: float) -> list[tuple[int, int, int, int]]:
    """Near-duplicate stretches (from, past the end) of two shingle rows of at least ``width`` shingles each.

    Equal shingles are chained along both rows with gaps of at most ``GAP``; a chain counts if the
    Jaccard similarity of the two stretches reaches the threshold. Of a chain that doesn't, its
    longest stretches that reach it count, and its runs without a gap; both if they are long enough.
    """
    order = np.argsort(y, kind="stable")
    where = np.searchsorted(y[order], x)
    hit = np.flatnonzero((where < len(y)) & (y[order[np.minimum(where, len(y) - 1)]] == x))
    if len(hit) < width * threshold:
        return []
    i, j = hit, order[where[hit]]
    # A shingle that y has again further on is followed along the chain's own diagonal where that fits.
    along = np.minimum(j[:-1] + np.diff(i), len(y) - 1)
    fits = y[along] == x[i[1:]]
    for k in np.flatnonzero(fits & (j[1:] != along)) + 1:
        follow = j[k - 1] + i[k] - i[k - 1]
        if follow < len(y) and y[follow] == x[i[k]]:
            j[k] = follow
    out = []

    def chains(i, j, gap):
        step_i, step_j = np.diff(i), np.diff(j)
        cuts = np.flatnonzero((step_i > gap) | (step_j > gap) | (step_j < 1)) + 1
        return zip(np.split(i, cuts), np.split(j, cuts))

    def alike(a, b, c, d):
        s, t = np.unique(x[a:b]), np.unique(y[c:d])
        both = len(np.intersect1d(s, t, assume_unique=True))
        return both >= threshold * (len(s) + len(t) - both)

    for ci, cj in chains(i, j, GAP):
        if ci[-1] - ci[0] + 1 < width or cj[-1] - cj[0] + 1 < width:
            continue
        if alike(ci[0], ci[-1] + 1, cj[0], cj[-1] + 1):
            out.append((ci[0], ci[-1] + 1, cj[0], cj[-1] + 1))
            continue
        found = [(ci[p], ci[q] + 1, cj[p], cj[q] + 1) for p, q in dense(ci, cj, width, threshold)]
        out += [x for x in found if alike(*x)]
        for ri, rj in chains(ci, cj, 1):
            run = (ri[0], ri[-1] + 1, rj[0], rj[-1] + 1)
            if len(ri) >= width and not any(o[0] <= run[0] and run[1] <= o[1] and o[2] <= run[2] and run[3] <= o[3] for o in out):
                out.append(run)
    return out


def _verified(stretches: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, a_start, a_end, b_start, b_end) in words, of the stretches that hold a near-duplicate passage."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            for at in range(0, batch.num_rows, 64):
                seen.clear()
                rows = []
                for r in batch.slice(at, 64).to_pylist():
                    for side in ("a_text", "b_text"):
                        if r[side] not in seen:
                            seen[r[side]] = shingles(*word_hashes(pa.array([r[side]])))[0]
                    x = seen[r["a_text"]][max(0, r["a_from"]):r["a_to"] + 1]
                    y = seen[r["b_text"]][max(0, r["b_from"]):r["b_to"] + 1]
                    for p, q, s, t in passages(x, y, width, threshold):
                        a, b = max(0, r["a_from"]), max(0, r["b_from"])
                        rows.append((r["a"], r["b"], a + p, a + q + SHINGLE - 1, b + s, b + t + SHINGLE - 1))
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in cols],
                                                 ["a", "b", "a_start", "a_end", "b_start", "b_end"])
            pa.default_memory_pool().release_unused()
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    return (stretches.join(b, "b").join(a, "a").mapInArrow(
        run, "a long, b long, a_start long, a_end long, b_start long, b_end long"))


def _contexts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` (doc_id, key, c, reach, fs, label) with hashes of the ``LENGTHS`` shingles from c on and up to c, null where the text is shorter."""
    names = ["key", "c", "reach", "fs", "label"]
    kinds = "doc_id long, key long, c int, reach long, fs int, label long, contexts array<long>"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, starts = shingles(*word_hashes(part.column("text")))
                lists = part.column("rows")
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                fields = {c: flat.field(c) for c in names}
                c = starts[owner] + fields["c"].to_numpy(zero_copy_only=False)
                first, end = starts[owner], starts[owner + 1]
                found, known = [], []
                for side in (1, -1):
                    hashes, inside = np.zeros(len(c), np.uint64), np.ones(len(c), bool)
                    for k in range(LENGTHS[-1]):
                        at = c + side * k
                        inside &= (at >= first) & (at < end)
                        hashes = mix(hashes * np.uint64(31) + values[np.where(inside, at, 0)] + np.uint64(k + 1)) if len(values) else hashes
                        if k + 1 in LENGTHS:
                            found.append(hashes.view(np.int64))
                            known.append(inside.copy())
                contexts = pa.array(np.stack(found, 1).ravel(), mask=~np.stack(known, 1).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * len(found)), contexts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner)), *(x.cast(t) for x, t in zip(fields.values(), types[1:])), lists],
                    ["doc_id", *names, "contexts"])

    of_doc = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("rows"))  # at most a document's windows
    return texts.join(of_doc, "doc_id").select("doc_id", "text", "rows").mapInArrow(run, kinds)


def residual_pairs(pairs: DataFrame, spans: DataFrame, plain: DataFrame) -> DataFrame:
    """Pairs (a, b, a_from, a_to, b_from, b_to, fs) that the leaders left out: rows of one key not yet joined there.

    Of the first ``AGAIN`` hash functions; rows are joined if they lie in passages found with the same smallest document. Rows of a key whose
    rows aren't all joined meet through longer contexts: each with the first row that has the same
    16, 23, 32 or 45 shingles before or after the key's own. A passage of 46 shingles and more has 23 to one side of
    any place in it, and whatever lies around a frequent line, the longest context that two rows share there is
    one that few others do. The number of pairs grows with the rows, however many share a key.
    """
    again = pairs.where(F.col("fs") < 1 << AGAIN)
    ends = [again.select("key", "fs", F.col(x).alias("doc_id"), F.col(f"{x}_c").alias("c"), F.col(f"{x}_reach").alias("reach")) for x in "ab"]
    rows = ends[0].unionAll(ends[1]).distinct()
    have = small(spans.select(F.col("doc_id").alias("of"), "start_word", "end_word", "first_doc"))
    rows = cut(rows.join(have, F.expr("doc_id = of and c >= start_word and c < end_word"), "left")
               .groupBy("key", "fs", "doc_id", "c", "reach").agg(F.min("first_doc").alias("label"))
               .withColumn("label", F.coalesce("label", F.xxhash64("doc_id", "c"))))
    keys = small(rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("doc_id").alias("one"), F.max("doc_id").alias("other"))
                 .where("lo <> hi and one <> other").select("key"))
    apart = cut(rows.join(keys, "key"))
    texts = plain.join(small(apart.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = cut(_contexts(apart, texts), TEXT_BATCH)

    def groups(rows: DataFrame, slots: Column) -> DataFrame:
        """A row per row and slot, with one number for key, slot and context."""
        each = rows.select("doc_id", "c", "reach", "fs", "label", "key", F.posexplode("contexts").alias("slot", "context"))
        return each.where(F.col("context").isNotNull() & slots).withColumn("group", F.xxhash64("key", "slot", "context")).drop("context", "slot", "key")

    # Rows that share a long context share its first shingles, so those few slots tell which rows can meet at all.
    short = F.col("slot").isin(0, len(LENGTHS))
    some = small(groups(rows, short).groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("group"))
    able = small(groups(rows, short).join(some, "group", "left_semi").select("doc_id", "c").distinct())
    each = cut(groups(rows.join(able, ["doc_id", "c"], "left_semi"), F.lit(True)))
    first = small(each.groupBy("group").agg(
        F.min(F.struct("doc_id", "c", "reach", "label")).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("lo <> hi").select("group", "lead"))
    met = each.join(first, "group").where("lead.doc_id <> doc_id and lead.label <> label")
    met = met.select("fs", F.col("lead.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("lead.c").alias("a_c"), F.col("c").alias("b_c"),
                     F.col("lead.reach").alias("a_reach"), F.col("reach").alias("b_reach")).distinct()
    before = F.least(F.shiftright("a_reach", 32), F.shiftright("b_reach", 32))
    after = F.least(F.col("a_reach").bitwiseAND(F.lit(0xFFFFFFFF)), F.col("b_reach").bitwiseAND(F.lit(0xFFFFFFFF)))
    return met.select("a", "b", *[(F.col(f"{x}_c") + (after if to else -before)).cast("int").alias(f"{x}_{'to' if to else 'from'}")
                                  for x in "ab" for to in (False, True)], "fs")


def _hot(docs: DataFrame, min_words: int, hashes: int) -> DataFrame:
    """Keys that come more than 20 times in one in 64 documents, the most frequent thousand of them at most.

    The bound only decides what is dealt over many tasks; results don't depend on it.
    """
    seen = windows(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0), min_words, hashes)
    counts = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 20").orderBy(F.desc("n"), "key").limit(1000).select("key")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = 0.8, hashes: int = HASHES,
                      enough: int = ENOUGH) -> DataFrame:
    """doc_id, start_word, end_word (past the end), first_doc, kept: passages that another document has too.

    A passage has at least ``min_words`` words and meets another document's at a Jaccard similarity
    of five-word shingles of ``threshold`` or more. Overlapping passages of a document are one row.
    ``kept`` is true where no document with a smaller id has the passage; ``first_doc`` is the
    smallest id it was found with. Repeats within one document alone are not looked for.

    Texts that are null, empty or shorter have no passage. Rows that repeat a doc_id count as one, by
    their smallest text; rows without an id are left out; an empty table gives no rows.
    """
    width = max(1, min_words - SHINGLE + 1)
    plain = one_text_per_id(docs).where("text is not null")
    every = windows(plain, min_words, hashes)
    # Keys known to be hot are dealt over many tasks; each part has leaders of its own, and the parts' leaders meet once more.
    hot = cut(_hot(plain, min_words, hashes).withColumn("hot", F.lit(True)), TEXT_BATCH)
    some_hot = not hot.isEmpty()
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(64))).otherwise(F.lit(-1)).cast("int")
    dealt = every.join(F.broadcast(hot), "key", "left").withColumn("salt", salt) if some_hot else every.withColumn("salt", F.lit(-1))
    order = ["key", "context", "doc_id", "c", "reach", "f"]
    runs = dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "context", "doc_id", "c")
    shape = ("key long, a_c int, b_c int, a_reach long, b_reach long, "
             "a long, b long, a_from int, a_to int, b_from int, b_to int, fs int")
    pairs = runs.withColumn("own", F.col("key")).withColumn("key", F.when(F.col("salt") >= 0, F.xxhash64("key", "salt")).otherwise(F.col("key"))).select(*order, "own").mapInArrow(_pair_runs, shape)
    met = pairs
    if some_hot:
        leads = (every.join(F.broadcast(hot), "key").withColumn("salt", salt).groupBy("key", "salt", "context")
                 .agg(F.min_by(F.struct("doc_id", "c", "reach", "f"), F.struct("doc_id", "c")).alias("x")).select("key", "context", "x.*"))
        met = pairs.unionAll(leads.repartition("key").sortWithinPartitions("key", "context", "doc_id", "c").select(*order, F.col("key").alias("own"))
                             .mapInArrow(_pair_runs, shape))
    met = cut(met, TEXT_BATCH)

    def spans_of(met: DataFrame, enough: int) -> DataFrame:
        met = met.where("a <> b").repartition("a", "b").sortWithinPartitions("a", "b", "a_from").select("a", "b", "a_from", "a_to", "b_from", "b_to", "fs")
        stretches = cut(met.mapInArrow(lambda it: _stretches(it, width, enough),
                                       "a long, b long, a_from int, a_to int, b_from int, b_to int"))
        ends = small(stretches.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        texts = cut(plain.join(ends, "doc_id", "left_semi"))
        return cut(_spans(_verified(stretches, texts, width, threshold)), TEXT_BATCH)

    spans = spans_of(met, enough)
    left = residual_pairs(met, cut(_merged(spans)), plain)
    return _merged(spans.unionAll(spans_of(left, 1)))


def _spans(links: DataFrame) -> DataFrame:
    """Both ends of every link: doc_id, start_word, end_word, kept, and the smallest document it was found with."""
    return (links.select(F.inline(F.array(
        F.struct(F.col("a").alias("doc_id"), F.col("a_start").alias("start_word"), F.col("a_end").alias("end_word"),
                 F.col("a").alias("first_doc"), F.lit(True).alias("kept")),
        F.struct(F.col("b").alias("doc_id"), F.col("b_start").alias("start_word"), F.col("b_end").alias("end_word"),
                 F.col("a").alias("first_doc"), F.lit(False).alias("kept")))))
        .groupBy("doc_id", "start_word", "end_word", "kept").agg(F.min("first_doc").alias("first_doc")))


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document and kind as one; a stretch that an earlier document has isn't kept for a later one."""
    by = Window.partitionBy("doc_id", "kept").orderBy("start_word", "end_word")
    before = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_word") > F.coalesce(F.col("before"), F.lit(-1)), 1).otherwise(0)).over(by)
    merged = (spans.withColumn("before", before).withColumn("island", island).groupBy("doc_id", "kept", "island")
            .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_doc").alias("first_doc"))
            .select("doc_id", "start_word", "end_word", "first_doc", "kept"))
    gone = merged.where("not kept").select(F.col("doc_id").alias("other"), F.col("start_word").alias("from"), F.col("end_word").alias("to"))
    first = merged.where("kept").join(
        gone, F.expr("doc_id = other and start_word < to and end_word > from and least(end_word, to) - greatest(start_word, from) >= 0.8 * (end_word - start_word)"), "left_anti")
    return first.unionByName(merged.where("not kept"))


def remove_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of spans that aren't kept, and ``__was_cut``; rows and columns stay, ``n_chars`` follows the text."""
    out = spans.where("not kept").groupBy(F.col("doc_id").alias("__span_doc")).agg(
        F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("__spans"))
    schema = docs.withColumn("__was_cut", F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans_of, texts = part.column("__spans").to_pylist(), part.column("text").to_pylist()
                cut_here = [bool(own) and text is not None for own, text in zip(spans_of, texts)]
                texts = [cut_words(text, [(s["start_word"], s["end_word"]) for s in own]) if yes else text
                         for yes, own, text in zip(cut_here, spans_of, texts)]
                part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
                yield part.append_column("__was_cut", pa.array(cut_here)).select(schema.names)

    few = small(out, 200_000)  # a row per document with something to cut
    joined = docs.join(few, docs["doc_id"] == F.col("__span_doc"), "left").drop("__span_doc")
    cleaned = joined.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        n = F.when(F.col("__was_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", n)
    return cleaned


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words from each span's first to before its end, counted as ``word_spans`` does.

    Where lower-casing changes a text's length in bytes, words are found in the text as it is.
    """
    raw = text.encode()
    lowered, first, last, _ = word_spans(pa.array([text]))
    if len(lowered) != len(raw):
        from almanac.llm.hashing import _IS_WORD
        is_word = np.concatenate([[False], _IS_WORD[np.frombuffer(raw, np.uint8)], [False]])
        first, last = np.flatnonzero(is_word[1:-1] & ~is_word[:-2]), np.flatnonzero(is_word[1:-1] & ~is_word[2:]) + 1
    keep = np.ones(len(raw), bool)
    for a, b in spans:
        if a < len(first):
            keep[first[a]:last[min(b, len(last)) - 1]] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "ignore").strip()
