"""Empirical mode decomposition: sifting with cubic envelopes, for all stations and noise members at once.

A series is rows of blocks, each an array of at most ``size`` samples with one more on either
side. A sift takes every block's extrema, shortens the chain of its knots to the two outer ones,
solves the outer knots of each series (a few numbers per block), fills the blocks in again and
takes off the mean of both envelopes. No task holds a series, and block sizes don't change the
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions import chains
from almanac.plans import blocks
from almanac.plans.lineage import cut

KEYS = ["station_code", "station"]
SIDES = (1.0, -1.0)  # of the upper and the lower envelope
PART = 16
"""Blocks that a task of a sift gets, about: its work is heavy for its bytes."""

_ENDS = "n int, t array<double>, y array<double>, link array<double>"
_EDGE = "n int, first double, last double, t array<double>, y array<double>, m array<double>"


def _number(df: DataFrame, keys: list[str]) -> DataFrame:
    """Known rows with ``idx`` from 1 in date order: missing dates are left out, as time runs by samples."""
    rows = df.where("value is not null").select(*keys, "date", "pos", "value")
    return blocks.number_rows(rows.withColumnRenamed("pos", "own_pos"), keys).withColumnRenamed("pos", "idx").withColumnRenamed("own_pos", "pos")


def _noise(keys: list[str]):
    """A standard normal draw for (series, sample, pair), by two hashes."""
    def uniform(seed: int):
        bits = F.shiftrightunsigned(F.xxhash64(*keys, "idx", "pair", F.lit(seed)), 11)
        return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * np.pi * uniform(2))


def _state(series: DataFrame, keys: list[str], noise: float, pairs: int, size: int) -> DataFrame:
    """Blocks (keys, member, block, start, core_from, core_to, h, r) of every noise member.

    Members come in pairs with opposite noise, whose mean is the series itself.
    """
    if pairs:
        spread = series.groupBy(*keys).agg(F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("spread"))
        noisy = (series.join(spread, keys).withColumn("pair", F.explode(F.sequence(F.lit(1), F.lit(pairs))))
                 .withColumn("noise", noise * F.col("spread") * _noise(keys)))
        members = noisy.select(*keys, "idx", F.explode(F.array(
            F.struct((2 * F.col("pair")).alias("member"), (F.col("value") + F.col("noise")).alias("v")),
            F.struct((2 * F.col("pair") + 1).alias("member"), (F.col("value") - F.col("noise")).alias("v")))).alias("e")).select(*keys, "idx", "e.*")
    else:
        members = series.select(*keys, "idx", F.lit(0).alias("member"), F.col("value").alias("v"))
    dealt = blocks.halo(members.withColumnRenamed("idx", "pos"), [*keys, "member"], 1, 1, size)
    at = F.struct("pos", "v")
    grouped = dealt.groupBy(*keys, "member", "block").agg(
        F.sort_array(F.collect_list(at)).alias("rows"), F.min(F.when(F.col("core"), F.col("pos"))).alias("core_from"),
        F.max(F.when(F.col("core"), F.col("pos"))).alias("core_to")).where("core_from is not null")
    return grouped.select(*keys, "member", "block", F.col("rows.pos")[0].alias("start"), "core_from", "core_to",
                          F.col("rows.v").alias("h"), F.col("rows.v").alias("r"))


def _knots(h: np.ndarray, start: int, core_from: int, core_to: int, side: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of a block's own extrema: above the sample before and not below the one after."""
    v = side * h
    inner = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] >= v[2:])) + 1
    at = inner + start
    own = (at >= core_from) & (at <= core_to)
    return at[own].astype(float), h[inner[own]]


def _padded(knots: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(t) for t, _ in knots])
    width = max(2, n.max(initial=2))
    t, y = np.zeros((len(knots), width)), np.zeros((len(knots), width))
    for i, (a, b) in enumerate(knots):
        t[i, :len(a)], y[i, :len(b)] = a, b
        t[i, len(a):] = (a[-1] if len(a) else 0.0) + np.arange(1, width - len(a) + 1)
    return t, y, n


def _summaries(keys: list[str]):
    """Per block and side: how many knots, up to two from either end, and what the chain between its outer ones leaves."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[*keys, "member", "block", "core_from", "core_to"]].copy()
            for name, side in zip(("upper", "lower"), SIDES):
                knots = [_knots(*args, side) for args in zip(pdf["h"], pdf["start"], pdf["core_from"], pdf["core_to"])]
                t, y, n = _padded(knots)
                chain = chains.shorten(t, y, n)
                links = np.stack([chain.d0, chain.u, chain.d1, chain.r0, chain.r1], axis=1)
                outer = [np.r_[a[:2], a[max(2, len(a) - 2):]] for a, _ in knots], [np.r_[b[:2], b[max(2, len(b) - 2):]] for _, b in knots]
                out[name] = [{"n": int(k), "t": a, "y": b, "link": c} for k, a, b, c in zip(n, *outer, links)]
            yield out
    return run


def _one_side(ends: list[dict], start: float, stop: float) -> list[dict] | None:
    """Edges of all blocks of a series from their summaries, or None if there are fewer than two knots.

    Two knots are mirrored at the first and at the last sample; the curvature is zero at the outer ones.
    """
    some = [b for b, e in enumerate(ends) if e["n"]]
    if sum(ends[b]["n"] for b in some) < 2:
        return None
    near = [(t, y) for b in some[:2] for t, y in zip(ends[b]["t"][:2], ends[b]["y"][:2])][:2]
    far = [(t, y) for b in reversed(some[-2:]) for t, y in list(zip(ends[b]["t"], ends[b]["y"]))[:-3:-1]][:2]
    t, y = [2 * start - near[1][0], 2 * start - near[0][0]], [near[1][1], near[0][1]]
    links, place = [chains.gap(t[0], y[0], t[1], y[1])], {}

    def step(t1: float, y1: float, link=None) -> None:
        links.append(link or chains.gap(t[-1], y[-1], t1, y1))
        t.append(t1)
        y.append(y1)

    for b in some:
        e = ends[b]
        place[b] = len(t)
        step(e["t"][0], e["y"][0])
        if e["n"] > 1:
            step(e["t"][-1], e["y"][-1], tuple(e["link"]))
    step(2 * stop - far[0][0], far[0][1])
    step(2 * stop - far[1][0], far[1][1])
    m = chains.solve_ends(len(t), links)
    out, before = [], 1
    for b, e in enumerate(ends):
        first = place.get(b)
        last = before if first is None else first + (e["n"] > 1)
        around = [before if first is None else first - 1, last + 1]
        out.append({"n": e["n"], "first": m[first] if e["n"] else 0.0, "last": m[last] if e["n"] else 0.0,
                    "t": [t[i] for i in around], "y": [y[i] for i in around], "m": [m[i] for i in around]})
        before = last
    return out


def _edges(keys: list[str]):
    """Per block and side the curvature at its outer knots and the knots next to it; nulls for series without envelopes."""
    series = [*keys, "member"]

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        start, stop = float(pdf["core_from"].iloc[0]), float(pdf["core_to"].iloc[-1])
        sides = [_one_side(list(pdf[name]), start, stop) for name in ("upper", "lower")]
        out = pdf[[*series, "block"]].copy()
        for name, side in zip(("upper", "lower"), sides):
            out[name] = [None] * len(pdf) if None in sides else side
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            number = pdf.groupby(series, sort=False, dropna=False).ngroup()
            last = number.iloc[-1]
            done = [solved(own) for _, own in pdf[number < last].groupby(number[number < last], sort=False)]
            if done:
                yield pd.concat(done)
            rest = pdf[number == last]
        if rest is not None:
            yield solved(rest)
    return run


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _sifted(h: pd.Series, start: pd.Series, core_from: pd.Series, core_to: pd.Series, upper: pd.DataFrame, lower: pd.DataFrame,
            first: pd.Series) -> pd.Series:
    """Samples less the mean of both envelopes; without envelopes zero in the first sift, else as they are."""
    there = upper["n"].notna().to_numpy()
    out = [np.zeros(len(v)) if f else np.asarray(v) for v, f in zip(h, first)]
    rows = np.flatnonzero(there)
    if len(rows):
        mean = [np.zeros(len(h.iloc[i])) for i in rows]
        for edge, side in ((upper, SIDES[0]), (lower, SIDES[1])):
            knots = [_knots(h.iloc[i], start.iloc[i], core_from.iloc[i], core_to.iloc[i], side) for i in rows]
            t, y, n = _padded(knots)
            ends = [edge[c].to_numpy()[rows].astype(float) for c in ("first", "last")]
            m = chains.fill(t, np.maximum(n, 1), chains.shorten(t, y, n), *ends)
            for k, i in enumerate(rows):
                e = edge.iloc[i]
                around = [np.r_[e[c][0], own[k, :n[k]], e[c][1]] for c, own in (("t", t), ("y", y), ("m", m))]
                at = np.arange(len(h.iloc[i])) + float(start.iloc[i])
                mean[k] += chains.spline(at, *around) / 2
        for k, i in enumerate(rows):
            out[i] = h.iloc[i] - mean[k]
    return pd.Series(out)


def _sift(state: DataFrame, keys: list[str], first: bool, parts: int) -> DataFrame:
    own = [*keys, "member"]
    kinds = dict(state.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in [*own, "block"])
    ends = state.select(*own, "block", "start", "core_from", "core_to", "h").mapInPandas(
        _summaries(keys), f"{head}, core_from long, core_to long, upper struct<{_typed(_ENDS)}>, lower struct<{_typed(_ENDS)}>")
    edges = ends.repartition(parts, *own).sortWithinPartitions(*own, "block").mapInPandas(
        _edges(keys), f"{head}, upper struct<{_typed(_EDGE)}>, lower struct<{_typed(_EDGE)}>")
    place = [*own, "block"]
    return state.repartition(parts, *place).join(edges.repartition(parts, *place), place).withColumn(
        "h", _sifted("h", "start", "core_from", "core_to", "upper", "lower", F.lit(first))).drop("upper", "lower")


def _typed(fields: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))


def sifted_components(df: DataFrame, n: int = 4, sifts: int = 8, noise: float = 0.2, pairs: int = 4, keys: list[str] = KEYS,
                      size: int = 0) -> DataFrame:
    """(keys, component, date, pos, series_value, value): ``n`` modes of every series, fast to slow, and what remains.

    Ensemble decomposition: each member is the series with noise of ``noise`` of its standard
    deviation; modes are the members' means. Members come in ``pairs`` of opposite noise, so the
    components add up to the series. Without pairs the series itself is sifted.

    A mode is what ``sifts`` sifts leave. A sift takes off the mean of two natural cubic splines,
    through the maxima and the minima, two of which are mirrored at either end. A series with fewer
    than two maxima or minima has no further mode: components are zero, the rest stays. Rows without a
    value are left out, time runs by samples.

    ``size`` is a block's number of samples. Every sift reads the blocks once, exchanges some numbers
    per block, and writes the blocks again.
    """
    series = cut(_number(df, keys))
    state = cut(_state(series, keys, noise, pairs, size or blocks.BLOCK))
    parts = -(-state.count() // PART) or 1
    for c in range(1, n + 1):
        for s in range(sifts):
            state = _sift(state, keys, s == 0, parts)
            if s == sifts - 1:
                state = (state.withColumn(f"c{c}", F.col("h")).withColumn("r", F.zip_with("r", "h", lambda a, b: a - b))
                         .withColumn("h", F.col("r")))
            state = cut(state)
    names = [f"c{c}" for c in range(1, n + 1)] + ["r"]
    own = lambda c: F.slice(c, (F.col("core_from") - F.col("start") + 1).cast("int"), (F.col("core_to") - F.col("core_from") + 1).cast("int"))
    samples = state.select(*keys, "core_from", F.posexplode(F.arrays_zip(*[own(c).alias(c) for c in names])).alias("at", "e"))
    means = samples.groupBy(*keys, (F.col("core_from") + F.col("at")).alias("idx")).agg(*[F.avg(f"e.{c}").alias(c) for c in names])
    parts = F.array(*[F.struct(F.lit(i).alias("component"), F.col(c).alias("value")) for i, c in enumerate(names, start=1)])
    return (series.withColumnRenamed("value", "series_value").join(means, [*keys, "idx"])
            .select(*keys, "date", "pos", "series_value", F.explode(parts).alias("e"))
            .select(*keys, "e.component", "date", "pos", "series_value", "e.value"))
