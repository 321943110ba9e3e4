"""Mixing sources to target weights: token weights raked to marginals, then calibrated sampling.

Documents fall into cells by source, language and topic. Iterative proportional fitting scales
the cells' token mass, one margin after the other, until each margin has its target shares. A
document is then kept with its cell's ratio of fitted to present mass, divided by the largest
such ratio, so that the kept tokens have the target shares in expectation and no document is
needed twice. With a ``budget`` the kept tokens are that share of all instead: cells whose ratio would
be above one are kept whole, and the others are raked again to what is left, so a tiny cell sets no
scale. The draw is a hash of the document's id, so it is the same in every run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.plans.lineage import cut

SWEEPS = 12
POWER = 0.7
ON_DRIVER = 100_000
"""Cells up to this number are fitted in one place; more are fitted by joins, to the same result."""
NONE = "(none)"
ADDED = ("mix_tokens", "mix_probability", "mix_sampled")
TOPICS = (("table", "|"), ("licence", "icense"), ("contact", "@"), ("lines", "\n"))


def topic(text: Column) -> Column:
    """The first kind whose mark is in the text, else ``prose``."""
    out = F
    for name, mark in TOPICS:
        out = out.when(F.contains(text, F.lit(mark)), F.lit(name))
    return out.otherwise(F.lit("prose"))


def tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def draw(doc_id: Column) -> Column:
    """A number from 0 to below 1 by the id's hash."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rake(cells: pd.DataFrame, margins: list[str], targets: dict[str, dict[str, float]], sweeps: int) -> np.ndarray:
    """Fitted mass of every cell (columns of ``margins``, mass): one scaling per margin and sweep."""
    fitted = cells["mass"].to_numpy(float).copy()
    codes = {m: pd.factorize(cells[m]) for m in margins}
    for _ in range(sweeps):
        for m in margins:
            code, names = codes[m]
            have = np.bincount(code, fitted, len(names))
            want = np.array([targets[m].get(x, 0.0) for x in names])
            fitted *= np.divide(want, have, out=np.zeros(len(names)), where=have > 0)[code]
    return fitted


def _rake_joined(cells: DataFrame, margins: list[str], targets: dict[str, DataFrame], sweeps: int) -> DataFrame:
    """The same by joins, for any number of cells."""
    fitted = cells.withColumn("fitted", F.col("mass"))
    for _ in range(sweeps):
        for m in margins:
            have = fitted.groupBy(m).agg(F.sum("fitted").alias("have")).join(targets[m], m, "left")
            ratio = have.select(m, F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("ratio"))
            fitted = fitted.join(ratio, m).withColumn("fitted", F.col("fitted") * F.col("ratio")).drop("ratio")
        fitted = cut(fitted)
    return fitted


def within_budget(cells: pd.DataFrame, margins: list[str], targets: dict[str, dict[str, float]], sweeps: int, budget: float) -> np.ndarray:
    """Kept share of every cell, at most 1, so that ``budget`` of all mass is kept and margins are as near their targets as that allows."""
    mass = cells["mass"].to_numpy(float)
    wanted = np.ones(len(cells), bool)
    for m in margins:
        wanted &= cells[m].map(targets[m]).fillna(0.0).to_numpy(float) > 0
    goal = min(budget * mass.sum(), mass[wanted].sum())
    whole = np.zeros(len(cells), bool)
    kept = np.zeros(len(cells))
    while True:
        free = wanted & ~whole
        kept = np.where(whole, mass, 0.0)
        rest = goal - kept.sum()
        if not free.any() or rest <= 0:
            return kept / mass
        left = {}
        for m in margins:
            names = cells.loc[free, m].unique()
            fixed = cells[m].map(pd.Series(kept).groupby(cells[m].to_numpy()).sum())
            fixed = dict(zip(cells[m], fixed))
            want = {x: max(targets[m][x] * goal - fixed[x], 0.0) for x in names}
            total = sum(want.values())
            even = {x: float(mass[free & (cells[m] == x).to_numpy()].sum()) for x in names} if total <= 0 else want
            left[m] = {x: w * rest / sum(even.values()) for x, w in even.items()}
        kept[free] = rake(cells[free].reset_index(drop=True), margins, left, sweeps)
        kept[free] *= rest / kept[free].sum() if kept[free].sum() > 0 else 0.0
        over = free & (kept > mass)
        if not over.any():
            return kept / mass
        whole |= over


def mix(docs: DataFrame, margins: dict[str, Column], targets: dict[str, dict[str, float]] | None = None,
        power: float = POWER, sweeps: int = SWEEPS, on_driver: int = ON_DRIVER, budget: float | None = None) -> DataFrame:
    """``docs`` with ``mix_tokens``, ``mix_probability`` and ``mix_sampled``; rows and columns stay.

    ``targets`` gives a margin's shares by value; a margin without has its present token shares
    to the power ``power``. Shares are scaled to one. A value without a target, and a cell without
    tokens, gets probability 0, so texts without a word aren't sampled. Null values are a value of
    their own, ``(none)``; repeated ids are drawn alike; an empty table gives no rows.

    Without ``budget`` the cell with the largest ratio is kept whole, so how much is kept depends on
    the rarest cell. ``budget`` is the share of all tokens to keep in expectation; it is fitted in
    one place, whatever ``on_driver``.
    """
    targets = targets or {}
    names = list(margins)
    keys = {f"__mix_{m}": F.coalesce(c.cast("string"), F.lit(NONE)) for m, c in margins.items()}
    marked = docs.withColumns(keys | {"mix_tokens": tokens(F.col("text"))})
    cells = cut(marked.groupBy(*keys).agg(F.sum("mix_tokens").cast("double").alias("mass")).where("mass > 0"))

    def wanted(m: str) -> DataFrame:
        if m in targets:
            rows = [(k, float(v)) for k, v in targets[m].items()]
            share = cells.sparkSession.createDataFrame(rows, f"__mix_{m} string, want double")
            share = share.join(cells.select(f"__mix_{m}").distinct(), f"__mix_{m}")
        else:
            share = cells.groupBy(f"__mix_{m}").agg(F.pow(F.sum("mass"), F.lit(power)).alias("want"))
        total = share.agg(F.sum("want").alias("total"))
        return share.withColumn("want", F.col("want") / total.select("total").scalar())

    if budget is not None or cells.count() <= on_driver:
        table = cells.toArrow().to_pandas().sort_values(list(keys), ignore_index=True)
        goal = {}
        for m in names:
            share = pd.Series(targets[m], dtype=float) if m in targets else table.groupby(f"__mix_{m}")["mass"].sum() ** power
            share = share[share.index.isin(table[f"__mix_{m}"])]
            goal[f"__mix_{m}"] = (share / share.sum()).to_dict() if len(share) and share.sum() > 0 else {}
        if budget is not None:
            table["mix_probability"] = within_budget(table, list(keys), goal, sweeps, budget)
        else:
            table["ratio"] = rake(table, list(keys), goal, sweeps) / table["mass"]
            top = table["ratio"].max() if len(table) else 0.0
            table["mix_probability"] = table["ratio"] / top if top > 0 else 0.0
        schema = ", ".join(f"{k} string" for k in keys) + ", mix_probability double"
        rated = cells.sparkSession.createDataFrame(table[[*keys, "mix_probability"]].to_records(index=False).tolist(), schema)
        if len(table) <= ON_DRIVER:
            rated = F.broadcast(rated)
    else:
        fitted = _rake_joined(cells, list(keys), {f"__mix_{m}": wanted(m) for m in names}, sweeps)
        ratio = fitted.withColumn("ratio", F.col("fitted") / F.col("mass"))
        top = ratio.agg(F.max("ratio").alias("top")).select("top").scalar()
        rated = ratio.select(*keys, (F.col("ratio") / top).alias("mix_probability"))
    return (marked.join(rated, list(keys), "left").withColumn("mix_probability", F.when(F.col("mix_tokens") > 0, F.coalesce("mix_probability", F.lit(0.0))).otherwise(F.lit(0.0)))
            .withColumn("mix_sampled", draw(F.col("doc_id")) < F.col("mix_probability"))
            .select(*[c for c in docs.columns if c not in ADDED], *ADDED))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``mix`` by source, language and topic of ``documents``."""
    return mix(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}, **options)


def sql(table: str = "documents", sweeps: int = SWEEPS, power: float = POWER) -> str:
    """The same in SQL, sweeps written out: doc_id, n_tokens, probability, sampled."""
    cases = " ".join(f"WHEN contains(text, '{m}') THEN '{n}'" if m != "\n" else f"WHEN contains(text, chr(10)) THEN '{n}'" for n, m in TOPICS)
    steps, last = [], "m0"
    for i in range(sweeps):
        for c in ("source", "lang", "topic"):
            name = f"m{len(steps) + 1}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.mass, c.fitted * t.want / sum(c.fitted) OVER (PARTITION BY c.{c}) AS fitted "
                f"FROM {last} c JOIN t_{c} t ON c.{c} = t.{c})")
            last = name
    margins = ", ".join(
        f"t_{c} AS MATERIALIZED (SELECT {c}, w / sum(w) OVER () AS want FROM (SELECT {c}, pow(sum(mass), {power}) AS w FROM m0 GROUP BY {c}))"
        for c in ("source", "lang", "topic"))
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
         CASE {cases} ELSE 'prose' END AS topic,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS n_tokens
  FROM {table}
), m0 AS MATERIALIZED (
  SELECT source, lang, topic, mass, mass AS fitted
  FROM (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM d GROUP BY ALL) WHERE mass > 0
), {margins}, {", ".join(steps)},
p AS (SELECT source, lang, topic, fitted / mass / max(fitted / mass) OVER () AS p FROM {last})
SELECT d.doc_id, CAST(d.n_tokens AS BIGINT) AS n_tokens, round(CASE WHEN d.n_tokens > 0 THEN coalesce(p.p, 0) ELSE 0 END, 6) AS probability,
       CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < CASE WHEN d.n_tokens > 0 THEN coalesce(p.p, 0) ELSE 0 END AS sampled
FROM d LEFT JOIN p USING (source, lang, topic)
"""
