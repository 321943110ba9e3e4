"""Hard negatives against a plain search over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, score long, rank int"


def expected(rows, is_anchor, k=5, n=5, lower=80, upper=100):
    """``rows``: {id: (label, whole-number vector)}."""
    out = set()
    for a, (label, x) in rows.items():
        if not is_anchor(a):
            continue
        scored = sorted((-int(x @ y), c, lab) for c, (lab, y) in rows.items() if c != a and len(x) == len(y))
        positives = [(c, -s) for s, c, lab in scored if lab == label][:k]
        others = [(c, -s) for s, c, lab in scored if lab != label]
        for p, score in positives:
            fit = [(c, s) for c, s in others if lower * score <= 100 * s <= upper * score][:n]
            out |= {(a, p, i + 1, c, score, s) for i, (c, s) in enumerate(fit)}
    return out


def as_rows(table):
    return negatives.labelled(table).select("id", "label", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def table(spark):
    """A label of over half the rows, equal vectors and ties, negative scores, another length, repeated ids, unusable rows."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(12)
    rows = [(i, (0.6 * centre + rng.standard_normal(12)).round(1).tolist(), 0 if i % 2 else i % 5) for i in range(500)]
    rows += [(500 + i, rows[0][1], i % 2) for i in range(60)] + [(600 + i, (-centre).tolist(), 6) for i in range(4)]
    rows += [(700, [1.0] * 3, 1), (701, [1.0] * 3, 1), (702, [1.0] * 3, 2), (800, [0.0] * 12, 3), (100, rows[7][1], 9), (100, rows[8][1], 0)]
    bad = [None, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11]
    rows += [(900 + i, v, 1) for i, v in enumerate(bad)] + [(1000, rows[1][1], None), (None, rows[1][1], 0), (1100, [], 1), (1200, rows[2][1], 77)]
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("shard, tile", [(negatives.SHARD, negatives.TILE), (37, 3)])
def test_negatives_are_those_of_a_plain_search(table, shard, tile):
    """One cell, or a grid whose lists need two rounds of merging."""
    rows = as_rows(table)
    kept = {}
    for r in table.collect():
        if r.vec_id is None or r.label is None or r.embedding is None or None in r.embedding or not np.isfinite(r.embedding).all():
            continue
        row = (r.label, list(map(float, r.embedding)))
        kept[r.vec_id] = min(kept.get(r.vec_id, row), row)
    kept = {i: (label, np.floor(np.array(v) * 256).astype(np.int64)) for i, (label, v) in kept.items()}
    want = expected(kept, lambda i: i % 100 == 0)
    got = found(negatives.hard_negatives(rows, rows.where("id % 100 = 0"), shard=shard, tile=tile))
    assert got == want and len(want) > 20


def test_other_limits_and_sizes(table):
    rows = as_rows(table).where("id < 120")
    kept = {r.id: (r.label, np.array(r.v, np.int64)) for r in rows.collect()}
    for args in ((3, 2, 50, 90), (1, 7, 0, 130), (8, 1, -40, 33)):
        got = found(negatives.hard_negatives(rows, rows.where("id % 10 = 0"), *args, shard=50, tile=5))
        assert got == expected(kept, lambda i: i % 10 == 0, *args)


def test_large_products_stay_whole(spark):
    big = 2.0 ** 30
    rows = spark.createDataFrame([(0, 1, [big, 1.0]), (1, 1, [big, 3.0]), (2, 2, [big, 2.0]), (3, 2, [big, 4.0])], "id long, label long, v array<double>")
    got = found(negatives.hard_negatives(rows, rows.where("id = 0"), lower=0))
    assert got == {(0, 1, 1, 2, 2 ** 60 + 3, 2 ** 60 + 2)}


def test_nothing_to_find(spark, table):
    rows = as_rows(table)
    assert found(negatives.hard_negatives(rows.where("false"), rows.where("false"))) == set()
    assert found(negatives.hard_negatives(rows, rows.where("false"))) == set()
    assert found(negatives.hard_negatives(rows.where("label = 0"), rows.where("label = 0"))) == set()
    assert negatives.labelled(table.where("false")).count() == 0
