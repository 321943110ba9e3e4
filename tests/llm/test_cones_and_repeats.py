"""Vectors in a common cone against all pairs, and top lists where ids repeat against a plain ranking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import topk, vectors


@pytest.mark.parametrize("cosine", [0.0, 0.5, 0.8])
def test_links_are_found_in_a_cone(spark, cosine):
    """Pairs at 0.905 among vectors whose mean cosine is given; windows are small, so that passes decide."""
    rng = np.random.default_rng(3)
    n, dim, block = 4000, 48, 100
    centre = np.zeros(dim)
    centre[0] = 1.0

    def cone(m):
        side = rng.standard_normal((m, dim))
        side[:, 0] = 0
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        return np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * side
    v = cone(n)
    step = rng.standard_normal((150, dim))
    step -= (step * v[:150]).sum(1, keepdims=True) * v[:150]
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    v = np.concatenate([v, 0.905 * v[:150] + np.sqrt(1 - 0.905 ** 2) * step])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, block=block).collect()}
    assert all(got[i] <= linked[i].sum() for i in range(len(v)))
    assert sum(got.values()) >= 0.9 * linked.sum() > 0


def test_passes_grow_where_less_is_left():
    assert vectors.rest_cosine(0.9, 0.0) == pytest.approx(0.9)
    assert vectors.rest_cosine(0.9, 0.8) == pytest.approx(0.5)
    assert vectors.rest_cosine(0.9, 1.0) == 0.0
    assert vectors.passes_for(10 ** 5, 0.5) > vectors.passes_for(10 ** 5, 0.9)


@pytest.mark.parametrize("shard, tile", [(1 << 15, 1 << 12), (7, 2)])
def test_repeated_ids_take_part_as_rows(spark, shard, tile):
    rng = np.random.default_rng(1)
    rows = [(i % 90, rng.integers(-9, 9, 6).astype(float)) for i in range(140)] + [(100, np.ones(6)), (100, 2 * np.ones(6)), (100, np.ones(6))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "id long, v array<double>")
    got = topk.top_k(df, df.where("id % 10 = 0"), 4, shard, tile).collect()
    want = set()
    for q in {i for i, _ in rows if i % 10 == 0}:
        scores = sorted((-int(x @ y), c) for i, x in rows if i == q for c, y in rows if c != q)
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:4])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
