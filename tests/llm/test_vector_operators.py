"""Operators on vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, rep string"


@pytest.fixture(scope="module")
def table(spark):
    """Clusters, equal vectors, ties, another length, and every kind of unusable vector."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.18 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, [1.0] * 8), (500, [1.0] * 8), (600, [2.0] * 8)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(700 + i, v) for i, v in enumerate(bad)] + [(None, rows[1][1])]
    return spark.createDataFrame([(i, v, None, "x", "y", "z") for i, v in rows], SCHEMA)


def usable(rows):
    return [(r.vec_id, np.array(r.embedding, float)) for r in rows
            if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()]


def test_top_k_is_exact(spark, table):
    v = topk.finite(table, "vec_id", "embedding").select("id", F.transform("v", lambda x: F.floor(x * 1024).cast("double")).alias("v"))
    rows = usable(table.collect())
    want = []
    for q, x in rows:
        if q % 100 == 0:
            scores = [(-int(np.floor(x * 1024) @ np.floor(y * 1024)), c) for c, y in rows if c != q and len(x) == len(y)]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(sorted(scores)[:10])]
    for shard, tile in ((1 << 15, 1 << 12), (16, 2)):
        got = sorted(map(tuple, topk.top_k(v, v.where("id % 100 = 0"), 10, shard, tile).collect()))
        assert got == sorted(want)
    assert topk.top_k(v.where("false"), v.where("false")).count() == 0


def test_large_products_stay_whole():
    import pandas as pd
    big = pd.DataFrame({"id": [1, 2], "v": [np.array([2.0 ** 30, 1.0]), np.array([2.0 ** 30, 3.0])]})
    got = topk.tile_product(big, big, 5)
    assert got["score"].tolist() == [2 ** 60 + 3] * 2


@pytest.mark.parametrize("block, passes", [(2048, None), (32, 12)])
def test_near_vectors_link_as_all_pairs_do(table, block, passes):
    rows = usable(table.collect())
    rows = [(i, v) for i, v in rows if v.any()]
    ids = [i for i, _ in rows]
    links = {i: set() for i in ids}
    for a, x in rows:
        for b, y in rows:
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a].add(b)
    label = {i: i for i in ids}
    for _ in ids:
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in ids}
        if new == label:
            break
        label = new
    got = {r.vec_id: r for r in vectors.near_vectors(table, block=block, passes=passes).collect() if r.vec_id is not None}
    assert len(got) == table.count() - 1
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(700, 706))
    if block > 1000:
        assert {i: (len(links[i]), label[i]) for i in ids} == {i: (got[i].n_links, got[i].component_id) for i in ids}
    else:
        found = sum(got[i].n_links for i in ids)
        assert 0.9 * sum(map(len, links.values())) <= found <= sum(map(len, links.values()))
        assert all(got[i].n_links <= len(links[i]) for i in ids)
    assert vectors.near_vectors(table.where("false")).count() == 0


def test_passes_grow_with_the_table():
    assert vectors.passes_for(100, 0.9) == 1
    assert vectors.passes_for(10 ** 5, 0.9) < vectors.passes_for(10 ** 8, 0.9) < 200
