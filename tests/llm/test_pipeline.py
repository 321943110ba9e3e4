"""Every stage of the pipeline on a small corpus with planted cases."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    return steps


def test_stages_keep_the_columns_and_take_from_what_is_left(runs):
    for before, after in zip(runs[:-2], runs[1:-1]):
        assert after.columns == runs[0].columns
        assert after.select("doc_id").subtract(before.select("doc_id")).isEmpty()


def test_near_copies_go(runs):
    from almanac.llm.icws import near_duplicates
    assert near_duplicates(runs[2]).where("not kept").isEmpty()
    assert 0 < runs[2].count() < runs[1].count()


def test_no_passage_is_left_twice(runs):
    from almanac.llm.windows import repeated_passages
    assert repeated_passages(runs[3]).where("not kept").count() <= 0.02 * runs[3].count()


def test_last_stage_decodes_what_it_encodes(runs):
    texts = {r.doc_id: r.text for r in runs[4].collect()}
    rows = runs[5].collect()
    assert len(rows) == len(texts) > 0
    assert all(r.text == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, gone string, label int"
    docs = spark.createDataFrame([(None, None, None, None, None, None, None, None), (1, "", "en", "a", 0, "", "", 1),
                                  (1, "some words of a text", None, None, 20, "", "", 1)], schema)
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= rows.count()


def test_a_rare_cell_does_not_empty_the_mix(spark):
    from pyspark.sql import functions as F

    from almanac.llm.mixing import mix_documents
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(i, words, ["en", "de"][i % 5 == 0], f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame([*rows, (1000, "one", None, None)], "doc_id long, text string, lang string, source string")
    kept = [mix_documents(d, budget=0.5).agg(F.sum(F.expr("mix_tokens * mix_probability")), F.sum("mix_tokens"), F.max("mix_probability")).first()
            for d in (docs, docs.where("doc_id < 1000"))]
    assert all(abs(k - n / 2) < 1e-6 * n and top <= 1 for k, n, top in kept)
    assert 200 < corpus_pipeline.mix_sources(spark, docs, SF).count() < 400
    de = mix_documents(docs.where("doc_id < 1000"), budget=0.5).where("lang = 'de'").agg(F.sum(F.expr("mix_tokens * mix_probability"))).first()[0]
    assert abs(de / 30_000 - 0.2 ** 0.7 / (0.2 ** 0.7 + 0.8 ** 0.7)) < 1e-3


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    text = lambda n=150: [f"w{x}" for x in rng.integers(0, 5000, n)]
    own = [text() for _ in range(5)]
    passage = text(60)
    join = " ".join
    rows = [(1, join(own[0])), (2, join(own[0])), (2, join(own[1])), (3, join(own[2])), (3, join(own[2])), (None, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(map(str, left)) == sorted(str(r) for r in docs.collect()[:1] + docs.collect()[2:4] + docs.collect()[5:])
    rows = [(1, join(own[0] + passage)), (2, join(own[1] + passage)), (2, join(["zz"] + own[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {(r.doc_id, r.text) for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert left == {rows[0], (2, join(own[1])), rows[2]}
