"""What a Python worker holds: batches of bounded bytes, and nothing of a batch's work after it."""

import pyarrow as pa
from pyspark.sql import functions as F

from almanac.llm import hashing, windows
from almanac.plans import lineage


def test_a_cut_bounds_batches_by_their_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    rows = spark.range(0, 6000, 1, 1).select("id", F.repeat(F.lit("x"), 3000).alias("text"))
    was = spark.conf.get(lineage.BATCH)
    seen = lineage.cut(rows.mapInArrow(sizes, "n long, bytes long"), lineage.TEXT_BATCH).collect()
    assert sum(r.n for r in seen) == 6000
    assert max(r.bytes for r in seen) <= 1.1 * lineage.TEXT_BATCH
    assert spark.conf.get(lineage.BATCH) == was


def test_slices_give_freed_memory_back(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(hashing.pa, "default_memory_pool", Pool)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c", None, "d" * 50])], ["text"])
    assert [p.num_rows for p in hashing.slices(batch, limit=20)] == [2, 1]
    assert len(calls) == 1


def test_long_texts_are_cut_in_every_part_of_a_batch(spark):
    rows = [(i, f"w{i} " * 60 + "x" * 300_000) for i in range(8)] + [(8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spans = spark.createDataFrame([(3, 0, 50, 0, False), (7, 10, 60, 0, False), (0, 0, 50, 0, True)],
                                  "doc_id long, start_word long, end_word long, first_doc long, kept boolean")
    found = {r.doc_id: r for r in windows.remove_repeats(docs, spans).collect()}
    assert {i: r.text for i, r in found.items() if i not in (3, 7)} == {i: t for i, t in rows if i not in (3, 7)}
    for i in (3, 7):
        assert found[i]["__was_cut"] and found[i].text.split() == [f"w{i}"] * 10 + ["x" * 300_000]
