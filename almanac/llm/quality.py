"""Quality classifier: supervised subword embeddings with word pairs, as ``labels.quality`` marks texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm import embedding_bag as bag

SETTINGS = bag.Settings(bits=18, dim=8, grams=(3, 4, 5), pairs=True, rows=1500, epochs=6, rate=16.0, scale=1.0, adapt=False)


def classify(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, cut: float,
             settings: bag.Settings) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; see ``embedding_bag`` for the model.

    It learns from rows of ``labels`` whose document is not held out, and reads ``text`` only;
    repeated ids in ``labels`` count once, with the larger label. A null or empty text has the
    model's bias as its score. Rows with a null or repeated doc_id are scored like others; without
    labels of both classes all scores are equal. No documents give no rows.
    """
    model = fit(docs, labels, label, modulus, remainder, settings)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bag.score(plain, model, settings).select(
        "doc_id", bag.held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, settings: bag.Settings) -> bag.Model:
    """The model learned from the labelled documents that aren't held out."""
    marks = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, odds = bag.sample(plain.where(~bag.held_out(modulus, remainder)), marks, settings)
    return bag.train(rows.drop_duplicates("doc_id"), settings, odds)


def quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, settings: bag.Settings = SETTINGS) -> DataFrame:
    """Scores for label 1 of ``labels.quality``; ids whose crc32 is a multiple of five are held out."""
    return classify(docs, labels, "quality", 5, 0, cut, settings)
