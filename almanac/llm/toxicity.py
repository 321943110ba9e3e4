"""Toxicity: subword-bag embeddings averaged into a linear softmax, as ``labels.toxic`` marks texts.

A misspelling that was never seen shares most of its character n-gram vectors with the word it
stands for, so it is scored much like that word. Only features whose classes differ by more than
chance have vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from almanac.llm import embedding_bag as bag
from almanac.llm.quality import classify, fit

SETTINGS = bag.Settings(bits=20, dim=8, grams=(3, 4, 5), pairs=False, strip=True, min_texts=5, rows=2000, epochs=8,
                        rate=0.1, scale=100.0, prior=0.25, chance=3.0)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, settings: bag.Settings = SETTINGS) -> DataFrame:
    """doc_id, held_out, score, predicted; ids whose crc32 leaves 1 modulo three are held out.

    Null, empty and repeated rows are as in ``quality.classify``.
    """
    return classify(docs, labels, "toxic", 3, 1, cut, settings)


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.7, settings: bag.Settings = SETTINGS) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    return bag.below(docs, fit(docs, labels, "toxic", 3, 1, settings), settings, cut)
