"""One text per document id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.plans.lineage import cut


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of rows with an id; an id that comes more than once has its smallest text (nulls last).

    Only ids are shuffled to find repeats, and only the repeats' texts to settle them.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    again = cut(plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return plain
    settled = plain.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return plain.join(again, "doc_id", "left_anti").unionAll(settled)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table with few narrow rows, marked for broadcast if it has at most ``rows``; as it is if it has more."""
    table = cut(df)
    return F.broadcast(table) if table.count() <= rows else table


def one_row_per_text(docs: DataFrame, number: str) -> DataFrame:
    """``docs`` with a ``number`` for every doc_id and text, in the order of doc_id, and one of the rows that share both.

    Where no id comes twice the number is the doc_id. Rows without an id all stay, without a number.
    """
    numbered = docs.withColumn(number, F.col("doc_id").cast("long"))
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return numbered
    from almanac.llm.vectors import ranked
    text_print = F.coalesce(F.sha2("text", 256), F.lit(""))
    marked = docs.withColumn("__print", text_print)
    several = (marked.join(again, "doc_id", "left_semi").groupBy("doc_id", "__print")
               .agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*", "__print"))
    every = cut(marked.where("doc_id is not null").join(again, "doc_id", "left_anti").unionByName(several))
    ranks = ranked(every.select("doc_id", "__print"), "doc_id", "__print").select(
        F.col("doc_id").alias("__id"), F.col("__print").alias("__of"), F.col("rank").alias(number))
    out = every.join(ranks, (F.col("doc_id") == F.col("__id")) & (F.col("__print") == F.col("__of"))).select(*docs.columns, number)
    return out.unionByName(numbered.where("doc_id is null"))
