"""The corpus pipeline: every stage is one operator of ``almanac.llm`` applied to all documents before it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.icws import near_duplicates
from almanac.llm.mixing import mix_documents
from almanac.llm.rows import one_row_per_text, small
from almanac.llm.sentencepiece import pieces
from almanac.llm.toxicity import without_toxic
from almanac.llm.windows import remove_repeats, repeated_passages
from almanac.plans.lineage import cut

ORACLE_SQL = None  # a trained classifier and min-hashes are beyond SQL; tests/llm compares with brute force

NUMBER = "__number"
KEPT = 0.5
"""Share of tokens that the mixing stage keeps."""


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; rows without a doc_id or text are scored like others."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; rows without an id stay.

    Rows that repeat an id with another text are texts of their own; of rows with one id and text one stays.
    """
    rows = one_row_per_text(docs, NUMBER)
    texts = rows.select(F.col(NUMBER).alias("doc_id"), "text")
    gone = small(near_duplicates(texts, 0.8).where("not kept").select(F.col("doc_id").alias("__gone")))
    return rows.join(gone, rows[NUMBER] == F.col("__gone"), "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut; documents left without a word go.

    Rows that repeat an id are cut by their own text, as in the stage before.
    """
    rows = one_row_per_text(docs, NUMBER).withColumn("__id", F.col("doc_id")).withColumn("doc_id", F.col(NUMBER)).drop(NUMBER)
    cleaned = remove_repeats(rows, repeated_passages(rows)).withColumn("doc_id", F.col("__id")).drop("__id")
    emptied = F.col("__was_cut") & ~F.coalesce(F.col("text").rlike(r"[^\s\p{Punct}]"), F.lit(False))
    return cleaned.where(~emptied).drop("__was_cut")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics have their target shares of tokens, half of all tokens in expectation."""
    return mix_documents(docs, budget=KEPT).where("mix_sampled").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    return pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
