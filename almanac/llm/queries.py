"""The operators of this subpackage as named queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.icws import near_duplicates
from almanac.llm.langid import language
from almanac.llm.mixing import mix_documents
from almanac.llm.mixing import sql as mixing_sql
from almanac.llm.negatives import hard_negatives, labelled
from almanac.llm.quality import quality
from almanac.llm.sentencepiece import pieces
from almanac.llm.simple8b import token_files
from almanac.llm.topk import finite, top_k
from almanac.llm.spelling import sql as spelling_sql
from almanac.llm.spelling import variants_in
from almanac.llm.toxicity import toxicity
from almanac.llm.vectors import near_vectors
from almanac.llm.warc import read_records, write_bundles
from almanac.llm.warc import sql as warc_sql
from almanac.llm.windows import repeated_passages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_minhash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), 0.8)


@query("op2_source_mixing", mixing_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_read(spark, sf_dir, "documents")).select(
        "doc_id", F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("probability"),
        F.col("mix_sampled").alias("sampled"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents"))


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


@query("op8_exact_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = finite(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(
        "id", F.transform("v", lambda x: F.floor(x * 1024).cast("double")).alias("v"))
    return top_k(v, v.where("id % 100 = 0"), 10)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(_read(spark, sf_dir, "documents"))


@query("op10_embedding_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


@query("op11_spelling_variants", spelling_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants_in(_read(spark, sf_dir, "documents"))


@query("op12_warc_bundles", warc_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_bundles(_read(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_hard_negatives", """
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v,
         row_number() OVER (PARTITION BY vec_id ORDER BY label, CAST(embedding AS DOUBLE[])) AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), one AS (SELECT * FROM clean WHERE r = 1), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM one a JOIN one c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same) WHERE r <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS r
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE r <= 5
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").select(
        "id", F.expr("CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"),
        F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))
    return hard_negatives(rows, rows.where("id % 100 = 0"), positives=5, negatives=5, lower=80, upper=100)
