"""Shared scratch space and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` or by ``setCheckpointDir``.

    Where neither is set, a local run gets a folder of its own; on a cluster that is an error,
    since executors would each write to their own disk.
    """
    context = spark.sparkContext
    named = (spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
             or context.getCheckpointDir())
    if not named:
        if not (context.master or "").startswith("local[") and context.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="almanac-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/almanac/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH = 4 << 20
"""Bytes of an Arrow batch where rows hold whole texts: by their number alone a batch would be as large as its texts are long."""


def cut(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Write an intermediate that several branches read, and continue from the written table.

    Nothing reads the write's shuffles again, so Spark is told to remove their files when it ends.
    ``batch_bytes`` bounds the Arrow batches that the write hands to Python.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    settings = {CLEANUP: "true"} | ({BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    return spark.read.schema(df.schema).parquet(path)
