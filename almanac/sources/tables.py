"""The given tables and the station series derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators.impute import impute_linear
from almanac.operators.reshape import calendar_spine
from almanac.plans.lineage import cut
from almanac.plans.quantiles import series_quantiles

KEYS = ["station_code", "station"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean quantity shipped, by the supplier's nation."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        line.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("station_code"), F.to_date("l_shipdate").alias("date"))
        .agg(F.avg("l_quantity").alias("value"))
        .join(nation, F.col("station_code") == F.col("n_nationkey"))
        .select("station_code", F.col("n_name").alias("station"), "date", "value")
    )


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean order price by the customer's nation; exact sums in cents."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("station_code"), F.to_date("o_orderdate").alias("date"))
        .agg(
            (F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double")
             / (F.count(F.lit(1)) * F.lit(100.0))).alias("value")
        )
        .join(nation, F.col("station_code") == F.col("n_nationkey"))
        .select("station_code", F.col("n_name").alias("station"), "date", "value")
    )


def series_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series`` written once: one row per station and day, read by several branches.

    Without it every branch would scan and aggregate the line items again.
    """
    return cut(series(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series`` on its complete calendar, with positions."""
    return calendar_spine(series_table(spark, sf_dir))


def daily_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_spine(cut(sparse(spark, sf_dir)))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``daily`` with gaps filled linearly."""
    return impute_linear(daily(spark, sf_dir))


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per customer nation and day, zero on days without any."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    counts = (
        orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("station_code"), F.to_date("o_orderdate").alias("date"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .join(nation, F.col("station_code") == F.col("n_nationkey"))
        .select("station_code", F.col("n_name").alias("station"), "date", "value")
    )
    return calendar_spine(cut(counts)).fillna({"value": 0.0})


SENTINELS = ("*", "nan", "NaN", "")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series`` as the monthly-wide table: one row per station-month, text cells, marked gaps."""
    s = series(spark, sf_dir)
    cell = F.round("value", 2).cast("decimal(12,2)").cast("string")
    cells = [
        F.coalesce(F.max(F.when(F.day("date") == d, cell)), F.lit(SENTINELS[d % 4])).alias(f"Día{d:02d}")
        for d in range(1, 32)
    ]
    return s.groupBy(
        F.col("station_code").alias("Código"), F.col("station").alias("Estación"),
        F.year("date").alias("Año"), F.month("date").alias("Mes"),
    ).agg(*cells)


def thresholds(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Per-station percentile thresholds, the same for both variables."""
    q = series_quantiles(
        series(spark, sf_dir) if of is None else of, KEYS, {"p5": 0.05, "p10": 0.10, "p90": 0.90, "p95": 0.95}
    )
    return q.select(
        *KEYS,
        *[F.col(p).alias(f"{p}_{v}") for p in ("p5", "p10", "p90", "p95") for v in ("tmax", "tmin")],
    )
