"""Series made from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.config import KEYS
from tidegauge.operators.order import rank_within


def to_series(df: DataFrame, dataset: str, series_id, order: list[str], value) -> DataFrame:
    """Long series table from any event table; ``order`` names a total order, time first."""
    base = df.select(
        F.lit(dataset).alias("dataset"),
        series_id.cast("string").alias("series_id"),
        F.col(order[0]).alias("ts"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order[1:])],
        value.cast("double").alias("y"),
    )
    ties = [f"_o{i}" for i in range(len(order) - 1)]
    return rank_within(base, KEYS, ["ts", *ties], "idx").select("dataset", "series_id", "idx", "ts", "y")


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return to_series(ev, "events", F.col("user_id"), ["ts", "event_id"], F.col("value"))


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return to_series(
        li, "lineitem", F.col("l_suppkey"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"],
        F.col("l_extendedprice"),
    )


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order value per priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    daily = o.groupBy("o_orderpriority", "o_orderdate").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    return to_series(daily, "orders", F.col("o_orderpriority"), ["o_orderdate"], F.col("total"))


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a short signal, its elements in order."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        F.lit("embeddings").alias("dataset"),
        F.col("vec_id").cast("string").alias("series_id"),
        F.posexplode("embedding").alias("idx", "y"),
    ).select(
        "dataset", "series_id", F.col("idx").cast("bigint").alias("idx"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("y").cast("double").alias("y"),
    )
