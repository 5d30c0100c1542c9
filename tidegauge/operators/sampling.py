"""Reproducible samples and shuffles: the order is a digest of key and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.order import rank_within


def digest(cols: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def at_most(df: DataFrame, group: list[str], item: list[str], k: int, seed: int = 0) -> DataFrame:
    """At most ``k`` items of each group.

    The rank filter is pushed below the shuffle by Spark, so each task sends on
    at most ``k`` rows of a group.
    """
    w = Window.partitionBy(*group).orderBy(digest([*group, *item], seed), *item)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def shuffled_batches(
    df: DataFrame, item: list[str], batch_size: int, seed: int = 0, within: list[str] | None = None
) -> DataFrame:
    """Shuffled sample order and fixed-size batches, over the whole table or ``within`` groups."""
    keyed = df.withColumn("_d", digest(item, seed))
    ranked = rank_within(keyed, within or [], ["_d", *item], "shuffle_pos")
    return ranked.withColumn("batch_id", F.expr(f"shuffle_pos div {batch_size}")).drop("_d")
