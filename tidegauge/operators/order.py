"""Positions, neighbours, running sums and order statistics inside groups.

One series may hold a third of all rows, so nothing here gathers a group whose
size is unknown.  ``profile`` measures the groups once; groups within the bound
use Spark's own windows, longer ones a range-partitioned plan in which a group
is spread over as many tasks as its size asks for.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.config import CHUNK_ROWS, MAX_GROUP_ROWS, bound
from tidegauge.session import cut_lineage


@dataclass(frozen=True)
class GroupProfile:
    rows: int
    longest: int
    missing: int | None = None  # points without value, where they were counted


def profile(df: DataFrame, keys: list[str]) -> GroupProfile:
    """Row count and longest group; two numbers reach the driver."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("longest")).first()
    return GroupProfile(total["rows"] or 0, total["longest"] or 0)


def fits(df: DataFrame, prof: GroupProfile) -> bool:
    return prof.longest <= bound(df.sparkSession, MAX_GROUP_ROWS)


def rank_within(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str = "idx",
    prof: GroupProfile | None = None,
) -> DataFrame:
    """Dense zero-based position of each row in its group; ``order`` must be total."""
    prof = prof or profile(df, keys)
    if keys and fits(df, prof):
        return _rank_by_window(df, keys, order, out)
    if not keys:
        return _rank_by_range(df, keys, order, out, prof)
    # Only the long groups, a row each in a table of checked size, go through the range shuffle.
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound(df.sparkSession, MAX_GROUP_ROWS))
    found = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rows"), F.max("_n").alias("longest")).first()
    if found["groups"] > MOST_LONG or found["rows"] == prof.rows:
        return _rank_by_range(df, keys, order, out, prof)
    names = F.broadcast(sizes.select(*keys))
    short = _rank_by_window(df.join(names, keys, "left_anti"), keys, order, out)
    if found["groups"]:
        long = _rank_by_range(df.join(names, keys, "left_semi"), keys, order, out, GroupProfile(found["rows"], found["longest"]))
        short = short.unionByName(long)
    return short.select(*df.columns, out)


MOST_LONG = 100_000  # long groups whose names are broadcast
MOST_RANGES = 20_000


def _rank_by_window(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))


def _rank_by_range(df, keys, order, out, prof) -> DataFrame:
    """Positions from one range shuffle: a partition is a run of the total order.

    ``monotonically_increasing_id`` counts rows inside a partition; the rows of a
    group in earlier partitions come from a table of one row per (group,
    partition).  The sorted rows are checkpointed first, because the partition
    bounds are sampled and must not change between the two uses.
    """
    spark = df.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        min(MOST_RANGES, math.ceil(prof.rows / bound(spark, MAX_GROUP_ROWS))),
    )
    by = [*keys, *order]
    placed = cut_lineage(
        df.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_pid", F.shiftright("_mid", 33))
    runs = placed.groupBy(*keys, "_pid").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *keys, "_pid", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    joined = placed.join(runs, [*keys, "_pid"])
    return joined.withColumn(out, F.col("_before") + F.col("_mid") - F.col("_first")).drop(
        "_mid", "_pid", "_first", "_before"
    )


def join_groups(
    rows: DataFrame, table: DataFrame, keys: list[str], prof: GroupProfile | None = None, pos: str = "idx"
) -> DataFrame:
    """Join rows with a table of one row per group.

    Where a group is longer than the bound, blocks of ``pos`` become part of the
    join key and the table's row is repeated once per block, so that a hot group
    is neither joined nor handed on in one task.
    """
    prof = prof or profile(rows, keys)
    if fits(rows, prof):
        return rows.join(table, keys)
    size = bound(rows.sparkSession, MAX_GROUP_ROWS)
    tops = rows.groupBy(*keys).agg(F.max(pos).alias("_top"))
    spread = table.join(tops, keys).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"_top div {size}")))
    )
    blocks = rows.withColumn("_block", F.expr(f"`{pos}` div {size}"))
    return blocks.join(spread.drop("_top"), [*keys, "_block"]).drop("_block")


def _chunk_size(df: DataFrame, halo: int) -> int:
    return max(bound(df.sparkSession, CHUNK_ROWS), 2 * halo + 1)


def whole_window(df: DataFrame, halo: int, prof: GroupProfile) -> bool:
    """Whether ``with_neighbours`` leaves groups uncut; then ``pos`` may have holes."""
    return prof.longest <= _chunk_size(df, halo)


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    pos: str,
    halo: int,
    build: Callable[[Window], dict[str, Column]],
    prof: GroupProfile,
) -> DataFrame:
    """Add columns that look at most ``halo`` positions away.

    Short groups use one window per group.  Otherwise ``pos`` must be dense: a
    group is cut into chunks and the rows near a cut are copied to the chunk on
    its other side.
    """
    size = _chunk_size(df, halo)
    if whole_window(df, halo, prof):
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(pos)))
    chunk = F.expr(f"`{pos}` div {size}")
    off = F.col(pos) % size
    spread = df.withColumn("_own", chunk).withColumn(
        "_chunk",
        F.explode(
            F.array_compact(
                F.array(
                    F.col("_own"),
                    F.when((off < halo) & (F.col("_own") > 0), F.col("_own") - 1),
                    F.when(off >= size - halo, F.col("_own") + 1),
                )
            )
        ),
    )
    spread = spread.repartition(*keys, "_chunk")
    out = spread.withColumns(build(Window.partitionBy(*keys, "_chunk").orderBy(pos)))
    return out.filter(F.col("_own") == F.col("_chunk")).drop("_own", "_chunk")


def running_sum(
    df: DataFrame, keys: list[str], pos: str, sums: dict[str, Column], prof: GroupProfile
) -> DataFrame:
    """Inclusive running sums along the dense position ``pos``."""
    if fits(df, prof):
        w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({k: F.sum(c).over(w) for k, c in sums.items()})
    size = bound(df.sparkSession, CHUNK_ROWS)
    cut = df.withColumn("_chunk", F.expr(f"`{pos}` div {size}"))
    heads = cut.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_h_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_h_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums],
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.repartition(*keys, "_chunk").withColumns({k: F.sum(c).over(inside) for k, c in sums.items()})
    out = out.join(heads, [*keys, "_chunk"])
    return out.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop(
        "_chunk", *[f"_b_{k}" for k in sums]
    )


def with_totals(
    df: DataFrame, keys: list[str], totals: dict[str, Column], prof: GroupProfile, pos: str = "idx"
) -> DataFrame:
    """Attach group aggregates to every row of the group."""
    if fits(df, prof):
        w = Window.partitionBy(*keys)
        return df.withColumns({k: c.over(w) for k, c in totals.items()})
    agg = df.groupBy(*keys).agg(*[c.alias(k) for k, c in totals.items()])
    return join_groups(df, agg, keys, prof, pos)


def ordered_values(
    df: DataFrame,
    keys: list[str],
    value: str,
    tie: str,
    ranks: dict[str, Column],
    sizes: DataFrame,
    prof: GroupProfile,
) -> DataFrame:
    """Values at given zero-based ranks for groups too long to gather.

    ``ranks`` maps an output name to a rank written in terms of ``n``, the group
    size held by ``sizes``; rows are sorted once by range.
    """
    rows = df.select(*keys, value, tie).filter(F.col(value).isNotNull())
    ranked = rank_within(rows, keys, [value, tie], "_rank", prof)
    wanted = join_groups(ranked, sizes.select(*keys, "n"), keys, prof, "_rank")
    return wanted.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_rank") == r, F.col(value))).alias(k) for k, r in ranks.items()]
    )


def gather(df: DataFrame, keys: list[str], pos: str, value: str, out: str = "x") -> DataFrame:
    """One array per group in ``pos`` order; callers make sure groups are bounded."""
    packed = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("_s")
    )
    return packed.select(*keys, F.col("_s.v").alias(out))
