"""Lookups by key, time-grid interpolation and elastic distances of given pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidegauge.config import KEYS, MAX_GROUP_ROWS, bound
from tidegauge.functions.names import clean_name
from tidegauge.functions.types import once
from tidegauge.operators.order import gather, join_groups, profile, rank_within, with_neighbours


def prompt_lookup(
    rows: DataFrame, prompts: DataFrame, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Attach the vector of (split, dataset, cleaned series name).

    Returns the matched rows and the keys without a prompt; ``strict`` raises
    when there are any. Prompts whose cleaned names meet raise when they are read.
    """
    on = ["split", "dataset", "_name"]
    left = rows.withColumn("_name", clean_name(F.col("series_id")))
    right = prompts.select(
        "split", "dataset", clean_name(F.col("series_id")).alias("_name"), F.col("features").alias("prompt")
    )
    twice = F.raise_error(F.concat_ws(" ", F.lit("several prompts have the cleaned name"), "dataset", "_name"))
    right = right.groupBy(*on).agg(F.first("prompt").alias("_p"), F.count(F.lit(1)).alias("_c")).select(
        *on, F.when(F.col("_c") > 1, twice.cast("array<double>")).otherwise(F.col("_p")).alias("prompt"))
    missing = left.select(*on, "series_id").distinct().join(right, on, "left_anti").drop("_name")
    if strict:
        first = missing.limit(1).collect()
        if first:
            raise ValueError(f"no prompt for {first[0].asDict()}")
    return left.join(right, on).drop("_name"), missing


def ordinal_lookup(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """Attach the vector of series ``T{ordinal + 1}`` of a dataset."""
    right = prompts.select(
        "dataset", F.expr("cast(substr(series_id, 2) as bigint) - 1").alias("ordinal"),
        F.col("features").alias("prompt"),
    )
    return rows.join(right, ["dataset", "ordinal"], "left")


def dataset_index(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Integer class of the dataset name, from the dataset dimension; an unknown dataset raises."""
    unknown = F.raise_error(F.concat(F.lit("unknown dataset "), "dataset")).cast("int")
    found = rows.join(dim.select("dataset", F.col("ds_index").cast("int").alias("ds_index")), "dataset", "left")
    return found.withColumn("ds_index", F.coalesce("ds_index", unknown))


# Grid points made from one block of a gap.
_SPAN = 4096


def merge_sensors(sensors: DataFrame, fs: float, unit: float = 1e9, by: str = "folder") -> DataFrame:
    """Interpolate every axis of a recording on one even time grid.

    The grid spans the time all sensors share.  Each sample yields the grid
    points between itself and the next sample, so no grid-to-sample join is
    made.  The result is a series table: ``dataset`` is the recording,
    ``series_id`` the sensor name with the axis number.
    """
    keys = [by, "sensor", "axis"]
    spans = sensors.groupBy(by, "sensor").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = spans.groupBy(by).agg(F.max("a").alias("t0"), F.min("b").alias("tn"))
    grid = grid.withColumn(
        "_m", F.floor((F.col("tn") - F.col("t0")) / ((1 / fs) * unit)).cast("bigint")
    ).filter(F.col("_m") > 0)
    grid = grid.withColumn(
        "_step", F.when(F.col("_m") > 1, (F.col("tn") - F.col("t0")) / (F.col("_m") - 1)).otherwise(F.lit(1.0))
    )
    prof = profile(sensors, keys)
    ranked = rank_within(sensors, keys, ["t", *(c for c in ("place",) if c in sensors.columns), "v"], "_r", prof)
    lines = with_neighbours(
        ranked, keys, "_r", 1,
        lambda w: {"_t": F.lead("t").over(w), "_v": F.lead("v").over(w)}, prof,
    )
    lines = join_groups(lines, grid, [by], profile(sensors, [by]), "_r")
    place = lambda c: (F.col(c) - F.col("t0")) / F.col("_step")
    top = F.col("_m") - 1
    low = F.greatest(F.floor(place("t")) - 1, F.lit(0).cast("bigint"))
    high = F.least(F.ceil(F.coalesce(place("_t"), place("t"))) + 1, top)
    # Two steps, so that a long gap between samples makes no long array.
    a, z = F.expr(f"_lo div {_SPAN}"), F.expr(f"_hi div {_SPAN}")
    blocks = lines.withColumns({"_lo": low, "_hi": high}).filter("_lo <= _hi")
    blocks = blocks.withColumn("_b", F.explode(F.sequence(a, z)))
    first, last = F.greatest("_lo", F.col("_b") * _SPAN), F.least("_hi", F.col("_b") * _SPAN + _SPAN - 1)
    pts = blocks.withColumn("idx", F.explode(F.sequence(first, last)))
    x = F.when((F.col("idx") == top) & (F.col("_m") > 1), F.col("tn")).otherwise(
        F.col("t0") + F.col("idx") * F.col("_step")
    )
    pts = pts.withColumn("_x", x)
    inside = (F.col("_x") >= F.col("t")) & F.coalesce(F.col("_x") < F.col("_t"), F.col("_x") <= F.col("t"))
    y = F.coalesce(
        F.col("v") + (F.col("_v") - F.col("v")) * F.try_divide(F.col("_x") - F.col("t"), F.col("_t") - F.col("t")),
        F.col("v"),
    )
    return pts.filter(inside).select(
        F.col(by).alias("dataset"), F.concat("sensor", F.col("axis").cast("string")).alias("series_id"),
        "idx", F.col("_x").alias("t"), y.alias("y"),
    )


def _warp(a: np.ndarray, b: np.ndarray) -> float:
    """Least total distance over all monotone alignments, one diagonal at a time."""
    n, m = len(a), len(b)
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    last[0] = 0.0
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        i = np.arange(lo, hi + 1)
        now = np.full(n + 1, np.inf)
        best = np.minimum(np.minimum(before[i], before[i - 1]), last[i - 1])
        now[i] = np.abs(a[i - 1] - b[d - i - 1]) + best
        last, before = before, now
    return float(before[n])


@F.pandas_udf(DoubleType())
def _dtw(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([
        _warp(np.asarray(a, dtype=float), np.asarray(b, dtype=float)) for a, b in zip(left, right)
    ])


_dtw = once(_dtw)


def dtw_distance(series: DataFrame, pairs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Exact dynamic-time-warping distance of the given pairs of short series.

    ``pairs`` holds ``left_<key>`` and ``right_<key>`` columns.  A series longer
    than the group bound raises: compare its windows instead.
    """
    limit = bound(series.sparkSession, MAX_GROUP_ROWS)
    longest = profile(series, keys).longest
    if longest > limit:
        raise ValueError(f"series of {longest} points; compare windows of at most {limit}")
    packed = gather(series, keys, "idx", "y")
    for side in ("left", "right"):
        named = packed.toDF(*[f"{side}_{k}" for k in keys], f"_{side}")
        pairs = pairs.join(named, [f"{side}_{k}" for k in keys])
    return pairs.withColumn("distance", _dtw("_left", "_right")).drop("_left", "_right")
