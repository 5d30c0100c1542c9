"""Sample windows, signal windows and patches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import KEYS, WINDOW_CHUNK, bound
from tidegauge.operators.order import join_groups, profile, rank_within, running_sum
from tidegauge.operators.splits import lengths


def sample_windows(
    series: DataFrame, seq_len: int, pred_len: int, stride: int = 1,
    keys: list[str] = KEYS, value: str = "y", marks: list[str] | None = None,
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Every ``stride``-th (input, label) pair of each series.

    Offsets are cut into chunks; a chunk is gathered with the ``seq_len +
    pred_len - 1`` points that follow it, so rows stay bounded however long the
    series is, and each window is made in exactly one chunk.  ``marks`` names
    further columns gathered beside the values as ``x_mark`` and ``y_mark``.
    ``attach`` may join further columns by key; it sees one row per chunk, so its
    join does not move the far larger windows.
    """
    span = seq_len + pred_len
    size = max(bound(series.sparkSession, WINDOW_CHUNK), span)
    own = F.expr(f"idx div {size}")
    placed = series.withColumn(
        "_chunk",
        F.explode(
            F.array_compact(
                F.array(own, F.when((F.col("idx") % size < span - 1) & (own > 0), own - 1))
            )
        ),
    )
    fields = [F.col("idx").alias("p"), F.col(value).alias("v")]
    if marks:
        fields.append(F.array(*[F.col(m).cast("double") for m in marks]).alias("m"))
    packed = (
        placed.groupBy(*keys, "_chunk")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_s"))
        .filter(F.size("_s") >= span)
    )
    if attach:
        packed = attach(packed)
    carried = [c for c in packed.columns if c not in (*keys, "_chunk", "_s")]
    base = F.col("_chunk") * size
    first = F.pmod(-base, F.lit(stride).cast("bigint"))
    last = F.least(F.size("_s") - span, F.lit(size - 1)).cast("bigint")
    arrays = [F.col("_s.v").alias("_v")] + ([F.col("_s.m").alias("_m")] if marks else [])
    offs = (
        packed.select(*keys, *carried, base.alias("_base"), first.alias("_first"), last.alias("_last"), *arrays)
        .filter(F.col("_first") <= F.col("_last"))
        .withColumn("_o", F.explode(F.expr(f"sequence(_first, _last, {stride}L)")))
    )
    begin = F.col("_o").cast("int") + 1
    out = [
        *keys,
        (F.col("_base") + F.col("_o")).alias("off"),
        F.slice("_v", begin, seq_len).alias("x"),
        F.slice("_v", begin + seq_len, pred_len).alias("y"),
        *carried,
    ]
    if marks:
        out += [
            F.slice("_m", begin, seq_len).alias("x_mark"),
            F.slice("_m", begin + seq_len, pred_len).alias("y_mark"),
        ]
    return offs.select(*out)


def require_length(series: DataFrame, points: int, keys: list[str] = KEYS) -> DataFrame:
    """Raise when any series is shorter than ``points``; one offending key is fetched."""
    short = lengths(series, keys).filter(F.col("n") < points).limit(1).collect()
    if short:
        raise ValueError(f"series shorter than {points} points: {short[0].asDict()}")
    return series


def append_series(base: DataFrame, extra: DataFrame, points: int, keys: list[str] = KEYS) -> DataFrame:
    """Add further series to a dataset; each must hold at least one sample."""
    return base.unionByName(require_length(extra, points, keys))


def with_prefix(windows: DataFrame, prefix: Column | str) -> DataFrame:
    """Put a prompt in front of each input."""
    col = F.col(prefix) if isinstance(prefix, str) else prefix
    return windows.withColumn("x", F.concat(col, F.col("x")))


def global_sample_ids(windows: DataFrame, stride: int = 1, keys: list[str] = KEYS) -> DataFrame:
    """Number all samples in (key, offset) order through cumulative sample counts.

    Only the table of one row per series is ranked; windows are joined to it.
    """
    per = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    prof = profile(per, [])
    ranked = rank_within(per, [], keys, "_r", prof).withColumn("_all", F.lit(0))
    sums = running_sum(ranked, ["_all"], "_r", {"_upto": F.col("_n")}, prof)
    starts = sums.select(*keys, (F.col("_upto") - F.col("_n")).alias("_start"))
    return (
        windows.join(starts, keys)
        .withColumn("sample_id", F.col("_start") + F.expr(f"off div {stride}"))
        .drop("_start")
    )


def signal_windows(
    series: DataFrame, window: int, overlap: float = 0.0, keys: list[str] = KEYS
) -> DataFrame:
    """Complete windows over each series; ``idx`` restarts in every window."""
    if not isinstance(window, int) or isinstance(window, bool):
        raise ValueError("window must be an integer")
    step = window if overlap == 0 else int(round(window * (1 - overlap)))
    if step == 0:
        raise ValueError("overlap is too high for this window")
    rest = [c for c in series.columns if c not in (*keys, "idx")]
    idx = F.col("idx")
    low = F.greatest(F.ceil((idx - window + 1) / F.lit(step)), F.lit(0).cast("bigint"))
    high = F.expr(f"idx div {step}")
    reached = low <= high
    ids = F.explode(F.when(reached, F.sequence(low, F.greatest(low, high))))
    placed = join_groups(series, lengths(series, keys), keys).withColumn("win_id", ids)
    start = F.col("win_id") * step
    return placed.filter(start + window <= F.col("n")).select(
        *keys, "win_id", (idx - start).alias("idx"), *rest
    )


def patches(x: Column, size: int = 16, stride: int = 8) -> Column:
    """Patches over an array whose last value is repeated ``stride`` times."""
    padded = F.concat(x, F.array_repeat(F.element_at(x, -1), stride))
    count = F.floor((F.size(x) + stride - size) / F.lit(stride)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count), lambda i: F.slice(padded, i * stride + 1, size)
    )


def collate(windows: DataFrame) -> DataFrame:
    """Inputs and labels as single-precision arrays."""
    return windows.withColumns(
        {"x": F.col("x").cast("array<float>"), "y": F.col("y").cast("array<float>")}
    )
