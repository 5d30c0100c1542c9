"""Chronological splits: every row goes to the one to three splits it belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.config import KEYS
from tidegauge.operators.order import join_groups

Bounds = dict[str, tuple[Column, Column]]


def part(n: Column, ratio: Column | float) -> Column:
    """Truncated share of a length, in double arithmetic."""
    return (n.cast("double") * ratio).cast("bigint")


def lengths(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def split_by(
    series: DataFrame, bounds: Bounds, keys: list[str] = KEYS, guard: Column | None = None,
    lens: DataFrame | None = None,
) -> DataFrame:
    """Assign rows to ``[lo, hi)`` ranges of ``idx`` written in terms of ``n``.

    ``idx`` is renumbered inside each split; ``src_idx`` keeps the old position.
    """
    lens = lengths(series, keys) if lens is None else lens
    edges = lens if guard is None else lens.filter(guard)
    edges = edges.select(*keys, _edges(bounds).alias("_edges"))
    return _cut(join_groups(series, edges, keys), series.columns, keys)


def _edges(bounds: Bounds) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("split"),
                F.greatest(lo.cast("bigint"), F.lit(0)).alias("lo"),
                hi.cast("bigint").alias("hi"),
            )
            for name, (lo, hi) in bounds.items()
        ]
    )


def _cut(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row per split whose range in ``_edges`` holds ``idx``."""
    hit = F.filter("_edges", lambda e: (F.col("idx") >= e["lo"]) & (F.col("idx") < e["hi"]))
    rest = [c for c in columns if c not in (*keys, "idx")]
    return rows.withColumn("_e", F.explode(hit)).select(
        *keys,
        F.col("_e.split").alias("split"),
        (F.col("idx") - F.col("_e.lo")).alias("idx"),
        F.col("idx").alias("src_idx"),
        *rest,
    )


def lookback_bounds(seq_len: int, train: Column | float, val: Column | float) -> Bounds:
    n = F.col("n")
    nt, nv = part(n, train), part(n, val)
    return {
        "train": (F.lit(0), nt),
        "val": (nt - seq_len, nt + nv),
        "test": (nt + nv - seq_len, n),
    }


def split_lookback(
    series: DataFrame, seq_len: int, pred_len: int, train: float = 0.7, val: float = 0.1,
    rules: DataFrame | None = None, keys: list[str] = KEYS,
) -> DataFrame:
    """Train, val and test; val and test start ``seq_len`` early.

    A series whose train part is shorter than ``seq_len + pred_len`` is left out.
    ``rules`` (dataset, train_ratio, val_ratio, row_cap) overrides the ratios.
    """
    t, v = F.lit(train), F.lit(val)
    lens = lengths(series, keys)
    if rules is not None:
        lens = lens.join(rules.select("dataset", "train_ratio", "val_ratio"), "dataset", "left")
        t, v = F.coalesce("train_ratio", t), F.coalesce("val_ratio", v)
    guard = part(F.col("n"), t) >= seq_len + pred_len
    return split_by(series, lookback_bounds(seq_len, t, v), keys, guard, lens)


def split_plain(
    series: DataFrame, train: float = 0.7, val: float = 0.1, rules: DataFrame | None = None,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Three consecutive parts without look-back."""
    t, v = F.lit(train), F.lit(val)
    lens = lengths(series, keys)
    if rules is not None:
        lens = lens.join(rules.select("dataset", "train_ratio", "val_ratio"), "dataset", "left")
        t, v = F.coalesce("train_ratio", t), F.coalesce("val_ratio", v)
    n = F.col("n")
    a = part(n, t)
    b = a + part(n, v)
    return split_by(series, {"train": (F.lit(0), a), "val": (a, b), "test": (b, n)}, keys, None, lens)


def few_shot(end: Column, seq_len: int, percent: int) -> Column:
    """Shorten the train end to a percentage of its samples, by floor division."""
    return F.floor((end - seq_len) * percent / F.lit(100)) + seq_len


def split_borders(
    series: DataFrame, seq_len: int, percent: int = 100, keys: list[str] = KEYS
) -> DataFrame:
    """0.7 train and 0.2 test; val is what remains between them."""
    n = F.col("n")
    nt, nte = part(n, 0.7), part(n, 0.2)
    return split_by(
        series,
        {
            "train": (F.lit(0), few_shot(nt, seq_len, percent)),
            "val": (nt - seq_len, n - nte),
            "test": (n - nte - seq_len, n),
        },
        keys,
    )


def split_calendar(
    series: DataFrame, seq_len: int, steps_per_hour: int = 1, percent: int = 100,
    keys: list[str] = KEYS, month: int | None = None,
) -> DataFrame:
    """12, 4 and 4 months of 30 days; ``month`` overrides the points in one month.

    The bounds are constants, so rows are cut where they lie: no length is read and nothing is joined.
    """
    m = month or 30 * 24 * steps_per_hour
    a, b, c = 12 * m, 16 * m, 20 * m
    bounds = {
        "train": (F.lit(0), few_shot(F.lit(a), seq_len, percent)),
        "val": (F.lit(a - seq_len), F.lit(b)),
        "test": (F.lit(b - seq_len), F.lit(c)),
    }
    return _cut(series.withColumn("_edges", _edges(bounds)), series.columns, keys)


def prediction_tail(series: DataFrame, seq_len: int, keys: list[str] = KEYS) -> DataFrame:
    """Last ``seq_len`` rows of each series, renumbered."""
    n = F.col("n")
    return split_by(series, {"pred": (n - seq_len, n)}, keys)


def dataset_rules(spark) -> DataFrame:
    """Ratios and row caps of the public benchmark datasets."""
    # The benchmark protocol of the four transformer-temperature sets.
    rows = [
        ("ETTh1", 0.6, 0.2, 14400),
        ("ETTh2", 0.6, 0.2, 14400),
        ("ETTm1", 0.6, 0.2, 57600),
        ("ETTm2", 0.6, 0.2, 57600),
    ]
    return spark.createDataFrame(
        rows, "dataset string, train_ratio double, val_ratio double, row_cap bigint"
    )


def truncate_rows(series: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep the first ``row_cap`` points of datasets that have a cap."""
    caps = rules.select("dataset", "row_cap")
    return (
        series.join(caps, "dataset", "left")
        .filter(F.col("row_cap").isNull() | (F.col("idx") < F.col("row_cap")))
        .drop("row_cap")
    )
