"""Per-series standardisation and its inverse, always joined by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.config import KEYS
from tidegauge.operators.order import join_groups


def fit_scaler(series: DataFrame, keys: list[str] = KEYS, value: str = "y") -> DataFrame:
    """Mean and population standard deviation; a zero deviation becomes 1."""
    std = F.stddev_pop(value)
    return series.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.when(std == 0, F.lit(1.0)).otherwise(std).alias("scale"),
    )


def fit_on_train(split_series: DataFrame, keys: list[str] = KEYS, value: str = "y") -> DataFrame:
    return fit_scaler(split_series.filter(F.col("split") == "train"), keys, value)


def scale(df: DataFrame, params: DataFrame, keys: list[str] = KEYS, value: str = "y") -> DataFrame:
    joined = join_groups(df, params, keys)
    return joined.withColumn(value, (F.col(value) - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def unscale(df: DataFrame, params: DataFrame, keys: list[str] = KEYS, value: str = "y") -> DataFrame:
    joined = join_groups(df, params, keys)
    return joined.withColumn(value, F.col(value) * F.col("scale") + F.col("mean")).drop("mean", "scale")


_PROCESSORS: dict[str, tuple[Callable, Callable, Callable]] = {}


def register_processor(name: str, fit: Callable, transform: Callable, inverse: Callable) -> None:
    if name in _PROCESSORS:
        raise ValueError(f"processor {name} is already registered")
    _PROCESSORS[name] = (fit, transform, inverse)


def processor(name: str) -> tuple[Callable, Callable, Callable]:
    return _PROCESSORS[name]


register_processor("standard_scaler", fit_scaler, scale, unscale)
