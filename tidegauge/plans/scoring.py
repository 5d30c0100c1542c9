"""Batch forecasting with a caller's model, and its score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidegauge.config import KEYS
from tidegauge.functions.arrays import argmax_index, dequantise
from tidegauge.functions.types import VECTOR
from tidegauge.operators.metrics import evaluate


def forecast(windows: DataFrame, predict: Callable[[np.ndarray], np.ndarray], x: str = "x") -> DataFrame:
    """Add ``pred``: ``predict`` maps a (batch, length) array to (batch, steps)."""
    schema = StructType([*windows.schema.fields, StructField("pred", VECTOR)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = np.asarray(predict(np.stack(batch[x].to_numpy())), dtype=float)
                yield batch.assign(pred=list(out))

    return windows.mapInPandas(run, schema)


def last_value(windows: DataFrame, pred_len: int, x: str = "x") -> DataFrame:
    """Naive forecast that repeats the last input."""
    return windows.withColumn("pred", F.array_repeat(F.element_at(x, -1), pred_len))


def restore(forecasts: DataFrame, params: DataFrame, columns: tuple[str, ...] = ("pred", "y")) -> DataFrame:
    """Bring scaled arrays back to the units of their series."""
    joined = forecasts.join(params, KEYS)
    undo = lambda v: v * F.col("scale") + F.col("mean")
    return joined.withColumns({c: F.transform(c, undo) for c in columns}).drop("mean", "scale")


def score(forecasts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Element-wise mse and mae, by default per dataset."""
    return evaluate(forecasts, by if by is not None else ["dataset"])


def decode_scores(df: DataFrame, scores: str, scale: str = "scale", compat: bool = False) -> DataFrame:
    """Values of the best-scoring token of every step."""
    tokens = F.transform(scores, argmax_index)
    return df.withColumn("pred", dequantise(tokens, F.col(scale), compat))


def score_tokens(df: DataFrame, scores: str, label: str = "y", by: list[str] | None = None, compat: bool = False) -> DataFrame:
    """Mean squared error between decoded best tokens and decoded label tokens."""
    decoded = decode_scores(df, scores, compat=compat)
    decoded = decoded.withColumn("_true", dequantise(F.col(label), F.col("scale"), compat))
    return evaluate(decoded, by, "pred", "_true").drop("mae")
