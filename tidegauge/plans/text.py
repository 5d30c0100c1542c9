"""Text prompts of windows: statistics and strongest lags put into words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.arrays import normalise_windows, window_statistics
from tidegauge.functions.types import VECTOR, once

# Class of each public benchmark dataset.
DATASET_CLASS = {
    "ETTh1": 0, "ETTh2": 1, "ETTm1": 2, "ETTm2": 3,
    "electricity": 4, "exchange_rate": 5, "traffic": 6, "weather": 7,
}


def dataset_dim(spark: SparkSession, descriptions: str | None = None) -> DataFrame:
    """Dataset classes, with descriptions from a JSON map of class to text."""
    dim = spark.createDataFrame(list(DATASET_CLASS.items()), "dataset string, ds_index int")
    if descriptions is None:
        return dim.withColumn("description", F.lit(None).cast("string"))
    raw = spark.read.option("multiLine", True).option("wholetext", True).text(descriptions)
    pairs = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("_k", "description"))
    return dim.join(pairs.withColumn("ds_index", F.col("_k").cast("int")).drop("_k"), "ds_index", "left").select(
        "dataset", "ds_index", "description"
    )


@F.pandas_udf(VECTOR)
def _circular(windows: pd.Series) -> pd.Series:
    """Circular autocorrelation of each window."""
    out = []
    for x in windows:
        x = np.asarray(x, dtype=float)
        out.append(np.fft.irfft(np.abs(np.fft.rfft(x)) ** 2, len(x) - len(x) % 2))
    return pd.Series(out)


_circular = once(_circular)


def top_lags(df: DataFrame, x: str = "x", k: int = 5, digits: int = 9) -> DataFrame:
    """The ``k`` lags of largest circular autocorrelation.

    Mirror lags tie; values are compared after rounding, and of equal ones the
    smaller lag comes first.
    """
    scored = df.withColumn("_c", _circular(x))
    pairs = F.transform("_c", lambda c, i: F.struct((-F.round(c, digits)).alias("c"), i.alias("lag")))
    return scored.withColumn("lags", F.slice(F.array_sort(pairs), 1, k)["lag"]).drop("_c")


def render_prompts(
    windows: DataFrame, dim: DataFrame, seq_len: int, pred_len: int, digits: int = 6
) -> DataFrame:
    """Adds ``text``: dataset description, task and statistics of the normalised window."""
    norm = top_lags(window_statistics(normalise_windows(windows)))
    unknown = F.raise_error(F.concat(F.lit("no description of dataset "), "dataset")).cast("string")
    named = norm.join(dim.select("dataset", "description"), "dataset", "left").withColumn("description", F.coalesce("description", unknown))
    num = lambda c: F.format_string(f"%.{digits}f", F.col(c))
    lags = F.concat(F.lit("["), F.array_join(F.col("lags").cast("array<string>"), ", "), F.lit("]"))
    # Fixed value: the wording of the prompt.
    text = F.concat(
        F.lit("<|start_prompt|>Dataset description: "), F.col("description"),
        F.lit(f"<|end_prompt|>Task description: forecast the next {pred_len} steps given the previous "
              f"{seq_len} steps information; Input statistics: min value "), num("min_value"),
        F.lit(", max value "), num("max_value"),
        F.lit(", median value "), num("median_value"),
        F.lit(", the trend of input is "), F.when(F.col("trend") > 0, F.lit("upward")).otherwise(F.lit("downward")),
        F.lit(", top 5 lags are : "), lags, F.lit("<|<end_prompt>|>"),
    )
    return named.withColumn("text", text).drop("description")
