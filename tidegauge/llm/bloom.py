"""Bloom filters of a fixed size, built by Spark and read with NumPy inside tasks. They only save work: what they let through
is checked by an exact join."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.arrow_text import mix

LOG_BITS = 25  # 4 MB, whatever the number of keys


def build(keys: DataFrame, log_bits: int = LOG_BITS) -> Broadcast:
    """Filter over the first column of ``keys`` (bigint). At most 2^log_bits / 64 words reach the driver."""
    k = F.col(keys.columns[0])
    spots = keys.select(F.explode(F.array(
        k.bitwiseAND((1 << log_bits) - 1), F.shiftrightunsigned(k, 64 - log_bits))).alias("spot"))
    words = (spots.select(F.shiftright("spot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(spot & 63 as int))").alias("bits"))
             .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    table = np.zeros(1 << (log_bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table.tobytes())


def hits(shared: Broadcast, keys: np.ndarray) -> np.ndarray:
    table = np.frombuffer(shared.value, np.uint64)
    log_bits = len(table).bit_length() - 1 + 6
    k = keys.view(np.uint64)

    def on(spot):
        return (table[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1

    return on(k & np.uint64((1 << log_bits) - 1)) & on(k >> np.uint64(64 - log_bits))


def key_of(values: np.ndarray) -> np.ndarray:
    """Well-mixed signed keys."""
    return mix(values).view(np.int64)
