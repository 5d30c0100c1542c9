"""Forecast-error metrics over (pred, true) rows, optionally per group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidegauge.config import KEYS
from tidegauge.operators.order import profile, with_neighbours

# Fixed value: guards divisions by zero.
TINY = 1e-8


def _agg(df: DataFrame, by: list[str], *cols: Column) -> DataFrame:
    return df.groupBy(*by).agg(*cols)


def mae() -> Column:
    return F.avg(F.abs(F.col("pred") - F.col("true")))


def mse() -> Column:
    return F.avg((F.col("pred") - F.col("true")) * (F.col("pred") - F.col("true")))


def rmse() -> Column:
    return F.sqrt(mse())


def mape() -> Column:
    return F.avg(F.abs(100 * F.try_divide(F.col("pred") - F.col("true"), F.col("true") + TINY)))


def mspe() -> Column:
    ratio = F.try_divide(F.col("pred") - F.col("true"), F.col("true") + TINY)
    return F.avg(ratio * ratio)


def smape() -> Column:
    return F.avg(200 * F.abs(F.col("pred") - F.col("true")) / (F.abs(F.col("pred")) + F.abs(F.col("true")) + TINY))


def nd() -> Column:
    return F.try_divide(mae(), F.avg(F.abs(F.col("true"))))


def rse() -> Column:
    """Root squared error over the root of the target's squared deviations."""
    spread = F.var_pop(F.col("true")) * F.count(F.col("true"))
    return F.try_divide(F.sqrt(F.sum((F.col("true") - F.col("pred")) * (F.col("true") - F.col("pred")))), F.sqrt(spread))


METRICS = {"mae": mae, "mse": mse, "rmse": rmse, "mape": mape, "mspe": mspe, "smape": smape, "nd": nd}


def metric(df: DataFrame, by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """The metric bundle, or the named members of it (``rse`` included)."""
    every = {**METRICS, "rse": rse}
    return _agg(df, by or [], *[every[m]().alias(m) for m in (names or METRICS)])


_MOMENTS = ("nt", "mt", "np", "mp", "nb", "bt", "bp", "c11", "c20", "c02", "c21", "c12", "c22", "lt", "ht", "lp", "hp")


def _batch_moments(t: np.ndarray, p: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """(groups, moments) of a batch: counts and means of each side, and central co-moments of the rows that have both."""
    def mean(x, own, count):
        return np.bincount(own, x, groups) / np.maximum(count, 1)

    out = []
    for x in (t, p):
        there = ~np.isnan(x)
        count = np.bincount(group[there], minlength=groups)
        out += [count, mean(x[there], group[there], count)]
    both = ~(np.isnan(t) | np.isnan(p))
    t_, p_, own = t[both], p[both], group[both]
    count = np.bincount(own, minlength=groups)
    bt, bp = mean(t_, own, count), mean(p_, own, count)
    dt, dp = t_ - bt[own], p_ - bp[own]
    out += [count, bt, bp] + [np.bincount(own, dt**i * dp**j, groups) for i, j in ((1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (2, 2))]
    for x in (t, p):
        there = ~np.isnan(x)
        for start, take in ((np.inf, np.minimum), (-np.inf, np.maximum)):
            edge = np.full(groups, start)
            take.at(edge, group[there], x[there])
            out.append(edge)
    return np.stack([np.asarray(x, float) for x in out], 1)


def _partial_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of every batch and group: few rows, whatever a group's size."""
    rows = df.select(*keys, F.col("true").cast("double").alias("true"), F.col("pred").cast("double").alias("pred"))
    schema = StructType([rows.schema[k] for k in keys] + [StructField(f"_{m}", DoubleType()) for m in _MOMENTS])

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                t, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("true", "pred"))
                codes, first = np.zeros(batch.num_rows, np.int64), np.zeros(1, np.int64)
                for c in range(len(keys)):
                    own = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                    _, first, codes = np.unique(codes * (int(own.max()) + 1) + own, return_index=True, return_inverse=True)
                found = _batch_moments(t, p, codes, len(first))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first)) for c in range(len(keys))), *(pa.array(x) for x in found.T)], schema.names)

    return rows.mapInArrow(work, schema)


def corr_by_column(df: DataFrame, column: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean over columns of sum(dt*dp) / sqrt(sum(dt^2 * dp^2)).

    This is the coded definition and not Pearson's; ``F.corr`` gives that one.  Co-moments up to order (2, 2) about the means of
    each batch are carried to the means of the whole column, so rows are read once and only moments are exchanged.  A column
    with a constant side counts for nothing.
    """
    by = by or []
    keys = list(dict.fromkeys([*by, *column]))
    part = _partial_moments(df, keys)
    whole = Window.partitionBy(*keys)

    def mean(n, m):
        return F.try_divide(F.sum(F.col(n) * F.col(m)).over(whole), F.sum(n).over(whole))

    part = part.withColumns({"_t": F.col("_bt") - mean("_nt", "_mt"), "_p": F.col("_bp") - mean("_np", "_mp")})
    n, t, p = F.col("_nb"), F.col("_t"), F.col("_p")
    one = F.sum(F.col("_c11") + n * t * p)
    two = F.sum(F.col("_c22") + 2 * p * F.col("_c21") + p * p * F.col("_c20") + 2 * t * F.col("_c12") + 4 * t * p * F.col("_c11")
                + t * t * F.col("_c02") + n * t * t * p * p)
    constant = (F.min("_lt") == F.max("_ht")) | (F.min("_lp") == F.max("_hp"))
    ratio = F.when(~constant, F.try_divide(one, F.sqrt(two)))
    per = part.groupBy(*keys).agg(ratio.alias("_r"))
    return per.groupBy(*by).agg(F.avg("_r").alias("corr"))


def mase(forecasts: DataFrame, history: DataFrame, freq: int, keys: list[str] = KEYS) -> DataFrame:
    """Mean absolute error over the mean absolute ``freq``-step change of the history."""
    lagged = with_neighbours(
        history, keys, "idx", freq, lambda w: {"_l": F.lag("y", freq).over(w)}, profile(history, keys)
    )
    base = lagged.agg(F.avg(F.abs(F.col("y") - F.col("_l"))).alias("_m"))
    err = forecasts.agg(F.avg(F.abs(F.col("pred") - F.col("true"))).alias("_e"))
    both = err.unionByName(base, allowMissingColumns=True).agg(F.max("_e").alias("_e"), F.max("_m").alias("_m"))
    return both.select((F.col("_e") / (F.col("_m") + TINY)).alias("mase"))


def explode_steps(windows: DataFrame, pred: str = "pred", true: str = "y", keep: list[str] = KEYS) -> DataFrame:
    """One row per forecast step from array columns."""
    zipped = F.arrays_zip(F.col(pred).alias("pred"), F.col(true).alias("true"))
    return windows.select(*keep, F.posexplode(zipped).alias("step", "_z")).select(
        *keep, "step", F.col("_z.pred").alias("pred"), F.col("_z.true").alias("true")
    )


def evaluate(windows: DataFrame, by: list[str] | None = None, pred: str = "pred", true: str = "y") -> DataFrame:
    """Element-wise mse and mae over all windows."""
    by = by or []
    return metric(explode_steps(windows, pred, true, by), by, ["mse", "mae"])
