"""Array expressions: per-window normalisation and token quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Variance guard of the window normaliser and the token layout.
EPS = 1e-5
LOW, HIGH = -3.0, 3.0
CENTRES = 1021
SPECIAL = 2
PAD, END = 0, 1


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean_of(x: Column) -> Column:
    return total(x) / F.size(x)


def popvar_of(x: Column, mean: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(x)


def normalise_windows(
    df: DataFrame, x: str = "x", subtract_last: bool = False, weight: float = 1.0, bias: float = 0.0
) -> DataFrame:
    """Centre and scale each window by itself; ``win_loc`` and ``win_std`` allow the restore."""
    base = df.withColumn("_mean", mean_of(F.col(x)))
    loc = F.element_at(x, -1) if subtract_last else F.col("_mean")
    base = base.withColumns(
        {"win_loc": loc, "win_std": F.sqrt(popvar_of(F.col(x), F.col("_mean")) + EPS)}
    )
    return base.withColumn(
        x,
        F.transform(x, lambda v: (v - F.col("win_loc")) / F.col("win_std") * F.lit(weight) + F.lit(bias)),
    ).drop("_mean")


def restore_windows(df: DataFrame, x: str = "x", weight: float = 1.0, bias: float = 0.0) -> DataFrame:
    """Undo ``normalise_windows`` on any array column of the same row."""
    undo = (lambda v: v) if weight == 1.0 and bias == 0.0 else (
        lambda v: (v - F.lit(bias)) / F.lit(weight + EPS * EPS)
    )
    return df.withColumn(
        x, F.transform(x, lambda v: undo(v) * F.col("win_std") + F.col("win_loc"))
    )


def _missing(v: Column) -> Column:
    return v.isNull() | F.isnan(v)


def token_scale(x: Column) -> Column:
    """Mean absolute value of the present points, 1 when that is not positive."""
    seen = F.filter(x, lambda v: ~_missing(v))
    scale = F.try_divide(F.aggregate(seen, F.lit(0.0), lambda a, v: a + F.abs(v)), F.size(seen))
    return F.when(scale > 0, scale).otherwise(F.lit(1.0))


def quantise(x: Column, scale: Column, end_token: bool = False) -> Column:
    """Index of the nearest of the uniform centres, shifted past the special tokens."""
    width = (HIGH - LOW) / (CENTRES - 1)

    def token(v):
        bin_ = F.floor((v / scale - LOW) / width + 0.5)
        inside = F.least(F.greatest(bin_, F.lit(0).cast("bigint")), F.lit(CENTRES - 1).cast("bigint"))
        return F.when(_missing(v), F.lit(PAD)).otherwise((inside + SPECIAL + 1).cast("int"))

    tokens = F.transform(x, token)
    return F.concat(tokens, F.array(F.lit(END))) if end_token else tokens


def tokenise(
    df: DataFrame, x: str, context: int | None = None, tokens: str = "tokens", scale: str = "scale",
    end_token: bool = False,
) -> DataFrame:
    """Tokens and scale of an array column, after keeping its last ``context`` points."""
    col = F.col(x)
    if context is not None:
        keep = F.when(F.size(col) > context, F.slice(col, -context, context)).otherwise(col)
        df = df.withColumn("_ctx", keep)
        col = F.col("_ctx")
    return df.withColumn(scale, token_scale(col)).withColumn(
        tokens, quantise(col, F.col(scale), end_token)
    ).drop("_ctx")


def dequantise(tokens: Column, scale: Column, compat: bool = False) -> Column:
    """Centre value of each token times the scale.

    ``compat`` keeps the published decoder's habit of reading one bin too high.
    """
    width = (HIGH - LOW) / (CENTRES - 1)
    shift = SPECIAL if compat else SPECIAL + 1
    return F.transform(
        tokens,
        lambda t: (F.least(F.greatest(t - shift, F.lit(0)), F.lit(CENTRES - 1)) * width + LOW) * scale,
    )


def argmax_index(scores: Column) -> Column:
    """Zero-based position of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def lower_median(x: Column) -> Column:
    """Middle value, the lower one of two."""
    return F.element_at(F.array_sort(x), F.floor((F.size(x) + 1) / 2).cast("int"))


def window_statistics(df: DataFrame, x: str = "x") -> DataFrame:
    """Minimum, maximum, lower median and trend of a window."""
    col = F.col(x)
    return df.withColumns(
        {
            "min_value": F.array_min(col),
            "max_value": F.array_max(col),
            "median_value": lower_median(col),
            "trend": F.element_at(col, -1) - F.element_at(col, 1),
        }
    )
