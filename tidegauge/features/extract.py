"""Feature extraction: whole series or windows, in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.config import KEYS, MAX_GROUP_ROWS, bound
from tidegauge.features import native, spectral
from tidegauge.features.onepass import ARRAY_FEATURES, WAVELET, WHOLE_SPECTRUM, extract_arrays
from tidegauge.features.registry import Feature, select
from tidegauge.operators.order import GroupProfile, fits, gather, join_groups, rank_within
from tidegauge.operators.windows import signal_windows

def _long(wide: DataFrame, keys: list[str], features: list[Feature]) -> DataFrame:
    """(feature, k, value) rows; an array whose first value is NaN becomes zeros."""
    types = dict(wide.dtypes)
    parts = []
    for f in features:
        col = F.col(f.column)
        if types[f.column].startswith("array"):
            bad = F.isnan(F.coalesce(F.get(col, F.lit(0)), F.lit(float("nan"))))
            items = F.transform(
                col,
                lambda v, i: F.struct(
                    F.lit(f.name).alias("feature"), i.alias("k"),
                    F.when(bad, F.lit(0.0)).otherwise(v.cast("double")).alias("value"),
                ),
            )
        else:
            items = F.array(
                F.struct(F.lit(f.name).alias("feature"), F.lit(0).alias("k"), col.cast("double").alias("value"))
            )
        parts.append(items)
    return wide.select(*keys, F.explode(F.flatten(F.array(*[F.coalesce(p, F.array()) for p in parts]))).alias("_f")).select(
        *keys, "_f.feature", "_f.k", "_f.value"
    )


def _missing(y="y"):
    return F.col(y).isNull() | F.isnan(F.col(y).cast("double"))


def point_profile(signal: DataFrame, keys: list[str]) -> GroupProfile:
    """Rows, longest group and missing points, in one pass; three numbers reach the driver."""
    sizes = signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(_missing()).alias("m"))
    total = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("longest"), F.sum("m").alias("missing")).first()
    return GroupProfile(total["rows"] or 0, total["longest"] or 0, total["missing"] or 0)


def _present(signal: DataFrame, keys: list[str], prof: GroupProfile) -> DataFrame:
    """Without missing points; the others close up."""
    if prof.missing == 0:
        return signal
    there = signal.filter(~_missing()).withColumnRenamed("idx", "_at")
    return rank_within(there, keys, ["_at"], prof=prof).select(*keys, "idx", "y")


def extract(
    signal: DataFrame, keys: list[str] = KEYS, domain: str | None = None, tag: str | None = None,
    names: list[str] | None = None, fs: float | None = None, overrides: dict[str, dict] | None = None,
    prof: GroupProfile | None = None,
) -> DataFrame:
    """Selected features of every group: ``keys, feature, k, value``.

    Features that share an intermediate share one pass over it; aggregates no
    selected feature reads are pruned from the plan. Missing points (NULL or NaN)
    are left out first, and the others close up.
    """
    chosen = select(domain, tag, names, fs, overrides)
    points = signal.select(*keys, "idx", "y")
    prof = prof if prof and prof.missing is not None else point_profile(points, keys)
    signal = _present(points, keys, prof)
    by_col = {f.column: f for f in chosen if f.fn is None}
    user = [f for f in chosen if f.fn is not None and f.over == "rows"]
    arrays = [f for f in chosen if f.fn is not None and f.over == "array"]
    out: list[DataFrame] = []

    def param(column, key, default):
        return by_col[column].params.get(key, default) if column in by_col else default

    gathered = [f for c, f in by_col.items() if c in ARRAY_FEATURES]
    if gathered and fits(signal, prof):
        out.append(extract_arrays(points, keys, gathered))
    elif gathered:
        limit = bound(signal.sparkSession, MAX_GROUP_ROWS)
        sizes = signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        short = join_groups(signal, sizes.filter(F.col("n") <= limit), keys, prof).drop("n")
        long = join_groups(signal, sizes.filter(F.col("n") > limit), keys, prof).drop("n")
        out.append(extract_arrays(short, keys, gathered))
        out += _tables(long, keys, gathered, sizes.filter(F.col("n") > limit), prof)
    for f in gathered:
        by_col.pop(f.column)
    if "entropy" in by_col:
        f = by_col.pop("entropy")
        prob = f.params.get("prob", "standard")
        if prob == "standard":
            table = native.entropy_standard(signal, keys)
        else:
            table = native.ENTROPY[prob](signal, keys, prof)
        out.append(_long(table, keys, [f]))
    if arrays:
        if not fits(signal, prof):
            raise ValueError(f"signals of {prof.longest} points are too long for {[f.name for f in arrays]}; use windows")
        packed = gather(signal, keys, "idx", "y")
        wide = packed.select(*keys, *[f.fn(F.col("x"), **f.params).alias(f.column) for f in arrays])
        out.append(_long(wide, keys, arrays))
    rest = list(by_col.values())
    if rest or user:
        out.append(_native(signal, keys, prof, rest, user, param))
    return reduce(DataFrame.unionByName, out)


def _tables(signal, keys, features, sizes, prof) -> list[DataFrame]:
    """The features that need a whole signal, for signals too long to gather: a table per family."""
    by_col, out = {f.column: f for f in features}, []
    whole = [f for c, f in by_col.items() if c in WHOLE_SPECTRUM]
    for rate in sorted({f.params["fs"] for f in whole}):
        out.append(_long(spectral.spectral_table(signal, keys, rate, prof), keys, [f for f in whole if f.params["fs"] == rate]))
    waves = [f for c, f in by_col.items() if c in WAVELET]
    for widths in sorted({tuple(f.params["widths"]) for f in waves}):
        out.append(_long(spectral.wavelet_table(signal, keys, widths), keys, [f for f in waves if tuple(f.params["widths"]) == widths]))
    single = {
        "fundamental_frequency": lambda p: spectral.fundamental_frequency(signal, keys, p["fs"], prof),
        "fft_mean_coeff": lambda p: spectral.fft_mean_coeff(signal, keys, p["nfreq"], p["fs"], sizes, prof),
        "lpcc": lambda p: spectral.lpcc(signal, keys, p["n_coeff"], prof),
        "mfcc": lambda p: spectral.mfcc(signal, keys, **p),
    }
    return out + [_long(make(by_col[c].params), keys, [by_col[c]]) for c, make in single.items() if c in by_col]


def _native(signal, keys, prof, rest, user, param) -> DataFrame:
    fs = next((f.params["fs"] for f in rest if "fs" in f.params), 100.0)
    pct = list(param("ecdf_percentile", "percentile", None) or param("ecdf_percentile_count", "percentile", (0.2, 0.8)))
    slope = None
    if any(f.column == "ecdf_slope" for f in rest):
        slope = (param("ecdf_slope", "p_init", 0.5), param("ecdf_slope", "p_end", 0.75))
    points = [*pct, *(slope or ())]
    base = native.base_table(
        signal, keys, prof, fs, points, param("neighbourhood_peaks", "n", 10),
        param("hist", "nbins", 10), float(param("hist", "r", 1.0)), user,
        wanted={f.column for f in rest},
    )
    wide = native.derive(base, fs, points, param("ecdf", "d", 10), slope)
    for col in ("ecdf_percentile", "ecdf_percentile_count"):
        wide = wide.withColumn(col, F.slice(col, 1, len(pct)))
    for u in user:
        wide = wide.withColumn(u.column, F.col(f"user_{u.name}"))
    return _long(wide, keys, [*rest, *user])


def extract_windows(
    series: DataFrame, window: int, overlap: float = 0.0, keys: list[str] = KEYS, **options
) -> DataFrame:
    """Features of every complete signal window."""
    cut = signal_windows(series, window, overlap, keys)
    prof = options.pop("prof", None)
    if prof is None or prof.missing is None:
        prof = GroupProfile(0, window, series.filter(_missing()).count())
    return extract(cut, [*keys, "win_id"], prof=prof, **options)


PRUNED = "FFT mean coefficient"


def prune(features: DataFrame, prefix: str = PRUNED) -> DataFrame:
    """Drop the features whose name starts with ``prefix``."""
    return features.filter(~F.startswith(F.col("feature"), F.lit(prefix)))


def output_name(header: str = "0"):
    """Flat column name of a feature output: header, feature and, for vectors, the position."""
    return F.concat(F.lit(f"{header}_"), F.col("feature"))


def vectors(features: DataFrame, keys: list[str], cat: DataFrame) -> DataFrame:
    """One name-sorted vector per group; ``_10`` therefore precedes ``_2``."""
    sized = features.join(F.broadcast(cat.select("feature", "n_features")), "feature", "left")
    many = F.coalesce(F.col("n_features") > 1, F.lit(False))
    label = F.concat(output_name(), F.when(many, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(F.lit("")))
    packed = sized.select(*keys, label.alias("name"), "value").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("name", "value"))).alias("_s")
    )
    return packed.select(*keys, F.col("_s.name").alias("names"), F.col("_s.value").alias("features"))
