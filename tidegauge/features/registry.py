"""Catalogue of series features: selection, parameters and user additions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = ("temporal", "statistical", "spectral")
TAGS = ("audio", "inertial", "ecg", "eeg", "emg")
DEFAULT_FS = 100.0
WIDTHS = tuple(range(1, 10))


@dataclass(frozen=True)
class Feature:
    name: str
    domain: str
    column: str
    tags: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict)
    # Count of outputs, or the parameter that gives it.
    size: int | str = 1
    cost: str = "constant"
    use: bool = True
    fn: Callable | None = None
    # What ``fn`` reads: "rows" (an aggregate) or "array" (the whole signal in order).
    over: str = "rows"

    def outputs(self) -> int:
        if isinstance(self.size, int):
            return self.size
        value = self.params[self.size]
        return value if isinstance(value, int) else len(value)


# Feature names, tags, default parameters and cost classes.
_FS = {"fs": DEFAULT_FS}
_CWT = {"widths": WIDTHS}
_PCT = {"percentile": (0.2, 0.8)}
BUILT_IN = (
    Feature("FFT mean coefficient", "spectral", "fft_mean_coeff", params={**_FS, "nfreq": 256}, size="nfreq"),
    Feature("Fundamental frequency", "spectral", "fundamental_frequency", params=_FS, cost="log"),
    Feature("Human range energy", "spectral", "human_range_energy", ("inertial",), _FS, cost="log"),
    Feature("LPCC", "spectral", "lpcc", ("audio",), {"n_coeff": 12}, "n_coeff", "log"),
    Feature("MFCC", "spectral", "mfcc", ("audio", "emg"),
            {**_FS, "pre_emphasis": 0.97, "nfft": 512, "nfilt": 40, "num_ceps": 12, "cep_lifter": 22},
            "num_ceps"),
    Feature("Max power spectrum", "spectral", "max_power_spectrum", params=_FS, cost="log"),
    Feature("Maximum frequency", "spectral", "max_frequency", params=_FS, cost="log"),
    Feature("Median frequency", "spectral", "median_frequency", params=_FS, cost="log"),
    Feature("Power bandwidth", "spectral", "power_bandwidth", params=_FS, cost="log"),
    Feature("Spectral centroid", "spectral", "spectral_centroid", ("audio",), _FS, cost="linear"),
    Feature("Spectral decrease", "spectral", "spectral_decrease", params=_FS, cost="log"),
    Feature("Spectral distance", "spectral", "spectral_distance", params=_FS, cost="log"),
    Feature("Spectral entropy", "spectral", "spectral_entropy", ("eeg",), _FS, cost="log"),
    Feature("Spectral kurtosis", "spectral", "spectral_kurtosis", params=_FS, cost="linear"),
    Feature("Spectral positive turning points", "spectral", "spectral_positive_turning", params=_FS, cost="log"),
    Feature("Spectral roll-off", "spectral", "spectral_roll_off", ("audio",), _FS, cost="log"),
    Feature("Spectral roll-on", "spectral", "spectral_roll_on", params=_FS, cost="log"),
    Feature("Spectral skewness", "spectral", "spectral_skewness", params=_FS, cost="linear"),
    Feature("Spectral slope", "spectral", "spectral_slope", params=_FS, cost="log"),
    Feature("Spectral spread", "spectral", "spectral_spread", params=_FS, cost="linear"),
    Feature("Spectral variation", "spectral", "spectral_variation", params=_FS, cost="log"),
    Feature("Wavelet absolute mean", "spectral", "wavelet_abs_mean", ("eeg", "ecg"), _CWT, "widths", "linear"),
    Feature("Wavelet energy", "spectral", "wavelet_energy", ("eeg",), _CWT, "widths", "linear"),
    Feature("Wavelet entropy", "spectral", "wavelet_entropy", ("eeg",), _CWT, 1, "linear"),
    Feature("Wavelet standard deviation", "spectral", "wavelet_std", ("eeg",), _CWT, "widths", "linear"),
    Feature("Wavelet variance", "spectral", "wavelet_var", ("eeg",), _CWT, "widths", "linear"),
    Feature("Absolute energy", "statistical", "abs_energy", ("audio",), cost="log"),
    Feature("Average power", "statistical", "average_power", ("audio",), _FS),
    Feature("ECDF", "statistical", "ecdf", params={"d": 10}, size="d", cost="log"),
    Feature("ECDF Percentile", "statistical", "ecdf_percentile", params=_PCT, size="percentile", cost="log"),
    Feature("ECDF Percentile Count", "statistical", "ecdf_percentile_count", params=_PCT, size="percentile",
            cost="log"),
    Feature("Entropy", "statistical", "entropy", ("eeg",), {"prob": "standard"}, cost="log"),
    Feature("Histogram", "statistical", "hist", params={"nbins": 10, "r": 1.0}, size="nbins", cost="log"),
    Feature("Interquartile range", "statistical", "interq_range"),
    Feature("Kurtosis", "statistical", "kurtosis"),
    Feature("Max", "statistical", "calc_max"),
    Feature("Mean", "statistical", "calc_mean", ("inertial",)),
    Feature("Mean absolute deviation", "statistical", "mean_abs_deviation", cost="log"),
    Feature("Median", "statistical", "calc_median"),
    Feature("Median absolute deviation", "statistical", "median_abs_deviation"),
    Feature("Min", "statistical", "calc_min"),
    Feature("Peak to peak distance", "statistical", "pk_pk_distance"),
    Feature("Root mean square", "statistical", "rms", ("emg", "inertial")),
    Feature("Skewness", "statistical", "skewness"),
    Feature("Standard deviation", "statistical", "calc_std"),
    Feature("Variance", "statistical", "calc_var"),
    Feature("Area under the curve", "temporal", "auc", params=_FS, cost="log"),
    Feature("Autocorrelation", "temporal", "autocorr", ("inertial",)),
    Feature("Centroid", "temporal", "calc_centroid", params=_FS),
    Feature("Mean absolute diff", "temporal", "mean_abs_diff"),
    Feature("Mean diff", "temporal", "mean_diff"),
    Feature("Median absolute diff", "temporal", "median_abs_diff"),
    Feature("Median diff", "temporal", "median_diff"),
    Feature("Negative turning points", "temporal", "negative_turning", ("emg",)),
    Feature("Neighbourhood peaks", "temporal", "neighbourhood_peaks", params={"n": 10}),
    Feature("Positive turning points", "temporal", "positive_turning", ("emg",)),
    Feature("Signal distance", "temporal", "distance"),
    Feature("Slope", "temporal", "slope", cost="log"),
    Feature("Sum absolute diff", "temporal", "sum_abs_diff"),
    Feature("Zero crossing rate", "temporal", "zero_cross", ("audio", "emg")),
)

# Defined by the library but outside the default catalogue.
EXTRA = (
    Feature("ECDF slope", "statistical", "ecdf_slope", params={"p_init": 0.5, "p_end": 0.75}, cost="log"),
)

_USER: dict[str, Feature] = {}


def register_feature(
    name: str, domain: str, fn: Callable, tags: tuple[str, ...] = (), params: dict | None = None, size: int = 1,
    over: str = "rows",
) -> Feature:
    """Add a feature.

    With ``over="rows"``, ``fn(**params)`` returns an aggregate Column over the
    columns ``idx``, ``y``, ``prev`` and ``next``; it works for signals of any
    length.  With ``over="array"``, ``fn(x, **params)`` gets the whole signal as
    an array Column and returns a Column, of an Arrow UDF for example; signals
    beyond the group bound raise.  A feature with ``size`` above 1 returns
    ``array<double>``.
    """
    if domain not in DOMAINS:
        raise ValueError(f"domain must be one of {DOMAINS}")
    if over not in ("rows", "array"):
        raise ValueError("over must be rows or array")
    if name in {f.name for f in (*BUILT_IN, *EXTRA)} or name in _USER:
        raise ValueError(f"feature {name} is already registered")
    _USER[name] = Feature(name, domain, name, tags, params or {}, size, fn=fn, over=over)
    return _USER[name]


def unregister_feature(name: str) -> None:
    _USER.pop(name, None)


def select(
    domain: str | None = None, tag: str | None = None, names: list[str] | None = None,
    fs: float | None = None, overrides: dict[str, dict] | None = None,
) -> list[Feature]:
    """Features by domain, tag or name, with parameters applied to copies."""
    if domain is not None and domain not in DOMAINS:
        raise ValueError(f"domain must be one of {DOMAINS}")
    if tag is not None and tag not in TAGS:
        raise ValueError(f"tag must be one of {TAGS}")
    pool = [*BUILT_IN, *_USER.values()]
    if names is not None:
        known = {f.name: f for f in (*pool, *EXTRA)}
        missing = [x for x in names if x not in known]
        if missing:
            raise ValueError(f"unknown features {missing}")
        pool = [known[x] for x in names]
    out = []
    for f in pool:
        if not f.use or (domain and f.domain != domain):
            continue
        if tag and not any(tag in t for t in f.tags):
            continue
        params = {**f.params, **(overrides or {}).get(f.name, {})}
        if fs is not None and "fs" in params:
            params["fs"] = float(fs)
        out.append(replace(f, params=params))
    return out


def catalogue(spark: SparkSession, features: list[Feature] | None = None) -> DataFrame:
    """The features as a table."""
    rows = [
        (f.domain, f.name, f.column, list(f.tags), {k: str(v) for k, v in f.params.items()}, f.outputs(), f.use, f.cost)
        for f in (features or select())
    ]
    return spark.createDataFrame(
        rows,
        "domain string, feature string, function string, tags array<string>, "
        "params map<string,string>, n_features int, use boolean, cost string",
    )


def feature_count(cat: DataFrame) -> DataFrame:
    """Width of the feature vector a catalogue describes."""
    return cat.filter("use").agg(F.sum("n_features").alias("n_features"))
