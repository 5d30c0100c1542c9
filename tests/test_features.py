import math

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidegauge.features.extract import extract, extract_windows, prune, vectors
from tidegauge.features.registry import catalogue, feature_count, register_feature, select, unregister_feature

KEYS = ["dataset", "series_id"]


def signals():
    rng = np.random.default_rng(7)
    t = np.arange(97)
    return {
        "noise": rng.normal(0, 1, 97),
        "even": rng.normal(5, 2, 64).round(2),
        "wave": np.sin(2 * np.pi * 7 * t / 97) + 0.1 * rng.normal(size=97),
        "negative": -np.abs(rng.normal(3, 1, 50)) - 0.01,
        "steps": rng.integers(-2, 3, 80).astype(float),
        "long": np.cumsum(rng.normal(size=700)).round(3),
        "closed": np.concatenate([[1.0], rng.normal(size=30), [1.0]]),
    }


def table(spark, data):
    rows = [("d", k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "dataset string, series_id string, idx bigint, y double").repartition(5)


def collect(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.series_id, r.feature), {})[r.k] = r.value
    return out


def close(got, want, label):
    want = np.atleast_1d(np.asarray(want, float))
    vals = np.array([got[k] for k in sorted(got)], float)
    assert len(vals) == len(want), label
    assert np.allclose(vals, want, rtol=1e-7, atol=1e-8, equal_nan=True), (label, vals, want)


def expected(x):
    return {
        **brute.temporal(x), **brute.statistical(x), **brute.spectral(x), **brute.wavelets(x),
        "LPCC": brute.predictor_cepstrum(x), "MFCC": brute.mel_cepstrum(x),
        "FFT mean coefficient": brute.segment_means(x),
    }


# Bins a whole multiple of the sums apart depend on the last bit of either engine.
LOOSE = {"LPCC"}


def check(spark, data, **kw):
    got = collect(extract(table(spark, data), KEYS, **kw))
    for name, x in data.items():
        want = expected(x)
        for f in select(**kw):
            if f.name in LOOSE:
                vals = [got[(name, f.name)][k] for k in sorted(got[(name, f.name)])]
                assert np.allclose(vals, want[f.name], rtol=1e-3, atol=1e-4), (name, f.name)
                continue
            if f.name in ("Kurtosis", "Skewness") and math.isnan(want[f.name]):
                assert math.isnan(got[(name, f.name)][0])
                continue
            close(got[(name, f.name)], want[f.name], (name, f.name))


def test_all_features_match_brute_force(spark):
    check(spark, signals())


def test_long_group_plans_give_the_same_features(spark, tiny_bounds):
    data = {k: v for k, v in signals().items() if k in ("even", "steps", "wave")}
    check(spark, data)


@pytest.mark.parametrize("prob", ["gauss", "kde"])
def test_density_entropy(spark, prob):
    data = {k: v for k, v in signals().items() if k in ("even", "negative", "closed")}
    got = collect(extract(table(spark, data), KEYS, names=["Entropy"], overrides={"Entropy": {"prob": prob}}))
    for k, x in data.items():
        assert got[(k, "Entropy")][0] == pytest.approx(brute.density_entropy(x, prob), abs=1e-9)


def test_density_entropy_of_long_signals(spark, tiny_bounds):
    data = {k: v for k, v in signals().items() if k in ("even", "negative", "closed", "long")} | {"const": np.full(40, 3.0), "far": np.append(np.arange(50.0), 1e5)}
    got = collect(extract(table(spark, data), KEYS, names=["Entropy"], overrides={"Entropy": {"prob": "kde"}}))
    for k, x in data.items():
        assert got[(k, "Entropy")][0] == pytest.approx(brute.density_entropy(x, "kde") if k != "const" else 0.0, abs=1e-9)


def test_constant_and_short_signals(spark):
    data = {"const": np.full(40, 3.0), "zero": np.zeros(40), "one": np.array([2.0]), "two": np.array([1.0, 2.0]),
            "eleven": np.arange(11.0)}
    got = collect(extract(table(spark, data), KEYS))
    assert math.isnan(got[("const", "Kurtosis")][0])
    assert got[("const", "ECDF Percentile Count")] == {0: 3.0, 1: 3.0}
    assert got[("const", "Entropy")][0] == 0.0
    assert got[("const", "Max power spectrum")][0] == pytest.approx(0.0, abs=1e-12)
    assert got[("zero", "Spectral variation")][0] == 1.0
    assert got[("zero", "Wavelet entropy")][0] == 0.0
    assert got[("zero", "Maximum frequency")][0] == 0.0
    assert got[("zero", "LPCC")] == {i: 0.0 for i in range(12)}
    assert got[("two", "Entropy")][0] == 0.0
    assert ("eleven", "LPCC") not in got
    assert got[("eleven", "ECDF")][9] == pytest.approx(10 / 11)


def test_vector_has_133_values(spark):
    data = {k: v for k, v in signals().items() if k in ("even", "wave")}
    feats = prune(extract(table(spark, data), KEYS))
    rows = vectors(feats, KEYS, catalogue(spark)).collect()
    assert [len(r.features) for r in rows] == [133, 133]
    assert rows[0].names == sorted(rows[0].names)
    assert rows[0].names.index("0_LPCC_10") < rows[0].names.index("0_LPCC_2")


def test_windowed_extraction_equals_features_of_slices(spark):
    x = signals()["noise"]
    got = {}
    for r in extract_windows(table(spark, {"a": x}), 32, 0.5, KEYS, names=["Mean", "Slope", "Max power spectrum"]).collect():
        got[(r.win_id, r.feature)] = r.value
    starts = range(0, len(x) - 32 + 1, 16)
    assert {w for w, _ in got} == set(range(len(starts)))
    for w, s in enumerate(starts):
        part = x[s : s + 32]
        assert got[(w, "Mean")] == pytest.approx(part.mean())
        assert got[(w, "Slope")] == pytest.approx(brute.temporal(part)["Slope"])
        assert got[(w, "Max power spectrum")] == pytest.approx(brute.spectral(part)["Max power spectrum"])


def test_catalogue_selection(spark):
    assert feature_count(catalogue(spark)).first()[0] == 133 + 256
    assert len(select("temporal")) == 14 and len(select("statistical")) == 20 and len(select("spectral")) == 26
    assert {f.name for f in select(tag="ecg")} == {"Wavelet absolute mean"}
    with pytest.raises(ValueError):
        select("nowhere")
    with pytest.raises(ValueError):
        select(tag="none")
    first = select(names=["Centroid"], fs=50)[0]
    assert first.params["fs"] == 50 and select(names=["Centroid"])[0].params["fs"] == 100


def test_user_feature(spark):
    register_feature("Range share", "statistical", lambda top: F.max("y") / top, params={"top": 2.0})
    register_feature("Ends", "temporal", lambda: F.array(F.min_by("y", "idx"), F.max_by("y", "idx")), size=2)
    try:
        with pytest.raises(ValueError):
            register_feature("Ends", "temporal", lambda: F.max("y"))
        x = signals()["even"]
        got = collect(extract(table(spark, {"a": x}), KEYS, names=["Range share", "Ends", "Max"]))
        assert got[("a", "Range share")][0] == x.max() / 2
        assert got[("a", "Ends")] == {0: x[0], 1: x[-1]}
    finally:
        unregister_feature("Range share")
        unregister_feature("Ends")


@F.pandas_udf(ArrayType(DoubleType()))
def first_and_last(x: pd.Series) -> pd.Series:
    return x.map(lambda v: [float(v[0]), float(v[-1])])


def test_user_feature_over_arrays(spark):
    register_feature("Edges", "temporal", first_and_last, size=2, over="array")
    try:
        x = signals()["even"]
        got = collect(extract(table(spark, {"a": x}), KEYS, names=["Edges", "Min"]))
        assert got[("a", "Edges")] == {0: x[0], 1: x[-1]}
        spark.conf.set("spark.tidegauge.maxGroupRows", "16")
        with pytest.raises(ValueError):
            extract(table(spark, {"a": x}), KEYS, names=["Edges"])
    finally:
        spark.conf.unset("spark.tidegauge.maxGroupRows")
        unregister_feature("Edges")


def test_ecdf_slope(spark):
    x = signals()["even"]
    got = collect(extract(table(spark, {"a": x, "c": np.full(9, 2.0)}), KEYS, names=["ECDF slope"]))
    s = np.sort(x)
    a, b = (s[brute.ecdf_rank(len(x), p) - 1] for p in (0.5, 0.75))
    assert got[("a", "ECDF slope")][0] == pytest.approx(0.25 / (b - a))
    assert got[("c", "ECDF slope")][0] == math.inf


def test_missing_points_close_up(spark):
    y = [5.0, None, 1.0, 9.0, float("nan"), 3.0, 7.0, None, 2.0, 4.0, 8.0, 6.0, 1.5, 2.5]
    kept = [v for v in y if v is not None and v == v]
    names = ["Median", "Interquartile range", "Mean absolute deviation", "Median absolute deviation", "Root mean square", "ECDF Percentile", "Spectral centroid"]

    def features(values):
        df = spark.createDataFrame([("d", "s", i, v) for i, v in enumerate(values)], "dataset string, series_id string, idx long, y double")
        return {(r.feature, r.k): r.value for r in extract(df, names=names).collect()}

    got, want = features(y), features(kept)
    assert got == pytest.approx(want) and got[("Median", 0)] == pytest.approx(float(np.median(kept)))
