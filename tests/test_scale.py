"""Plans for groups beyond the bound give what the short plans give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.features.spectrum import long_dft, spectrum
from tidegauge.operators.joins import merge_sensors
from tidegauge.operators.order import profile, rank_within, running_sum, with_neighbours, with_totals
from tidegauge.operators.sampling import at_most, shuffled_batches
from tidegauge.operators.scaling import fit_scaler, scale
from tidegauge.operators.splits import split_lookback
from tidegauge.operators.windows import global_sample_ids, sample_windows, signal_windows

KEYS = ["dataset", "series_id"]
SETTINGS = ["spark.tidegauge.maxGroupRows", "spark.tidegauge.chunkRows", "spark.tidegauge.windowChunk"]


def skewed(spark):
    """One series holds well over a third of the rows and a third of its values are equal."""
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("hot", 400), ("b", 60), ("c", 17), ("d", 1)):
        y = rng.normal(size=n).round(2)
        y[:: 3] = 0.0
        rows += [("d", name, i, float(v)) for i, v in enumerate(y)]
    order = rng.permutation(len(rows))
    return spark.createDataFrame(
        [rows[i] for i in order], "dataset string, series_id string, idx bigint, y double"
    ).repartition(7)


def both(spark, run):
    """Rows of the short and of the long plan."""
    a = sorted(map(tuple, run().collect()), key=repr)
    for s in SETTINGS:
        spark.conf.set(s, "16")
    try:
        b = sorted(map(tuple, run().collect()), key=repr)
    finally:
        for s in SETTINGS:
            spark.conf.unset(s)
    return a, b


def test_rank(spark):
    s = skewed(spark).withColumnRenamed("idx", "t")
    a, b = both(spark, lambda: rank_within(s, KEYS, ["y", "t"], "r"))
    assert a == b and len(a) == 478
    hot = sorted(r[-1] for r in b if r[1] == "hot")
    assert hot == list(range(400))


def test_short_groups_stay_out_of_the_range_shuffle(spark):
    s = skewed(spark)
    spark.conf.set("spark.tidegauge.maxGroupRows", "100")
    try:
        out = rank_within(s, KEYS, ["y", "idx"], "r")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.unset("spark.tidegauge.maxGroupRows")
    assert "Union" in plan and out.columns == [*s.columns, "r"] and len(got) == 478
    for name, n in (("hot", 400), ("b", 60)):
        own = sorted((r.y, r.idx, r.r) for r in got if r.series_id == name)
        assert [r for _, _, r in own] == list(range(n))


def test_rank_over_the_whole_table(spark):
    s = skewed(spark)
    got = rank_within(s, [], ["y", "series_id", "idx"], "r").orderBy("r").collect()
    assert [r.r for r in got] == list(range(478))
    assert [(r.y, r.series_id, r.idx) for r in got] == sorted((r.y, r.series_id, r.idx) for r in got)


def test_neighbours(spark):
    s = skewed(spark)

    def run():
        build = lambda w: {
            "a": F.lag("y", 5).over(w), "b": F.lead("y", 3).over(w), "c": F.max("y").over(w.rowsBetween(-5, 5))
        }
        return with_neighbours(s, KEYS, "idx", 5, build, profile(s, KEYS))

    a, b = both(spark, run)
    assert a == b and len(a) == 478


def test_running_sum_and_totals(spark):
    s = skewed(spark)

    def run():
        p = profile(s, KEYS)
        out = running_sum(s, KEYS, "idx", {"c": F.lit(1), "z": F.round(F.col("y") * 100).cast("bigint")}, p)
        return with_totals(out, KEYS, {"top": F.max("y")}, p)

    a, b = both(spark, run)
    assert a == b and max(r[4] for r in b) == 400


def test_sample_windows_do_not_depend_on_chunks(spark):
    s = skewed(spark)
    for stride in (1, 3, 7):
        a, b = both(spark, lambda: sample_windows(s, 5, 2, stride))
        assert a == b
        assert len(a) == sum(max(0, (n - 7) // stride + 1) if n >= 7 else 0 for n in (400, 60, 17, 1))


def test_splits_and_scaling_of_hot_series(spark):
    s = skewed(spark).withColumn("ts", F.lit(None).cast("timestamp_ntz"))

    def run():
        parts = split_lookback(s, 6, 2)
        return sample_windows(scale(parts, fit_scaler(s)), 6, 2, 5, ["split", *KEYS]).withColumn("x", F.transform("x", lambda v: F.round(v, 9))).withColumn("y", F.transform("y", lambda v: F.round(v, 9)))

    a, b = both(spark, run)
    assert a == b and {r[0] for r in b} == {"train", "val", "test"}


def test_signal_windows_of_hot_series(spark):
    s = skewed(spark)
    a, b = both(spark, lambda: signal_windows(s, 8, 0.5))
    assert a == b and len(a) == 8 * sum((n - 8) // 4 + 1 for n in (400, 60, 17))


def test_hot_joins_are_split(spark):
    """The long plan joins on a block of the position and regroups by chunk."""
    s = skewed(spark)
    spark.conf.set("spark.tidegauge.maxGroupRows", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scale(s, fit_scaler(s))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.tidegauge.maxGroupRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "_block" in plan.split("SortMergeJoin")[1].split("\n")[0]


def test_sample_ids(spark):
    s = skewed(spark)
    a, b = both(spark, lambda: global_sample_ids(sample_windows(s, 5, 2, 3), 3).drop("x", "y"))
    assert a == b
    assert sorted(r[-1] for r in b) == list(range(len(b)))
    assert [r[:3] for r in sorted(b, key=lambda r: r[-1])] == sorted(r[:3] for r in b)


@pytest.mark.parametrize("n", [50, 97, 128, 331])
def test_long_transform(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    rows = [("s", n, i, float(v), 0.0) for i, v in enumerate(x)]
    pts = spark.createDataFrame(rows, "sid string, n bigint, j bigint, re double, im double")
    got = long_dft(pts, ["sid"]).collect()
    want = np.fft.fft(x)
    assert len(got) == n
    assert all(abs(complex(r.re, r.im) - want[r.k]) < 1e-9 for r in got)


def test_spectrum_mixes_short_and_long(spark):
    s = skewed(spark).filter("series_id <> 'd'")
    a, b = both(spark, lambda: spectrum(s, KEYS, profile(s, KEYS)).select(*KEYS, "n", "k", *[F.round(F.col(c) + 1e-7, 6) for c in ("m", "dm", "pw")]))
    assert len(a) == len(b) == 201 + 31 + 9
    for x, y in zip(a, b):
        assert x[:4] == y[:4] and np.allclose(x[4:], y[4:], atol=2e-6)


def test_sampling_is_reproducible(spark):
    s = skewed(spark)
    a = at_most(s, KEYS, ["idx"], 10, seed=1)
    assert {(r.series_id, r["count"]) for r in a.groupBy("series_id").count().collect()} == {("hot", 10), ("b", 10), ("c", 10), ("d", 1)}
    assert sorted(a.collect()) == sorted(at_most(s.repartition(3), KEYS, ["idx"], 10, seed=1).collect())
    sh = shuffled_batches(s, ["series_id", "idx"], 50, seed=2).collect()
    assert sorted(r.shuffle_pos for r in sh) == list(range(478))
    assert {r.batch_id for r in sh} == set(range(10))


def test_merge_sensors(spark):
    rng = np.random.default_rng(1)
    rows, ref = [], {}
    for sensor, lo, hi, n in (("acc", 0.0, 30.0, 70), ("gyr", 2.5, 40.0, 40)):
        t = np.sort(np.concatenate([[lo, hi], rng.uniform(lo, hi, n)]))
        for axis in (1, 2):
            v = rng.normal(size=len(t))
            ref[f"{sensor}{axis}"] = (t, v)
            rows += [("f", sensor, axis, float(a), float(b)) for a, b in zip(t, v)]
    s = spark.createDataFrame(rows, "folder string, sensor string, axis int, t double, v double").repartition(4)
    a, b = both(spark, lambda: merge_sensors(s, 4, 1.0))
    assert a == b
    grid = np.linspace(2.5, 30.0, int(27.5 * 4))
    for name, (t, v) in ref.items():
        got = sorted((r[2], r[4]) for r in b if r[1] == name)
        assert [i for i, _ in got] == list(range(len(grid)))
        assert np.allclose([y for _, y in got], np.interp(grid, t, v))
