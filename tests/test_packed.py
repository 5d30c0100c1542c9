"""Packed series beside the long path, the plan it gives, and what happens to series without prompt."""

import pytest
from pyspark.sql import functions as F

from tidegauge.config import KEYS, PrepConfig
from tidegauge.operators.packed import numbered_windows, open_packed, pack
from tidegauge.operators.splits import split_plain
from tidegauge.plans import builders

SK = ["split", *KEYS]
CFG = PrepConfig(seq_len=16, pred_len=6, stride=3)


@pytest.fixture(scope="module")
def series(spark):
    rows = [("d", f"s{k}", i, float((i * 37 + k * 11) % 101)) for k, n in enumerate((2000, 300, 33, 31, 5)) for i in range(n)]
    rows += [("ETTh1", "s%0", i, float(i % 7)) for i in range(500)] + [("d", "flat", i, 2.0) for i in range(90)]
    rows += [("d", "holes", i, None if i % 5 else float(i)) for i in range(200)]
    return spark.createDataFrame(
        rows, "dataset string, series_id string, idx long, y double").cache()


@pytest.fixture
def small_chunks(spark):
    conf = {"spark.tidegauge.packChunk": "64", "spark.tidegauge.packHalo": "25", "spark.tidegauge.packBlock": "4"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def rules(spark):
    return spark.createDataFrame([("ETTh1", 0.6, 0.2, 400)], "dataset string, train_ratio double, val_ratio double, row_cap long")


def near(rows):
    return sorted((tuple([round(v, 9) if v is not None else None for v in c] if isinstance(c, list) else c for c in r) for r in map(tuple, rows)), key=str)


@pytest.mark.parametrize("cfg", [CFG, PrepConfig(seq_len=16, pred_len=6, stride=1), PrepConfig(seq_len=10, pred_len=1, stride=40, scale_on_train=True)])
@pytest.mark.parametrize("ruled", [False, True])
def test_packed_windows_match_the_long_path(spark, series, small_chunks, cfg, ruled):
    r = rules(spark) if ruled else None
    for names, fit in ((["train", "val"], "all"), (["test"], "truncated")):
        got = builders.lookback_windows(series, cfg, names, builders.strides(cfg), r, fit_rows=fit)
        want = builders.cut_samples(builders.scaled_splits(series, cfg, r, fit), cfg, names, builders.strides(cfg))
        rows = near(got.select(want.columns).collect())
        assert rows == near(want.collect()) and len(rows) > 10


def bank(series):
    return split_plain(series).groupBy(*SK).agg(F.array(F.max("y"), F.count(F.lit(1)).cast("double")).alias("features"))


def test_series_without_prompt_raise_or_are_named(spark, series, small_chunks):
    some = bank(series).filter("series_id not in ('s1', 'flat')")
    want = {("train", "d", "s1"), ("val", "d", "s1"), ("train", "d", "flat"), ("val", "d", "flat")}
    with pytest.raises(Exception, match="no prompt for"):
        builders.statistical_samples(series, some, CFG).collect()
    assert {tuple(r) for r in builders.missing_prompts(series, some, CFG).collect()} == want
    kept = builders.statistical_samples(series, some, PrepConfig(seq_len=16, pred_len=6, stride=3, on_missing="drop"))
    every = builders.statistical_samples(series, bank(series), CFG)
    assert near(kept.collect()) == near(every.filter("series_id not in ('s1', 'flat')").collect())
    assert builders.missing_prompts(series, bank(series), CFG).count() == 0
    with pytest.raises(ValueError, match="on_missing"):
        builders.statistical_samples(series, some, PrepConfig(seq_len=16, pred_len=6, on_missing="x"))


def test_colliding_prompts_raise(spark, series):
    twice = bank(series).filter("series_id = 's%0'").withColumn("series_id", F.lit("s_0"))
    with pytest.raises(Exception, match="several prompts have the cleaned name"):
        builders.statistical_samples(series, bank(series).unionByName(twice), CFG).collect()


def test_one_scan_and_no_exchange_but_of_prompts(spark, series):
    packed = pack(series, 22)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bare = builders.lookback_windows(packed, CFG, ["train", "val"], builders.strides(CFG))
        assert "Exchange" not in bare._jdf.queryExecution().executedPlan().toString()
        prompts = bank(series).cache()
        plan = builders.statistical_samples(packed, prompts, CFG)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ys#") > 0
        text = builders.statistical_samples(packed, prompts, CFG)._jdf.queryExecution().executedPlan().toString()
        full = [x for x in text.splitlines() if "FileScan" in x and "ys#" in x]
        assert len(full) == 1, text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_series_is_joined_in_many_tasks(spark, small_chunks):
    hot = spark.range(20_000).select(F.lit("d").alias("dataset"), F.lit("s").alias("series_id"), F.col("id").alias("idx"), F.rand(1).alias("y"))
    packed = pack(hot, 22)
    assert packed.chunks.agg(F.max(F.size("ys"))).first()[0] <= packed.size + packed.halo
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        windows = builders.statistical_samples(packed, bank(hot), CFG)
        shares = [r["count"] for r in windows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(shares) >= 6 and max(shares) < sum(shares) / 2


def test_packed_table_of_its_own(spark, series, tmp_path):
    path = str(tmp_path / "packed")
    pack(series.withColumn("ts", F.timestamp_seconds("idx")), 22, path=path)
    packed = open_packed(spark, path)
    back = packed.rows(("ys", "ts"))
    assert back.exceptAll(series.withColumn("ts", F.timestamp_seconds("idx"))).count() == 0 and back.count() == series.count()
    assert {r.series_id: r.n for r in packed.series().collect()}["s0"] == 2000
    with pytest.raises(ValueError, match="halo"):
        builders.lookback_windows(packed, PrepConfig(seq_len=1100, pred_len=6), ["train"], {"train": 1})
    empty = series.limit(0)
    assert builders.statistical_samples(empty, bank(empty), CFG).count() == 0
    assert builders.missing_prompts(empty, bank(series), CFG).count() == 0


def test_sample_numbers_need_no_exchange_above_windows(spark, series, small_chunks):
    packed = pack(series, 22)
    n = F.col("n")
    bounds, stride = {"a": (F.lit(0), n - 100), "b": (n - 90, n)}, {"a": 7, "b": 3}
    got = numbered_windows(packed, bounds, 16, 6, stride)
    rows = sorted(tuple(r) for r in got.select("split", *KEYS, "off", "sample_id").collect())
    assert [r[-1] for r in rows] == list(range(len(rows))) and len(rows) > 300
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cut = next(i for i, x in enumerate(plan) if "Generate explode" in x)
    assert not any("Join" in x or "Aggregate" in x or "Window" in x for x in plan[:cut]) and any("Join" in x for x in plan[cut:])
