import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.config import PrepConfig
from tidegauge.functions import arrays, calendar
from tidegauge.functions.names import clean_name, clean_path, file_stem
from tidegauge.operators import metrics, scaling, splits, windows
from tidegauge.operators.correlation import correlated_features
from tidegauge.operators.joins import dtw_distance, prompt_lookup
from tidegauge.plans import builders, prompts, scoring, text
from tidegauge.sources import files

KEYS = ["dataset", "series_id"]


def series(spark, data, dataset="d"):
    rows = [(dataset, k, i, float(v) if v is not None else None) for k, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "dataset string, series_id string, idx bigint, y double")
    return df.withColumn("ts", F.expr("timestamp_ntz'2021-03-28 00:00:00' + make_interval(0,0,0,0,cast(idx as int))"))


def by_split(df):
    out = {}
    for r in df.orderBy("series_id", "split", "idx").collect():
        out.setdefault((r.series_id, r.split), []).append(r.src_idx)
    return out


@pytest.mark.parametrize("n", [28, 29, 57, 100])
def test_lookback_split(spark, n):
    got = by_split(splits.split_lookback(series(spark, {"a": range(n)}), 16, 3))
    nt, nv = int(n * 0.7), int(n * 0.1)
    assert got[("a", "train")] == list(range(nt))
    assert got[("a", "val")] == list(range(nt - 16, nt + nv))
    assert got[("a", "test")] == list(range(nt + nv - 16, n))


def test_lookback_split_leaves_out_short_series(spark):
    s = series(spark, {"a": range(27), "b": range(40)})
    assert {k for k, _ in by_split(splits.split_lookback(s, 16, 3))} == {"b"}
    assert [r.series_id for r in builders.dropped_series(s, PrepConfig(16, 3)).collect()] == ["a"]


def test_constant_series_scales_to_zero_and_back(spark):
    s = series(spark, {"c": [4.0] * 6, "v": [1.0, 2.0, 4.0]})
    p = scaling.fit_scaler(s)
    z = scaling.scale(s, p)
    assert {r.y for r in z.filter("series_id = 'c'").collect()} == {0.0}
    back = {(r.series_id, r.idx): r.y for r in scaling.unscale(z, p).collect()}
    assert back[("c", 3)] == 4.0 and back[("v", 2)] == pytest.approx(4.0)


def test_processor_registry():
    with pytest.raises(ValueError):
        scaling.register_processor("standard_scaler", None, None, None)
    with pytest.raises(ValueError):
        files.register_reader("monash", None)


@pytest.mark.parametrize("overlap,n", [(0.0, 40), (0.0, 43), (0.5, 40), (0.75, 41), (0.25, 10)])
def test_signal_windows(spark, overlap, n):
    step = 10 if overlap == 0 else int(round(10 * (1 - overlap)))
    got = {}
    for r in windows.signal_windows(series(spark, {"a": range(n)}), 10, overlap).collect():
        got.setdefault(r.win_id, []).append((r.idx, r.y))
    want = [list(range(i, i + 10)) for i in range(0, n - 9, step)]
    assert [[int(y) for _, y in sorted(got[w])] for w in sorted(got)] == want


def test_signal_window_errors(spark):
    s = series(spark, {"a": range(20)})
    with pytest.raises(ValueError):
        windows.signal_windows(s, 1.5)
    with pytest.raises(ValueError):
        windows.signal_windows(s, 2, 0.9)


def test_patches(spark):
    x = [float(i) for i in range(469)]
    p = spark.createDataFrame([(x,)], "x array<double>").select(windows.patches(F.col("x")).alias("p")).first().p
    padded = x + [x[-1]] * 8
    assert p == [padded[i : i + 16] for i in range(0, len(padded) - 15, 8)] and len(p) == 58


def test_append_needs_one_sample(spark):
    s = series(spark, {"a": range(30)})
    with pytest.raises(ValueError):
        windows.append_series(s, series(spark, {"b": range(5)}), 10)


def test_tokens(spark):
    rng = np.random.default_rng(0)
    x = [*map(float, rng.normal(size=200)), 50.0, -50.0, 0.0, float("nan"), None]
    df = arrays.tokenise(spark.createDataFrame([(x,)], "x array<double>"), "x")
    df = df.withColumn("v", arrays.dequantise(F.col("tokens"), F.col("scale")))
    r = df.first()
    seen = np.array(x[:203])
    scale = np.abs(seen).mean()
    centres = np.linspace(-3, 3, 1021)
    edges = np.concatenate([[-1e20], (centres[1:] + centres[:-1]) / 2, [1e20]])
    want = np.searchsorted(edges, seen / scale, side="right") + 2
    assert r.scale == pytest.approx(scale)
    assert list(r.tokens[:203]) == list(want) and r.tokens[203:] == [0, 0]
    inside = np.abs(seen / scale) <= 3
    assert np.all(np.abs(np.array(r.v[:203]) - seen)[inside] <= scale * 3 / 1020 + 1e-12)
    zeros = arrays.tokenise(spark.createDataFrame([([0.0, 0.0],)], "x array<double>"), "x", end_token=True).first()
    assert zeros.scale == 1.0 and zeros.tokens == [513, 513, 1]


def test_normalise_restore(spark):
    rng = np.random.default_rng(5)
    x = [float(v) for v in rng.normal(3, 2, 20)]
    df = spark.createDataFrame([(x,)], "x array<double>")
    for kw in ({}, {"weight": 2.0, "bias": -1.0}):
        z = arrays.normalise_windows(df, **kw)
        got = np.array(z.first().x)
        want = (np.array(x) - np.mean(x)) / np.sqrt(np.var(x) + 1e-5) * kw.get("weight", 1) + kw.get("bias", 0)
        assert np.allclose(got, want)
        assert np.allclose(arrays.restore_windows(z, **kw).first().x, x)


def test_calendar_against_pandas(spark):
    idx = pd.date_range("2019-12-27 05:17:42", periods=500, freq="17h")
    df = spark.createDataFrame([(i, t.to_pydatetime()) for i, t in enumerate(idx)], "i int, ts timestamp_ntz")
    cols = calendar.fields_for("s", F.col("ts"))
    rows = df.orderBy("i").select(*[c.alias(k) for k, c in cols.items()], calendar.week_of_year(F.col("ts")).alias("week"), calendar.month_of_year(F.col("ts")).alias("month")).toPandas()
    want = {
        "second_of_minute": idx.second / 59 - 0.5, "minute_of_hour": idx.minute / 59 - 0.5, "hour_of_day": idx.hour / 23 - 0.5,
        "day_of_week": idx.dayofweek / 6 - 0.5, "day_of_month": (idx.day - 1) / 30 - 0.5, "day_of_year": (idx.dayofyear - 1) / 365 - 0.5,
        "week": (idx.isocalendar().week.to_numpy() - 1) / 52 - 0.5, "month": (idx.month - 1) / 11 - 0.5,
    }
    for k, v in want.items():
        assert np.allclose(rows[k], np.asarray(v, float)), k
    assert list(calendar.fields_for("15min", F.col("ts"))) == list(cols)[1:]
    assert calendar.fields_for("Y", F.col("ts")) == {}
    with pytest.raises(ValueError):
        calendar.fields_for("fortnight", F.col("ts"))


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    p, t = rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    rows = [(j, float(p[i, j]), float(t[i, j])) for i in range(30) for j in range(4)]
    df = spark.createDataFrame(rows, "col int, pred double, true double")
    r = metrics.metric(df, names=[*metrics.METRICS, "rse"]).first()
    assert r.mse == pytest.approx(((p - t) ** 2).mean()) and r.rmse == pytest.approx(math.sqrt(r.mse))
    assert r.mape == pytest.approx(np.abs(100 * (p - t) / (t + 1e-8)).mean())
    assert r.mspe == pytest.approx((((p - t) / (t + 1e-8)) ** 2).mean())
    assert r.smape == pytest.approx((200 * np.abs(p - t) / (np.abs(p) + np.abs(t) + 1e-8)).mean())
    assert r.nd == pytest.approx(np.abs(p - t).mean() / np.abs(t).mean())
    assert r.rse == pytest.approx(math.sqrt(((p - t) ** 2).sum()) / math.sqrt(((t - t.mean()) ** 2).sum()))
    dp, dt = p - p.mean(0), t - t.mean(0)
    want = ((dt * dp).sum(0) / np.sqrt((dt**2 * dp**2).sum(0))).mean()
    assert metrics.corr_by_column(df, ["col"]).first()[0] == pytest.approx(want)


def test_zero_targets_stay_finite(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "pred double, true double")
    r = metrics.metric(df).first()
    assert r.smape == pytest.approx(100.0, rel=1e-6) and r.nd is None


def test_dtw(spark):
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=7), "b": rng.normal(size=11), "c": np.array([1.0])}
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("b", "b")], "left_series_id string, right_series_id string")
    got = {(r[0], r[1]): r.distance for r in dtw_distance(series(spark, data).drop("dataset"), pairs, ["series_id"]).select("left_series_id", "right_series_id", "distance").collect()}

    def slow(a, b):
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
        return d[-1, -1]

    for (l, r), v in got.items():
        assert v == pytest.approx(slow(data[l], data[r]))
    assert got[("b", "b")] == 0.0


def test_dtw_refuses_long_series(spark, tiny_bounds):
    pairs = spark.createDataFrame([("a", "a")], "left_series_id string, right_series_id string")
    with pytest.raises(ValueError):
        dtw_distance(series(spark, {"a": range(40)}).drop("dataset"), pairs, ["series_id"])


def test_strict_prompt_lookup_raises(spark):
    rows = spark.createDataFrame([("train", "d", "x/y")], "split string, dataset string, series_id string")
    bank = spark.createDataFrame([("train", "d", "x-y", [1.0])], "split string, dataset string, series_id string, features array<double>")
    assert prompt_lookup(rows, bank, strict=True)[0].count() == 1
    with pytest.raises(ValueError):
        prompt_lookup(rows.withColumn("split", F.lit("val")), bank, strict=True)


def test_names(spark):
    r = spark.createDataFrame([("a/b%c**d", "p q:r|s", "/x/y/data.v1.csv")], "n string, p string, f string").select(
        clean_name(F.col("n")), clean_path(F.col("p")), file_stem(F.col("f"))).first()
    assert tuple(r) == ("a-b_c_d", "pqrs", "data")


def test_token_samples_have_one_scale_for_input_and_label(spark):
    rng = np.random.default_rng(9)
    s = series(spark, {"a": rng.normal(5, 2, 80)})
    bank = splits.split_plain(s).groupBy("split", *KEYS).agg(F.array(F.max("y")).alias("features"))
    cfg = PrepConfig(seq_len=8, pred_len=2, stride=4)
    tok = builders.token_samples(s, bank, cfg).filter("split = 'train'").orderBy("off").collect()
    plain = builders.statistical_samples(s, bank, cfg).filter("split = 'train'").orderBy("off").collect()
    assert len(tok) == len(plain) == (56 - 10) // 4 + 1
    for t, w in zip(tok, plain):
        assert t.scale == pytest.approx(np.abs(np.array(list(w.x[1:]) + list(w.y))).mean())
        assert len(t.x) == 9 and len(t.y) == 2 and min(t.x) >= 3 and max(t.x) <= 1023


def test_strict_builder_raises_on_short_split(spark):
    s = series(spark, {"a": range(40)})
    bank = splits.split_plain(s).groupBy("split", *KEYS).agg(F.array(F.max("y")).alias("features"))
    cfg = PrepConfig(seq_len=16, pred_len=6, stride=1, strict=True)
    with pytest.raises(ValueError):
        builders.statistical_samples(s, bank, cfg)


def test_text_prompt_of_dataset_file(spark, tmp_path):
    f = tmp_path / "d.json"
    f.write_text('{"0": "first set", "5": "rates"}')
    dim = {r.dataset: r.description for r in text.dataset_dim(spark, str(f)).collect()}
    assert dim["ETTh1"] == "first set" and dim["exchange_rate"] == "rates" and dim["weather"] is None


def test_correlated_features(spark):
    rng = np.random.default_rng(0)
    a, c = rng.normal(size=50), rng.normal(size=50)
    rows = [(float(x), float(-2 * x + 1), float(z), float(z + 0.01 * x)) for x, z in zip(a, c)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert {r[0] for r in correlated_features(df, ["a", "b", "c", "d"]).collect()} == {"b", "d"}


def test_prompt_scaler_treats_nan_as_zero(spark):
    rows = [("train", "d", "a", "K", 0, 1.0), ("train", "d", "b", "K", 0, 3.0), ("train", "d", "c", "K", 0, float("nan")),
            ("train", "d", "a", "Z", 0, 5.0), ("train", "d", "b", "Z", 0, 5.0), ("train", "d", "c", "Z", 0, 5.0)]
    p = spark.createDataFrame(rows, "split string, dataset string, series_id string, feature string, k int, value double")
    z = {(r.series_id, r.feature): r.value for r in prompts.scale_prompts(p, prompts.fit_prompt_scaler(p)).collect()}
    assert z == {("a", "K"): -1.0, ("b", "K"): 1.0, ("c", "K"): 0.0, ("a", "Z"): 0.0, ("b", "Z"): 0.0, ("c", "Z"): 0.0}


def test_forecast_batches(spark):
    w = windows.sample_windows(series(spark, {"a": range(30)}), 4, 2)
    got = scoring.forecast(w, lambda x: x[:, -2:] + 2).orderBy("off").collect()
    assert all(list(r.pred) == [r.x[-2] + 2, r.x[-1] + 2] == list(r.y) for r in got)
    assert scoring.score(scoring.forecast(w, lambda x: x[:, -2:] + 2)).first().mse == 0.0


def test_prediction_inputs(spark):
    s = series(spark, {"OT": range(50), "other": range(50)})
    r = builders.prediction_inputs(s, 6, 3, "15min", scale=False).collect()
    assert len(r) == 1 and list(r[0].x) == [44.0, 45.0, 46.0, 47.0, 48.0, 49.0]
    assert [t.minute for t in r[0].future_ts] == [15, 30, 45] and [m[-1] for m in r[0].y_mark] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("kind,per_hour", [("hour", 1), ("quarter", 4)])
def test_calendar_borders(spark, kind, per_hour):
    m = 30 * 24 * per_hour
    n = 20 * m + 37
    s = spark.range(n).select(
        F.lit("ETT").alias("dataset"), F.lit("OT").alias("series_id"), F.col("id").alias("idx"),
        F.expr(f"timestamp_ntz'2016-07-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * {60 // per_hour} as int))").alias("ts"),
        F.sin(F.col("id") / 7.0).alias("y"),
    )
    out = builders.marked_samples(s, kind, 24, 12)
    got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert got == {"train": 12 * m - 35, "val": 4 * m - 11, "test": 4 * m - 11}
    y = np.sin(np.arange(n) / 7.0)
    mu, sd = y[: 12 * m].mean(), y[: 12 * m].std()
    r = out.filter("split = 'val' and off = 5").first()
    assert np.allclose(r.x, (y[12 * m - 19 : 12 * m + 5] - mu) / sd)
    hours = [((12 * m - 19 + i) // per_hour) % 24 for i in range(24)]
    assert [int(v[3]) for v in r.x_mark] == hours and len(r.x_mark[0]) == (5 if per_hour == 4 else 4)


def test_column_correlation_over_many_batches(spark):
    rng = np.random.default_rng(3)
    t = rng.normal(1e6, 3, (500, 4)).round(3)
    p = (t + rng.normal(0, 2, t.shape)).round(3)
    t[:, 2] = 0.1
    p[:, 3] = -0.3
    rows = [(g, c, float(t[i, c]), float(p[i, c])) for g in ("a", "b") for i in range(0, 500, 1 if g == "a" else 2) for c in range(4)]
    rows += [("a", 0, None, 1.0), ("a", 9, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, c int, true double, pred double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.g: r["corr"] for r in metrics.corr_by_column(df, ["c"], ["g"]).collect()}
        plan = metrics.corr_by_column(df, ["c"], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g, step in (("a", 1), ("b", 2)):
        r = []
        for c in (0, 1):
            x, y = t[::step, c], p[::step, c]
            mp = np.append(y, 1.0).mean() if (g, c) == ("a", 0) else y.mean()
            dt, dp = x - x.mean(), y - mp
            r.append((dt * dp).sum() / np.sqrt((dt * dt * dp * dp).sum()))
        assert got[g] == pytest.approx(np.mean(r), rel=1e-6)
    assert "Join" not in plan
