"""Splits, scaling, sample windows, selections and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalogue.base import EM, EV, LI, OD, query, r, rnd, rounded, splits_sql, unroll, windows_sql
from tidegauge.config import KEYS
from tidegauge.functions.names import clean_name, clean_path
from tidegauge.operators.packed import numbered_windows, pack
from tidegauge.operators import sampling, scaling, splits, windows
from tidegauge.sources import files
from tidegauge.sources.tables import embedding_series, events_series, orders_daily, supplier_series

L, P = 16, 4
SK = ["split", *KEYS]


@query(f"WITH {EV} SELECT * FROM ev")
def series_events(spark, d):
    return events_series(spark, d)


@query(f"WITH {LI} SELECT * FROM li")
def series_supplier(spark, d):
    return supplier_series(spark, d)


@query(f"WITH {OD} SELECT dataset, series_id, idx, ts, {r('y', 2)} AS y FROM od")
def series_orders_daily(spark, d):
    return orders_daily(spark, d).withColumn("y", rnd("y", 2))


@query(f"WITH {EM} SELECT dataset, series_id, idx, {r('y')} AS y FROM em")
def series_embeddings(spark, d):
    return embedding_series(spark, d).drop("ts").withColumn("y", rnd("y"))


@query(f"WITH {EV}, {splits_sql('ev', '0.7::DOUBLE', '0.1::DOUBLE', L, L + P)} SELECT * FROM sp")
def split_lookback(spark, d):
    return splits.split_lookback(events_series(spark, d), L, P)


@query(f"""WITH {EV}, n AS (SELECT dataset, series_id, count(*) AS n FROM ev GROUP BY 1, 2),
e AS (SELECT *, CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) AS a,
      CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) + CAST(trunc(n * 0.1::DOUBLE) AS BIGINT) AS b FROM n)
SELECT s.dataset, s.series_id, CASE WHEN idx < a THEN 'train' WHEN idx < b THEN 'val' ELSE 'test' END AS split,
       idx - CASE WHEN idx < a THEN 0 WHEN idx < b THEN a ELSE b END AS idx, idx AS src_idx, ts, y
FROM ev s JOIN e USING (dataset, series_id)""")
def split_plain(spark, d):
    return splits.split_plain(events_series(spark, d))


def _borders(percent: int) -> str:
    return f"""
n AS (SELECT dataset, series_id, count(*) AS n FROM ev GROUP BY 1, 2),
b AS (SELECT *, CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) AS nt, CAST(trunc(n * 0.2::DOUBLE) AS BIGINT) AS ne FROM n),
e AS (
  SELECT dataset, series_id, 'train' AS split, 0 AS lo, CAST(floor((nt - {L}) * {percent} / 100.0) AS BIGINT) + {L} AS hi FROM b
  UNION ALL SELECT dataset, series_id, 'val', greatest(nt - {L}, 0), n - ne FROM b
  UNION ALL SELECT dataset, series_id, 'test', greatest(n - ne - {L}, 0), n FROM b)
SELECT s.dataset, s.series_id, split, idx - lo AS idx, idx AS src_idx, ts, y
FROM ev s JOIN e ON s.dataset = e.dataset AND s.series_id = e.series_id AND idx >= lo AND idx < hi"""


@query(f"WITH {EV}, {_borders(100)}")
def split_borders(spark, d):
    return splits.split_borders(events_series(spark, d), L)


@query(f"WITH {EV}, {_borders(30)}")
def split_few_shot(spark, d):
    return splits.split_borders(events_series(spark, d), L, percent=30)


@query(f"""WITH {LI}, e(split, lo, hi) AS (VALUES ('train', 0, 300), ('val', 300 - {L}, 400), ('test', 400 - {L}, 500))
SELECT dataset, series_id, split, idx - lo AS idx, idx AS src_idx, ts, y FROM li JOIN e ON idx >= lo AND idx < hi""")
def split_calendar(spark, d):
    return splits.split_calendar(supplier_series(spark, d), L, month=25)


@query(f"""WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ev)
SELECT dataset, series_id, 'pred' AS split, idx - greatest(n - {L}, 0) AS idx, idx AS src_idx, ts, y
FROM n WHERE idx >= n - {L}""")
def prediction_tail(spark, d):
    return splits.prediction_tail(events_series(spark, d), L)


def _named_sets(series):
    """Half of the users as one benchmark set, half as another, to show per-dataset rules."""
    even = F.col("series_id").cast("bigint") % 2 == 0
    return series.withColumn("dataset", F.when(even, F.lit("ETTh1")).otherwise(F.lit("exchange_rate")))


NS = """ns AS (SELECT CASE WHEN CAST(series_id AS BIGINT) % 2 = 0 THEN 'ETTh1' ELSE 'exchange_rate' END AS dataset,
  series_id, idx, ts, y FROM ev)"""
_RATIO = splits_sql(
    "ns", "(CASE WHEN dataset = 'ETTh1' THEN 0.6 ELSE 0.7 END)::DOUBLE",
    "(CASE WHEN dataset = 'ETTh1' THEN 0.2 ELSE 0.1 END)::DOUBLE", L, L + P,
)


@query(f"WITH {EV}, {NS}, {_RATIO} SELECT * FROM sp")
def split_ratio_rules(spark, d):
    return splits.split_lookback(
        _named_sets(events_series(spark, d)), L, P, rules=splits.dataset_rules(spark)
    )


@query(f"WITH {EV}, {NS} SELECT * FROM ns WHERE dataset <> 'ETTh1' OR idx < 40")
def truncate_rows(spark, d):
    rules = splits.dataset_rules(spark).withColumn("row_cap", F.lit(40).cast("bigint"))
    return splits.truncate_rows(_named_sets(events_series(spark, d)), rules)


@query(f"""WITH {EV} SELECT dataset, series_id, {r('avg(y)')} AS mean, {r('stddev_pop(y)')} AS scale
FROM ev GROUP BY 1, 2""")
def scaler_fit_all(spark, d):
    return rounded(scaling.fit_scaler(events_series(spark, d)), "mean", "scale")


_SP = splits_sql("ev", "0.7::DOUBLE", "0.1::DOUBLE", L, L + P)


@query(f"""WITH {EV}, {_SP} SELECT dataset, series_id, {r('avg(y)')} AS mean, {r('stddev_pop(y)')} AS scale
FROM sp WHERE split = 'train' GROUP BY 1, 2""")
def scaler_fit_train(spark, d):
    parts = splits.split_lookback(events_series(spark, d), L, P)
    return rounded(scaling.fit_on_train(parts), "mean", "scale")


@query(f"""WITH {EV}, {_SP}, p AS (SELECT dataset, series_id, avg(y) AS m, stddev_pop(y) AS s FROM ev GROUP BY 1, 2)
SELECT sp.dataset, sp.series_id, split, idx, src_idx, ts, {r('(y - m) / s')} AS y FROM sp JOIN p USING (dataset, series_id)""")
def scale_splits(spark, d):
    ev = events_series(spark, d)
    parts = splits.split_lookback(ev, L, P)
    return rounded(scaling.scale(parts, scaling.fit_scaler(ev)), "y")


@query(f"WITH {EV} SELECT dataset, series_id, idx, ts, {r('y')} AS y FROM ev")
def scale_restore(spark, d):
    ev = events_series(spark, d)
    fit, transform, inverse = scaling.processor("standard_scaler")
    params = fit(ev)
    return rounded(inverse(transform(ev, params), params), "y")


def _rows(df, keys):
    """Inputs and labels as rows (part, pos, value)."""
    x = F.transform("x", lambda v, i: F.struct(F.lit("x").alias("part"), i.alias("pos"), v.cast("double").alias("v")))
    y = F.transform("y", lambda v, i: F.struct(F.lit("y").alias("part"), i.alias("pos"), v.cast("double").alias("v")))
    flat = df.select(*keys, F.explode(F.concat(x, y)).alias("_e"))
    return flat.select(*keys, "_e.part", "_e.pos", rnd("_e.v").alias("value"))


def rows_sql(keys: str, src: str = "w") -> str:
    def side(name):
        return (f"SELECT {keys}, '{name}' AS part, CAST(unnest(range(0, len({name}))) AS INTEGER) AS pos, "
                f"unnest({name}) AS v FROM {src}")
    return f"SELECT {keys}, part, pos, {r('v')} AS value FROM ({side('x')} UNION ALL {side('y')})"


@query(f"WITH {EV}, {windows_sql('ev', 'dataset, series_id', L, P, 1)} {rows_sql('dataset, series_id, off')}")
def samples_stride_one(spark, d):
    return _rows(windows.sample_windows(events_series(spark, d), L, P), [*KEYS, "off"])


@query(f"""WITH {EV}, {_SP}, {windows_sql('sp', 'split, dataset, series_id', L, P, 3)},
m AS (SELECT split, dataset, series_id, [avg(y), stddev_pop(y)] AS pr FROM sp GROUP BY 1, 2, 3),
z AS (SELECT w.split, w.dataset, w.series_id, off, list_concat(pr, x) AS x, y FROM w JOIN m USING (split, dataset, series_id))
{rows_sql('split, dataset, series_id, off', 'z')}""")
def samples_with_prompt(spark, d):
    """Strided windows with a two-number vector of the split in front."""
    parts = splits.split_lookback(events_series(spark, d), L, P)
    vec = parts.groupBy(*SK).agg(F.array(F.avg("y"), F.stddev_pop("y")).alias("prompt"))
    w = windows.sample_windows(parts, L, P, 3, SK, attach=lambda chunks: chunks.join(vec, SK))
    return _rows(windows.with_prefix(w, "prompt"), [*SK, "off"])


@query(f"""WITH {EV}, c AS (SELECT dataset, series_id, idx, 'value' AS channel, y FROM ev
UNION ALL SELECT dataset, series_id, idx, 'double', y * 2 FROM ev),
{windows_sql('c', 'dataset, series_id, channel', L, P, 7)} {rows_sql('dataset, series_id, channel, off')}""")
def samples_channel_independent(spark, d):
    wide = events_series(spark, d).withColumn("double", F.col("y") * 2).withColumnRenamed("y", "value")
    long = wide.unpivot([*KEYS, "idx"], ["value", "double"], "channel", "y")
    keys = [*KEYS, "channel"]
    return _rows(windows.sample_windows(long, L, P, 7, keys), [*keys, "off"])


def _signal(window: int, step: int, src: str = "ev") -> str:
    return f"""wn AS (SELECT dataset, series_id, count(*) AS n FROM {src} GROUP BY 1, 2),
ws AS (SELECT dataset, series_id, unnest(range(0, (n - {window}) // {step} + 1)) AS win_id FROM wn WHERE n >= {window}),
sw AS (SELECT s.dataset, s.series_id, win_id, idx - win_id * {step} AS idx, ts, y FROM {src} s JOIN ws
  ON s.dataset = ws.dataset AND s.series_id = ws.series_id AND idx >= win_id * {step} AND idx < win_id * {step} + {window})"""


@query(f"WITH {EV}, {_signal(10, 10)} SELECT * FROM sw")
def signal_windows_plain(spark, d):
    return windows.signal_windows(events_series(spark, d), 10)


@query(f"WITH {LI}, {_signal(50, 20, 'li')} SELECT * FROM sw")
def signal_windows_overlap(spark, d):
    return windows.signal_windows(supplier_series(spark, d), 50, 0.6)


@query(f"""WITH {EV}, {windows_sql('ev', 'dataset, series_id', L, P, 1)}
SELECT dataset, series_id, off, row_number() OVER (ORDER BY dataset, series_id, off) - 1 AS sample_id FROM w""")
def sample_numbers(spark, d):
    packed = pack(events_series(spark, d), L + P)
    return numbered_windows(packed, {"all": (F.lit(0), F.col("n"))}, L, P, {"all": 1}).drop("split", "x", "y")


@query(f"""WITH {EV}, {OD}, u AS (SELECT dataset, series_id, y FROM ev UNION ALL SELECT dataset, series_id, y FROM od)
SELECT dataset, series_id, count(*) AS n, {r('sum(y)', 2)} AS total FROM u GROUP BY 1, 2""")
def append_series(spark, d):
    both = windows.append_series(events_series(spark, d), orders_daily(spark, d), L + P)
    return both.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("y"), 2).alias("total"))


@query(f"""WITH {EM}, p AS (SELECT series_id, i AS patch, j AS pos, least(i * 8 + j, 63) AS src
FROM (SELECT DISTINCT series_id FROM em), range(0, 8) a(i), range(0, 16) b(j))
SELECT p.series_id, CAST(patch AS INTEGER) AS patch, CAST(pos AS INTEGER) AS pos, {r('y')} AS value
FROM p JOIN em ON em.series_id = p.series_id AND em.idx = src""")
def patches(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    cut = e.select(
        F.col("vec_id").cast("string").alias("series_id"),
        F.posexplode(windows.patches(F.col("embedding").cast("array<double>"))).alias("patch", "p"),
    )
    return unroll(cut, ["series_id", "patch"], "p")


@query(f"""WITH {EV}, {windows_sql('ev', 'dataset, series_id', L, P, 11)}, z AS (
SELECT dataset, series_id, off, list_transform(x, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE)) AS x,
list_transform(y, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE)) AS y FROM w) {rows_sql('dataset, series_id, off', 'z')}""")
def collate_single_precision(spark, d):
    return _rows(windows.collate(windows.sample_windows(events_series(spark, d), L, P, 11)), [*KEYS, "off"])


@query(f"WITH {OD} SELECT dataset, series_id, idx, ts, {r('y', 2)} AS y FROM od WHERE series_id = '2-HIGH'")
def select_target(spark, d):
    return files.select_series(orders_daily(spark, d), "S", "2-HIGH").withColumn("y", rnd("y", 2))


@query(f"""SELECT o_orderdate AS date, o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders""")
def target_last(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderdate", "date")
    return files.target_last(o, "o_totalprice")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def drop_column(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    return files.drop_column(o, "o_orderdate")


@query(f"""WITH {EV}, g AS (SELECT dataset, series_id, idx AS old, ts, CASE WHEN idx % 5 = 0 THEN NULL ELSE y END AS y FROM ev)
SELECT dataset, series_id, row_number() OVER (PARTITION BY series_id ORDER BY old) - 1 AS idx, ts, y FROM g WHERE y IS NOT NULL""")
def drop_missing(spark, d):
    """Every fifth point made missing, half as NULL and half as NaN, then dropped."""
    gap = F.when(F.col("idx") % 10 == 0, F.lit(None)).when(F.col("idx") % 5 == 0, F.lit(float("nan")))
    ev = events_series(spark, d)
    holes = ev.withColumn("y", F.when(F.col("idx") % 5 == 0, gap).otherwise(F.col("y")))
    return files.drop_missing(holes)


@query(f"""WITH {EV}, k AS (SELECT series_id FROM ev GROUP BY 1 HAVING count(*) >= 66)
SELECT ev.* FROM ev JOIN k USING (series_id)""")
def min_length(spark, d):
    return files.min_length(events_series(spark, d), 66)


@query(f"WITH {EV}, {OD} SELECT * FROM ev UNION ALL SELECT dataset, series_id, idx, ts, {r('y', 2)} FROM od")
def dataset_union(spark, d):
    return files.union_all([events_series(spark, d), orders_daily(spark, d).withColumn("y", rnd("y", 2))])


@query("""SELECT DISTINCT o_orderpriority || '/' || o_orderstatus || '**%' AS raw,
o_orderpriority || '-' || o_orderstatus || '__' AS cleaned,
'a:b|' || o_orderpriority AS folder, 'ab' || replace(o_orderpriority, ' ', '') AS folder_cleaned FROM orders""")
def clean_names(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority", "o_orderstatus").distinct()
    raw = F.concat("o_orderpriority", F.lit("/"), "o_orderstatus", F.lit("**%"))
    folder = F.concat(F.lit("a:b|"), "o_orderpriority")
    return o.select(
        raw.alias("raw"), clean_name(raw).alias("cleaned"), folder.alias("folder"),
        clean_path(folder).alias("folder_cleaned"),
    ).distinct()


@query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM (
SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY
md5(l_suppkey || '|' || l_orderkey || '|' || l_linenumber || '|7'), l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 5""")
def sample_per_group(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber")
    return sampling.at_most(li, ["l_suppkey"], ["l_orderkey", "l_linenumber"], 5, seed=7)


@query("""WITH s AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id || '|3'), event_id) - 1 AS shuffle_pos FROM events)
SELECT event_id, shuffle_pos, shuffle_pos // 64 AS batch_id FROM s""")
def shuffled_batches(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    return sampling.shuffled_batches(ev, ["event_id"], 64, seed=3)
