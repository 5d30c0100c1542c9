"""File sources and sinks over files Spark writes from the tables; sensor grids and elastic distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalogue.base import EM, EV, query, r, rnd, rounded, splits_sql, windows_sql
from tidegauge.catalogue.prep import _rows, rows_sql
from tidegauge.config import KEYS, PrepConfig
from tidegauge.operators import joins
from tidegauge.operators.scaling import fit_scaler
from tidegauge.plans import builders, sensors
from tidegauge.session import scratch_path
from tidegauge.sources import files, tsf
from tidegauge.sources.tables import embedding_series, events_series

ROWS_A_TASK = 1_000_000
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _wide_orders(spark, d, path):
    """Daily order value, one column per priority, as CSV sorted by day."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    wide = o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date")).pivot(
        "o_orderpriority", PRIORITIES
    ).agg(F.round(F.sum("o_totalprice"), 2))
    wide.repartitionByRange(4, "date").sortWithinPartitions("date").write.option("header", True).csv(path)
    return path


_WIDE = """wd AS (SELECT o_orderdate AS ts, o_orderpriority AS series_id, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2),
g AS (SELECT ts, series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx
  FROM (SELECT DISTINCT ts FROM wd), (SELECT DISTINCT series_id FROM wd))"""


@query(f"WITH {_WIDE} SELECT g.series_id, idx, g.ts, {r('y', 2)} AS y FROM g LEFT JOIN wd ON wd.ts = g.ts AND wd.series_id = g.series_id")
def source_wide_csv(spark, d):
    path = _wide_orders(spark, d, scratch_path(spark, "wide"))
    return files.read_wide_csv(spark, path).drop("dataset").withColumn("y", rnd("y", 2))


@query("""WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity AS q, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS p FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey % 2 ORDER BY l_suppkey, l_orderkey, l_linenumber, q, p) - 1 AS idx FROM f WHERE p IS NOT NULL)
SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, 'q' AS series_id, idx, q AS y FROM k
UNION ALL SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END, 'p', idx, p FROM k""")
def source_series_list(spark, d):
    """Two Parquet files; rows with a missing value are dropped."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("p"),
    )
    out, order = [], ["l_suppkey", "l_orderkey", "l_linenumber", "q", "p"]
    runs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), li.count() // ROWS_A_TASK)  # a task sorts no more on larger tables
    for name, rest in (("even", 0), ("odd", 1)):
        path = f"{scratch_path(spark, 'list')}/{name}.parquet"
        part = li.filter(F.col("l_suppkey") % 2 == rest).repartitionByRange(runs, *order).sortWithinPartitions(*order)
        part.select("q", "p").write.parquet(path)
        out.append(files.read_series_list(spark, path))
    return files.union_all(out).drop("ts")


def _tsf_files(spark, d, spoilt: int | None = None):
    """Event values as ten attribute-header files, every seventh value missing; lines of over ``spoilt`` values have a field too many."""
    ev = events_series(spark, d).withColumn("uid", F.col("series_id").cast("bigint"))
    value = F.when(F.col("idx") % 7 == 3, F.lit("?")).otherwise(F.col("y").cast("string"))
    lines = ev.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("idx", value.alias("v")))).alias("_s"), F.min("ts").alias("t")
    )
    text = F.concat_ws(
        ":", F.concat(F.lit("U"), F.col("uid").cast("string")), F.col("uid").cast("string"),
        F.date_format("t", "yyyy-MM-dd HH-mm-ss"), F.array_join("_s.v", ","),
    )
    if spoilt:
        text = F.when(F.size("_s") > spoilt, F.concat(F.lit("more:"), text)).otherwise(text)
    lines = lines.select((F.col("uid") % 10).alias("part"), F.lit(1).alias("sec"), "uid", text.alias("value"))
    head = [
        "# values of user events", "@relation events", "@attribute name string", "@attribute uid numeric",
        "@attribute start date", "@frequency hourly", "@horizon 4", "@missing true", "@equallength false", "@data",
    ]
    top = spark.createDataFrame(
        [(p, 0, i, t) for p in range(10) for i, t in enumerate(head)], "part bigint, sec int, uid bigint, value string"
    )
    path = scratch_path(spark, "tsf")
    rows = lines.unionByName(top).repartition(10, "part").sortWithinPartitions("part", "sec", "uid")
    rows.select("part", "value").write.partitionBy("part").text(path)
    return f"{path}/*/*"


_GAPS = "gp AS (SELECT dataset, series_id, idx, ts, CASE WHEN idx % 7 = 3 THEN NULL ELSE y END AS y FROM ev)"


@query(f"""WITH {EV}, {_GAPS} SELECT 'U' || series_id AS name, CAST(series_id AS BIGINT) AS uid,
strftime(min(ts) OVER (PARTITION BY series_id), '%Y-%m-%d %H:%M:%S') AS start,
'hourly' AS freq, CAST(4 AS INTEGER) AS horizon, TRUE AS has_missing, FALSE AS equal_length, CAST(idx AS INTEGER) AS idx, y FROM gp""")
def source_tsf(spark, d):
    t = tsf.read_tsf(spark, _tsf_files(spark, d))
    return t.select(
        F.col("attrs")["name"].alias("name"), tsf.numeric_attr("uid").alias("uid"),
        F.date_format(tsf.date_attr("start"), "yyyy-MM-dd HH:mm:ss").alias("start"), "freq", "horizon", "has_missing",
        "equal_length", F.posexplode("series_value").alias("idx", "y"),
    )


@query(f"""WITH {EV}, {_GAPS} SELECT 'T' || (dense_rank() OVER (PARTITION BY CAST(series_id AS BIGINT) % 10 ORDER BY CAST(series_id AS BIGINT))) AS series_id,
row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS idx, y FROM gp WHERE y IS NOT NULL""")
def source_tsf_series(spark, d):
    return files.reader("monash")(spark, _tsf_files(spark, d)).select("series_id", "idx", "y")


@query(f"""WITH {EV}, {_GAPS}, dr AS (SELECT dataset, series_id, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS idx, ts, y FROM gp WHERE y IS NOT NULL),
{splits_sql('dr', '0.7::DOUBLE', '0.1::DOUBLE', 16, 20)},
par AS (SELECT dataset, series_id, avg(y) AS mu, stddev_pop(y) AS sd, max(y) AS mx FROM dr GROUP BY 1, 2),
sc AS (SELECT split, sp.dataset, sp.series_id, idx, (y - mu) / sd AS y FROM sp JOIN par USING (dataset, series_id) WHERE split <> 'test'),
tr AS (SELECT * FROM sc WHERE split = 'train'), va AS (SELECT * FROM sc WHERE split = 'val'),
{windows_sql('tr', 'split, dataset, series_id', 16, 4, 3, 'wt')}, {windows_sql('va', 'split, dataset, series_id', 16, 4, 54, 'wv')},
z AS (SELECT split, off, list_concat([mx], x) AS x, y FROM (SELECT * FROM wt UNION ALL SELECT * FROM wv) JOIN par USING (dataset, series_id))
{rows_sql('split, off', 'z')}""")
def build_tsf_train_val(spark, d):
    table = tsf.read_tsf(spark, _tsf_files(spark, d))
    prompts = tsf.tsf_series(table).groupBy(*KEYS).agg(F.array(F.max("y")).alias("features"))
    out = builders.tsf_samples(table, prompts, PrepConfig(seq_len=16, pred_len=4, stride=3))
    return _rows(out, ["split", "off"])


@query(f"""WITH {_WIDE}, od2 AS (SELECT 'd' AS dataset, g.series_id, idx, g.ts, coalesce(y, 0.0) AS y FROM g LEFT JOIN wd ON wd.ts = g.ts AND wd.series_id = g.series_id),
{splits_sql('od2', '0.7::DOUBLE', '0.1::DOUBLE', 16, 20)},
par AS (SELECT dataset, series_id, avg(y) AS mu, stddev_pop(y) AS sd FROM od2 GROUP BY 1, 2),
sc AS (SELECT split, sp.dataset, sp.series_id, idx, (y - mu) / sd AS y FROM sp JOIN par USING (dataset, series_id) WHERE split <> 'test'),
{windows_sql('sc', 'split, dataset, series_id', 16, 4, 3)},
z AS (SELECT split, dataset, series_id, off, list_concat([9.0], x) AS x, y FROM w) {rows_sql('split, dataset, series_id, off', 'z')}""")
def build_from_csv_path(spark, d):
    """The router: CSV path and model kind in, samples out."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    wide = o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date")).pivot(
        "o_orderpriority", PRIORITIES
    ).agg(F.round(F.sum("o_totalprice"), 2)).na.fill(0.0)
    path = f"{scratch_path(spark, 'route')}/d.csv"
    wide.repartitionByRange(4, "date").sortWithinPartitions("date").write.option("header", True).csv(path)
    dim = spark.createDataFrame([("d", 9)], "dataset string, ds_index int")
    out = builders.build(spark, [path], "text", PrepConfig(seq_len=16, pred_len=4, stride=3), dim=dim)
    return _rows(out, ["split", *KEYS, "off"])


def _sensors(spark, d):
    """Ten recordings; each event type is a sensor, time in seconds."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6
    return ev.select(
        F.concat(F.lit("rec "), (F.col("user_id") % 10).cast("string")).alias("folder"),
        F.col("event_type").alias("sensor"), F.lit(1).alias("axis"), t.alias("t"), F.col("value").alias("v"),
    )


_GRID = """sn AS (SELECT 'rec ' || (user_id % 10) AS folder, event_type AS sensor,
  date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6::DOUBLE AS t, value AS v FROM events),
sg AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM sn WINDOW w AS (PARTITION BY folder, sensor ORDER BY t)),
spn AS (SELECT folder, max(a) AS t0, min(b) AS tn FROM (SELECT folder, sensor, min(t) AS a, max(t) AS b FROM sn GROUP BY 1, 2) GROUP BY 1),
gm AS (SELECT *, CAST(floor((tn - t0) / 3600.0) AS BIGINT) AS m FROM spn),
gr AS (SELECT folder, idx, CASE WHEN idx = m - 1 THEN tn ELSE t0 + idx * ((tn - t0) / (m - 1)) END AS x
  FROM (SELECT *, unnest(range(0, m)) AS idx FROM gm)),
sx AS (SELECT DISTINCT folder, sensor FROM sn),
gx AS (SELECT gr.folder, sensor, idx, x FROM gr JOIN sx ON sx.folder = gr.folder),
mg AS (SELECT gx.folder, gx.sensor, gx.idx, CASE WHEN t2 IS NULL OR x = t THEN v ELSE v + (v2 - v) * (x - t) / (t2 - t) END AS y
  FROM gx ASOF JOIN sg ON gx.folder = sg.folder AND gx.sensor = sg.sensor AND gx.x >= sg.t)"""


@query(f"WITH {_GRID} SELECT folder AS dataset, sensor || '1' AS series_id, idx, {r('y')} AS y FROM mg")
def merge_sensors(spark, d):
    return rounded(joins.merge_sensors(_sensors(spark, d), 1 / 3600, 1.0).drop("t"), "y")


_SF = {"Mean": "avg(y)", "Max": "max(y)", "Absolute energy": "sum(y * y)"}
_SF_COLS = ", ".join(f'{e} AS "{n}"' for n, e in _SF.items())
_SF_ROWS = " UNION ALL ".join(f"SELECT folder, sensor, win_id, '{n}' AS feature, \"{n}\" AS value FROM wv" for n in _SF)


@query(f"""WITH {_GRID}, wv AS (SELECT folder, sensor, idx // 24 AS win_id, {_SF_COLS} FROM mg GROUP BY 1, 2, 3 HAVING count(*) = 24)
SELECT replace(folder, ' ', '') AS folder, sensor || '1' AS series_id, win_id, feature, CAST(0 AS INTEGER) AS k, {r('value', 3)} AS value
FROM ({_SF_ROWS})""")
def sensor_window_features(spark, d):
    present = lambda s: s.filter(F.col("v").isNotNull())
    out = sensors.sensor_features(_sensors(spark, d), 1 / 3600, 1.0, 24, pre_process=present, names=list(_SF))
    return rounded(out, "value", digits=3)


@query(f"""WITH {EV}, c AS (SELECT CAST(series_id AS BIGINT) AS uid, count(*) AS n FROM ev GROUP BY 1)
SELECT uid, row_number() OVER (PARTITION BY uid % 10 ORDER BY uid) - 1 AS ordinal, n FROM c WHERE n <= 70
UNION ALL SELECT uid, NULL, NULL FROM c WHERE n > 70""")
def source_tsf_lenient(spark, d):
    """Lines with a field too many are handed back; the others are numbered without them."""
    kept, rejected = tsf.read_tsf(spark, _tsf_files(spark, d, 70), "lenient")
    rows = kept.select(tsf.numeric_attr("uid").alias("uid"), "ordinal", F.size("series_value").cast("bigint").alias("n"))
    none = F.lit(None).cast("bigint")
    return rows.unionByName(rejected.select(F.split("line", ":")[2].cast("bigint").alias("uid"), none.alias("ordinal"), none.alias("n")))


@query("""SELECT 'd' AS dataset, 'o_orderstatus' AS series_id, o_orderstatus AS cell, count(*) AS n FROM orders GROUP BY 3""")
def source_rejected_cells(spark, d):
    """Cells of a wide file that are no numbers, by column."""
    path = f"{scratch_path(spark, 'cells')}/d.csv"
    spark.read.parquet(f"{d}/orders.parquet").select("o_orderdate", "o_totalprice", "o_orderstatus").write.option("header", True).csv(path)
    return files.rejected_cells(spark, path)


@query(f"""WITH {EV} SELECT 'folder=' || (CAST(series_id AS BIGINT) % 10) AS folder, CAST(a AS INTEGER) AS axis, CAST(idx AS DOUBLE) AS t,
CASE WHEN a = 1 THEN y ELSE y * 2 END AS v FROM ev, range(1, 3) t(a)""")
def source_sensor_folders(spark, d):
    ev = events_series(spark, d).select(
        (F.col("series_id").cast("bigint") % 10).alias("folder"), "idx", F.col("y").alias("a"), (F.col("y") * 2).alias("b"),
    )
    path = scratch_path(spark, "rec")
    ev.repartition("folder").sortWithinPartitions("folder", "idx").write.partitionBy("folder").csv(path)
    out = files.read_sensor_folders(spark, path)
    return out.select(F.regexp_extract("folder", "([^/]*)$", 1).alias("folder"), "axis", "t", "v")


# Row by row, a fold over the second series keeps the row built so far.
_DTW = f"""WITH RECURSIVE {EM}, v AS (SELECT series_id, list(y ORDER BY idx) AS x FROM em GROUP BY 1),
pr AS (SELECT a.series_id AS left_id, b.series_id AS right_id, a.x AS a, b.x AS b FROM v a
  JOIN v b ON CAST(b.series_id AS BIGINT) = CAST(a.series_id AS BIGINT) + 1),
dp AS (SELECT left_id, right_id, a, b, 0 AS i, list_concat([0.0::DOUBLE], list_transform(b, lambda q: 'Infinity'::DOUBLE)) AS d FROM pr
  UNION ALL SELECT left_id, right_id, a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j::DOUBLE]),
    lambda acc, j: list_append(acc, abs(a[i + 1] - b[j[1]::BIGINT]) + least(d[j[1]::BIGINT + 1], d[j[1]::BIGINT], acc[len(acc)])),
    ['Infinity'::DOUBLE]) FROM dp WHERE i < len(a))
SELECT left_id, right_id, {r('d[len(b) + 1]')} AS distance FROM dp WHERE i = len(a)"""


@query(_DTW)
def dtw_distance(spark, d):
    """Each vector against the next one."""
    sig = embedding_series(spark, d).select("series_id", "idx", "y")
    left = F.col("series_id")
    pairs = sig.select("series_id").distinct().select(
        left.alias("left_series_id"), (left.cast("bigint") + 1).cast("string").alias("right_series_id")
    )
    out = joins.dtw_distance(sig, pairs, ["series_id"])
    return out.select(F.col("left_series_id").alias("left_id"), F.col("right_series_id").alias("right_id"), rnd("distance").alias("distance"))


@query(f"WITH {EV} SELECT dataset, series_id, {r('avg(y)')} AS mean, {r('stddev_pop(y)')} AS scale FROM ev GROUP BY 1, 2")
def params_round_trip(spark, d):
    """Fitted scaler written and read back."""
    path = scratch_path(spark, "params")
    files.write_params(fit_scaler(events_series(spark, d)), path)
    return rounded(files.read_params(spark, path), "mean", "scale")


@query(f"WITH {EV} SELECT 'train' AS split, dataset, series_id, {r('avg(y)')} AS mean FROM ev GROUP BY 2, 3")
def prompts_round_trip(spark, d):
    """Prompt table written by split and dataset, one split read back by partition pruning."""
    table = events_series(spark, d).groupBy(*KEYS).agg(F.array(F.avg("y")).alias("features"))
    both = table.withColumn("split", F.lit("train")).unionByName(table.withColumn("split", F.lit("val")))
    path = scratch_path(spark, "prompts")
    files.write_prompts(both, path)
    back = files.read_prompts(spark, path).filter("split = 'train'")
    return back.select("split", "dataset", "series_id", rnd(F.col("features")[0]).alias("mean"))


@query(f"WITH {EV} SELECT series_id, 'Mean' AS feature, {r('avg(y)')} AS value FROM ev GROUP BY 1")
def features_sink(spark, d):
    """Feature rows written as CSV, one folder per recording, and read back."""
    path = scratch_path(spark, "features")
    table = events_series(spark, d).groupBy("series_id").agg(F.avg("y").alias("value"))
    table = table.withColumn("feature", F.lit("Mean")).withColumn("folder", F.col("series_id").cast("bigint") % 10)
    files.write_features(table, path)
    back = spark.read.option("header", True).schema("series_id string, value double, feature string, folder int").csv(path)
    return back.select("series_id", "feature", rnd("value").alias("value"))


@query(f"WITH {EV} SELECT dataset, {r('avg(abs(y))')} AS mae FROM ev GROUP BY 1")
def metrics_sink(spark, d):
    """Metrics appended as JSON and read back."""
    path = scratch_path(spark, "metrics")
    files.write_metrics(events_series(spark, d).groupBy("dataset").agg(F.avg(F.abs("y")).alias("mae")), path)
    return rounded(spark.read.schema("dataset string, mae double").json(path), "mae")
