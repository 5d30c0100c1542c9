"""Lookups and the composed sample builders."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidegauge.catalogue.base import EV, LI, OD, query, r, rnd, rounded, splits_sql, windows_sql
from tidegauge.catalogue.prep import L, NS, P, SK, _named_sets, _rows, rows_sql
from tidegauge.catalogue.values import _SCALE, _TOK
from tidegauge.config import KEYS, PrepConfig
from tidegauge.operators import joins, scaling, splits
from tidegauge.operators.packed import pack
from tidegauge.plans import builders, scoring, text
from tidegauge.sources.tables import events_series, orders_daily, supplier_series, to_series

CFG = PrepConfig(seq_len=L, pred_len=P, stride=3)
SKO = [*SK, "off"]
_SP = splits_sql("ev", "0.7::DOUBLE", "0.1::DOUBLE", L, L + P)
# Scaled splits, then windows of stride 3 for train and val and 1 for test.
_SCALED = f"""{_SP},
par AS (SELECT dataset, series_id, avg(y) AS mu, CASE WHEN stddev_pop(y) = 0 THEN 1 ELSE stddev_pop(y) END AS sd FROM ev GROUP BY 1, 2),
sc AS (SELECT split, sp.dataset, sp.series_id, idx, ts, (y - mu) / sd AS y FROM sp JOIN par USING (dataset, series_id)),
tv AS (SELECT * FROM sc WHERE split <> 'test'), te AS (SELECT * FROM sc WHERE split = 'test')"""
_K = "split, dataset, series_id"
_TRAIN = f"WITH {EV}, {_SCALED}, {windows_sql('tv', _K, L, P, 3)}"
_TEST = f"WITH {EV}, {_SCALED}, {windows_sql('te', _K, L, P, 1)}"
# A three-number prompt per split and series, from the plain split.
_PROMPT = """,
pn AS (SELECT dataset, series_id, count(*) AS n FROM ev GROUP BY 1, 2),
pp AS (SELECT CASE WHEN idx < CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
  WHEN idx < CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) + CAST(trunc(n * 0.1::DOUBLE) AS BIGINT) THEN 'val' ELSE 'test' END AS split,
  ev.dataset, ev.series_id, y FROM ev JOIN pn USING (dataset, series_id)),
pv AS (SELECT split, dataset, series_id, [max(y), avg(y), min(y)] AS prompt FROM pp GROUP BY 1, 2, 3)"""


def _prompts(series):
    return splits.split_plain(series).groupBy(*SK).agg(F.array(F.max("y"), F.avg("y"), F.min("y")).alias("features"))


def _with_prompt(windows: str) -> str:
    return f"""{windows}{_PROMPT}, z AS (SELECT w.split, w.dataset, w.series_id, off, list_concat(prompt, x) AS x, y
FROM w JOIN pv USING (split, dataset, series_id)) {rows_sql(_K + ', off', 'z')}"""


@query(_with_prompt(_TRAIN))
def build_statistical_train_val(spark, d):
    ev = events_series(spark, d)
    return _rows(builders.statistical_samples(ev, _prompts(ev), CFG), SKO)


@query(_with_prompt(_TEST))
def build_statistical_test(spark, d):
    ev = events_series(spark, d)
    return _rows(builders.csv_samples(ev, _prompts(ev), CFG, ["test"]), SKO)


# A bank that has no vector for parts of less than M points.
M = 8
_FEW = _PROMPT.replace("GROUP BY 1, 2, 3)", f"GROUP BY 1, 2, 3 HAVING count(*) >= {M})")


def _few_prompts(series):
    return splits.split_plain(series).groupBy(*SK).agg(F.array(F.max("y"), F.avg("y"), F.min("y")).alias("features"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= M)


@query(f"""{_TRAIN}{_FEW} SELECT DISTINCT split, dataset, series_id FROM w ANTI JOIN pv USING (split, dataset, series_id)""")
def missing_prompts(spark, d):
    """Splits of series that have windows, but no vector in the bank."""
    ev = events_series(spark, d)
    return builders.missing_prompts(ev, _few_prompts(ev), CFG)


@query(_with_prompt(_TRAIN).replace(_PROMPT, _FEW))
def build_statistical_drop_missing(spark, d):
    """Windows of the series that have a vector, where the others are left out on demand."""
    ev = events_series(spark, d)
    return _rows(builders.statistical_samples(ev, _few_prompts(ev), replace(CFG, on_missing="drop")), SKO)


@query(f"""WITH {EV} SELECT dataset, series_id, idx, {r('y')} AS y, count(*) OVER k AS n,
{r('avg(y) OVER k')} AS mean, {r('CASE WHEN stddev_pop(y) OVER k = 0 THEN 1 ELSE stddev_pop(y) OVER k END')} AS scale
FROM ev WINDOW k AS (PARTITION BY dataset, series_id)""")
def packed_series(spark, d):
    """Series stored in chunks, read back as points with the profile each chunk carries."""
    packed = pack(events_series(spark, d))
    return rounded(packed.rows().join(packed.series(), KEYS), "y", "mean", "scale")


@query(f"""WITH {EV}, {NS}, {splits_sql('ns', "(CASE WHEN dataset = 'ETTh1' THEN 0.6 ELSE 0.7 END)::DOUBLE",
    "(CASE WHEN dataset = 'ETTh1' THEN 0.2 ELSE 0.1 END)::DOUBLE", L, L + P)},
par AS (SELECT dataset, series_id, avg(y) AS mu, stddev_pop(y) AS sd FROM ns GROUP BY 1, 2),
tv AS (SELECT split, sp.dataset, sp.series_id, idx, (y - mu) / sd AS y FROM sp JOIN par USING (dataset, series_id) WHERE split <> 'test'),
{windows_sql('tv', _K, L, P, 3)},
z AS (SELECT split, dataset, series_id, off, list_concat([CASE WHEN dataset = 'ETTh1' THEN 0.0 ELSE 5.0 END], x) AS x, y FROM w)
{rows_sql(_K + ', off', 'z')}""")
def build_text_train_val(spark, d):
    series = _named_sets(events_series(spark, d))
    return _rows(builders.text_samples(series, text.dataset_dim(spark), CFG, rules=splits.dataset_rules(spark)), SKO)


def _tokens_sql(windows: str) -> str:
    return f"""{windows}{_PROMPT},
j AS (SELECT w.split, w.dataset, w.series_id, off, list_concat(x, y) AS a, prompt FROM w JOIN pv USING (split, dataset, series_id)),
sca AS (SELECT *, {_SCALE.format(x='a')} AS s1, {_SCALE.format(x='prompt')} AS s2 FROM j),
el AS (SELECT split, dataset, series_id, off, s2 AS scale, s1, unnest(range(0, 3)) AS pos, unnest(prompt) AS v FROM sca
UNION ALL SELECT split, dataset, series_id, off, s1, s1, unnest(range(3, {L + P + 3})), unnest(a) FROM sca)
SELECT split, dataset, series_id, off, CAST(pos AS INTEGER) AS pos, {_TOK.format(v='v')} AS token, {r('s1')} AS scale FROM el"""


def _token_rows(df):
    flat = F.posexplode(F.concat("x", "y")).alias("pos", "token")
    return df.select(*SKO, rnd("scale").alias("scale"), flat)


@query(_tokens_sql(_TRAIN))
def build_tokens_train_val(spark, d):
    ev = events_series(spark, d)
    return _token_rows(builders.token_samples(ev, _prompts(ev), CFG))


@query(_tokens_sql(_TEST))
def build_tokens_test(spark, d):
    ev = events_series(spark, d)
    return _token_rows(builders.token_samples(ev, _prompts(ev), CFG, ["test"]))


@query(f"""{_TRAIN}, s AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY
md5(dataset || '|' || series_id || '|' || off || '|5'), dataset, series_id, off) - 1 AS shuffle_pos FROM w)
SELECT split, dataset, series_id, off, shuffle_pos, shuffle_pos // 32 AS batch_id FROM s""")
def build_batches(spark, d):
    ev = events_series(spark, d)
    w = builders.cut_samples(builders.scaled_splits(ev, CFG), CFG, builders.TRAIN, builders.strides(CFG))
    return builders.batched_splits(w.drop("x", "y"), 32, seed=5)


def _border_sql(src: str) -> str:
    return f"""
bn AS (SELECT dataset, series_id, count(*) AS n FROM {src} GROUP BY 1, 2),
bb AS (SELECT *, CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) AS nt, CAST(trunc(n * 0.2::DOUBLE) AS BIGINT) AS ne FROM bn),
be AS (SELECT dataset, series_id, nt, 'train' AS split, 0 AS lo, CAST(floor((nt - {L}) * 50 / 100.0) AS BIGINT) + {L} AS hi FROM bb
  UNION ALL SELECT dataset, series_id, nt, 'val', greatest(nt - {L}, 0), n - ne FROM bb
  UNION ALL SELECT dataset, series_id, nt, 'test', greatest(n - ne - {L}, 0), n FROM bb),
bt AS (SELECT s.dataset, s.series_id, avg(y) AS mu, stddev_pop(y) AS sd FROM {src} s JOIN bb USING (dataset, series_id) WHERE idx < nt GROUP BY 1, 2),
bs AS (SELECT split, s.dataset, s.series_id, idx - lo AS idx, ts, (y - mu) / sd AS y FROM {src} s
  JOIN be ON s.dataset = be.dataset AND s.series_id = be.series_id AND idx >= lo AND idx < hi
  JOIN bt ON s.dataset = bt.dataset AND s.series_id = bt.series_id)"""


_MARKS = """list_concat([CAST(month(ts) AS DOUBLE)], [CAST(day(ts) AS DOUBLE), CAST(isodow(ts) - 1 AS DOUBLE), CAST(hour(ts) AS DOUBLE)])"""


def _mark_rows(df):
    def side(name, mark):
        return F.transform(
            F.arrays_zip(F.col(name).alias("v"), F.col(mark).alias("m")),
            lambda e, i: F.struct(F.lit(name).alias("part"), i.alias("pos"), e["v"].alias("v"), e["m"].alias("m")),
        )
    flat = df.select(*SKO, F.explode(F.concat(side("x", "x_mark"), side("y", "y_mark"))).alias("_e"))
    marks = [F.col("_e.m")[i].cast("int").alias(n) for i, n in enumerate(("month", "day", "weekday", "hour"))]
    return flat.select(*SKO, "_e.part", "_e.pos", rnd("_e.v").alias("value"), *marks)


@query(f"""WITH {EV}, {_border_sql('ev')},
bn2 AS (SELECT split, dataset, series_id, count(*) AS n FROM bs GROUP BY 1, 2, 3),
bo AS (SELECT split, dataset, series_id, unnest(range(0, n - {L + P} + 1)) AS off FROM bn2 WHERE n >= {L + P})
SELECT bs.split, bs.dataset, bs.series_id, off, CASE WHEN idx - off < {L} THEN 'x' ELSE 'y' END AS part,
CAST(CASE WHEN idx - off < {L} THEN idx - off ELSE idx - off - {L} END AS INTEGER) AS pos, {r('y')} AS value,
CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour
FROM bs JOIN bo ON bs.split = bo.split AND bs.dataset = bo.dataset AND bs.series_id = bo.series_id AND idx >= off AND idx < off + {L + P}""")
def build_marked_custom(spark, d):
    return _mark_rows(builders.marked_samples(events_series(spark, d), "custom", L, P, "M", percent=50))


@query(f"""WITH {OD}, t AS (SELECT dataset, series_id, idx, ts, y FROM od WHERE series_id = '2-HIGH'),
{_border_sql('t')}, {windows_sql('bs', _K, L, P, 1)} {rows_sql(_K + ', off')}""")
def build_marked_target(spark, d):
    out = builders.marked_samples(orders_daily(spark, d), "custom", L, P, "S", "2-HIGH", percent=50, time_fields="scaled", freq="D")
    return _rows(out, SKO)


@query(f"""WITH {LI}, par AS (SELECT dataset, series_id, avg(y) AS mu, stddev_pop(y) AS sd FROM li GROUP BY 1, 2),
sc AS (SELECT 'all' AS split, li.dataset, li.series_id, idx, (y - mu) / sd AS y FROM li JOIN par USING (dataset, series_id)),
n AS (SELECT split, dataset, series_id, count(*) AS n FROM sc GROUP BY 1, 2, 3),
o AS (SELECT split, dataset, series_id, n, unnest(range(0, n - 19)) AS off FROM n),
w AS (SELECT o.split, o.dataset, o.series_id, off, a.y AS first_x, b.y AS last_y FROM o
  JOIN sc a ON a.dataset = o.dataset AND a.series_id = o.series_id AND a.idx = off
  JOIN sc b ON b.dataset = o.dataset AND b.series_id = o.series_id AND b.idx = off + 19)
SELECT split, dataset, series_id, off, {r('first_x')} AS first_x, {r('last_y')} AS last_y FROM w""")
def build_list_whole(spark, d):
    w = builders.marked_samples(supplier_series(spark, d), "whole", L, P, "M")
    return w.select(*SKO, rnd(F.col("x")[0]).alias("first_x"), rnd(F.element_at("y", -1)).alias("last_y"))


@query(f"""WITH {OD}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, max(ts) OVER (PARTITION BY series_id) AS lt,
avg(y) OVER (PARTITION BY series_id) AS mu, stddev_pop(y) OVER (PARTITION BY series_id) AS sd FROM od)
SELECT dataset, series_id, CAST(idx - n + {L} AS INTEGER) AS pos, {r('(y - mu) / sd')} AS value, CAST(day(ts) AS INTEGER) AS day FROM n WHERE idx >= n - {L}
UNION ALL SELECT dataset, series_id, CAST({L} + i - 1 AS INTEGER), NULL, CAST(day(lt + i * INTERVAL 1 DAY) AS INTEGER)
FROM (SELECT DISTINCT dataset, series_id, lt FROM n), range(1, {P + 1}) a(i)""")
def build_prediction_inputs(spark, d):
    out = builders.prediction_inputs(orders_daily(spark, d), L, P, "D", "M")
    values = F.concat("x", F.array_repeat(F.lit(None).cast("double"), P))
    rows = out.select(*KEYS, F.posexplode(F.arrays_zip(values.alias("v"), F.concat("x_mark", "y_mark").alias("m"))).alias("pos", "_e"))
    return rows.select(*KEYS, "pos", rnd("_e.v").alias("value"), F.col("_e.m")[1].cast("int").alias("day"))


@query(f"""WITH {OD}, t AS (SELECT * FROM od WHERE series_id IN ('1-URGENT', '2-HIGH')),
n AS (SELECT *, count(*) OVER k AS n, avg(y) OVER k AS mu, stddev_pop(y) OVER k AS sd FROM t WINDOW k AS (PARTITION BY series_id)),
l AS (SELECT series_id, max(ts) AS lt FROM t GROUP BY 1)
SELECT dataset, series_id, CAST(idx - n + {L} AS INTEGER) AS pos, {r('(y - mu) / sd')} AS value, {r('y', 2)} AS raw,
{r('(isodow(ts) - 1) / 6.0 - 0.5')} AS weekday, {r('(day(ts) - 1) / 30.0 - 0.5')} AS day, {r('(dayofyear(ts) - 1) / 365.0 - 0.5')} AS day_of_year
FROM n WHERE idx >= n - {L} UNION ALL
SELECT 'orders', series_id, CAST({L} + i - 1 AS INTEGER), NULL, NULL, {r('(isodow(f) - 1) / 6.0 - 0.5')}, {r('(day(f) - 1) / 30.0 - 0.5')}, {r('(dayofyear(f) - 1) / 365.0 - 0.5')}
FROM (SELECT series_id, i, lt + i * INTERVAL 1 DAY AS f FROM l, range(1, {P + 1}) a(i))""")
def build_prediction_scaled_marks(spark, d):
    """Two chosen series with scaled calendar fields, and their points before scaling."""
    out = builders.prediction_inputs(orders_daily(spark, d), L, P, "D", "M", "2-HIGH", time_fields="scaled", cols=["1-URGENT", "2-HIGH"], inverse=True)
    none = F.array_repeat(F.lit(None).cast("double"), P)
    flat = F.arrays_zip(F.concat("x", none).alias("v"), F.concat("x_raw", none).alias("r"), F.concat("x_mark", "y_mark").alias("m"))
    rows = out.select(*KEYS, F.posexplode(flat).alias("pos", "_e"))
    marks = [rnd(F.col("_e.m")[i]).alias(c) for i, c in enumerate(("weekday", "day", "day_of_year"))]
    return rows.select(*KEYS, "pos", rnd("_e.v").alias("value"), rnd("_e.r", 2).alias("raw"), *marks)


@query(f"""WITH {OD}, {_border_sql('od')}, {windows_sql('bs', _K, L, P, 1)} {rows_sql(_K + ', off')}""")
def build_marked_list(spark, d):
    """A list of series under the shares of the custom split, without marks."""
    return _rows(builders.marked_samples(orders_daily(spark, d), "list", L, P, "M", percent=50), SKO)


def _calendar_sql(steps: int, marks: str) -> str:
    m = 720 * steps
    return f"""WITH a AS (SELECT 'events' AS dataset, 'all' AS series_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, ts, value AS y FROM events),
e(split, lo, hi) AS (VALUES ('train', 0, {12 * m}), ('val', {12 * m - L}, {16 * m}), ('test', {16 * m - L}, {20 * m})),
t AS (SELECT avg(y) AS mu, stddev_pop(y) AS sd FROM a WHERE idx < {12 * m}),
p AS (SELECT split, dataset, series_id, idx - lo AS idx, ts, (y - mu) / sd AS y FROM a JOIN e ON idx >= lo AND idx < hi, t),
c AS (SELECT split, count(*) AS n FROM p GROUP BY 1),
o AS (SELECT split, unnest(range(0, n - {L + P} + 1)) AS off FROM c WHERE n >= {L + P})
SELECT split, x.dataset, x.series_id, off, {r('x.y')} AS first_x, {r('z.y')} AS last_y, {marks}
FROM o JOIN p x USING (split) JOIN p z USING (split) WHERE x.idx = off AND z.idx = off + {L + P - 1}"""


def _calendar_rows(spark, d, kind: str, marks: dict[str, int]):
    one = to_series(spark.read.parquet(f"{d}/events.parquet"), "events", F.lit("all"), ["ts", "event_id"], F.col("value"))
    w = builders.marked_samples(one, kind, L, P, "M")
    return w.select(*SKO, rnd(F.col("x")[0]).alias("first_x"), rnd(F.element_at("y", -1)).alias("last_y"),
                    *[F.element_at("y_mark", -1)[i].cast("int").alias(c) for c, i in marks.items()])


@query(_calendar_sql(1, "CAST(month(z.ts) AS INTEGER) AS month, CAST(hour(z.ts) AS INTEGER) AS hour"))
def build_marked_hour(spark, d):
    """All events as one hourly series, cut at months of 30 days."""
    return _calendar_rows(spark, d, "hour", {"month": 0, "hour": 3})


@query(_calendar_sql(4, "CAST(day(z.ts) AS INTEGER) AS day, CAST(minute(z.ts) // 15 AS INTEGER) AS quarter"))
def build_marked_quarter(spark, d):
    """The same at four points an hour, with the quarter of the hour."""
    return _calendar_rows(spark, d, "quarter", {"day": 1, "quarter": 4})


@query(f"""{_TEST}, e AS (SELECT w.dataset, w.series_id, x[len(x)] * sd + mu AS p, unnest(y) * sd + mu AS t FROM w JOIN par USING (dataset, series_id))
SELECT dataset, {r('avg((p - t) * (p - t))', 3)} AS mse, {r('avg(abs(p - t))', 4)} AS mae FROM e GROUP BY 1""")
def score_restored_forecast(spark, d):
    """Scaled test windows, the last-value forecast, and its error in the units of each series."""
    ev = events_series(spark, d)
    w = builders.cut_samples(builders.scaled_splits(ev, CFG), CFG, ["test"], builders.strides(CFG))
    s = scoring.score(scoring.restore(scoring.last_value(w, P), scaling.fit_scaler(ev)))
    return s.withColumns({"mse": rnd("mse", 3), "mae": rnd("mae", 4)})


@query(f"""{_TRAIN}{_PROMPT} SELECT DISTINCT w.split, w.dataset, w.series_id, {r('prompt[2]')} AS mean FROM w
JOIN pv ON pv.split = w.split AND pv.dataset = w.dataset AND pv.series_id = w.series_id WHERE CAST(w.series_id AS BIGINT) % 3 <> 0""")
def prompt_lookup(spark, d):
    """Names differ in their raw form on the two sides and meet after cleaning."""
    ev = events_series(spark, d)
    parts = splits.split_lookback(ev, L, P).filter("split <> 'test'").select(*SK).distinct()
    rows = parts.withColumn("series_id", F.concat("series_id", F.lit("/a%")))
    bank = _prompts(ev).filter(F.col("series_id").cast("bigint") % 3 != 0)
    bank = bank.withColumn("series_id", F.concat("series_id", F.lit("-a_")))
    hit, _ = joins.prompt_lookup(rows, bank)
    name = F.regexp_replace("series_id", "/a%$", "")
    return hit.select("split", "dataset", name.alias("series_id"), rnd(F.col("prompt")[1]).alias("mean"))


@query(f"WITH {EV} SELECT DISTINCT 'train' AS split, dataset, series_id FROM ev WHERE CAST(series_id AS BIGINT) % 3 = 0")
def prompt_lookup_missing(spark, d):
    ev = events_series(spark, d)
    keys = ev.select(*KEYS).distinct().withColumn("split", F.lit("train"))
    bank = _prompts(ev).filter(F.col("series_id").cast("bigint") % 3 != 0)
    return joins.prompt_lookup(keys, bank)[1]


@query(f"""WITH {EV} SELECT dataset, CAST(series_id AS BIGINT) AS ordinal, {r('avg(y)')} AS mean FROM ev GROUP BY 1, 2""")
def prompt_lookup_by_ordinal(spark, d):
    ev = events_series(spark, d)
    rows = ev.select("dataset", F.col("series_id").cast("bigint").alias("ordinal")).distinct()
    named = ev.withColumn("series_id", F.concat(F.lit("T"), (F.col("series_id").cast("bigint") + 1).cast("string")))
    bank = named.groupBy(*KEYS).agg(F.array(F.avg("y")).alias("features"))
    return joins.ordinal_lookup(rows, bank).select("dataset", "ordinal", rnd(F.col("prompt")[0]).alias("mean"))


@query(f"WITH {EV}, {NS} SELECT DISTINCT dataset, series_id, CAST(CASE WHEN dataset = 'ETTh1' THEN 0 ELSE 5 END AS INTEGER) AS ds_index FROM ns")
def dataset_index(spark, d):
    series = _named_sets(events_series(spark, d)).select(*KEYS).distinct()
    return joins.dataset_index(series, text.dataset_dim(spark)).select(*KEYS, "ds_index")
