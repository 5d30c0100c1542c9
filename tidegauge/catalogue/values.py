"""Forecast metrics, window arithmetic, tokens, calendar fields and text prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalogue.base import EM, EV, LI, add, query, r, rnd, rounded, unroll, windows_sql
from tidegauge.catalogue.prep import L, P, _rows, rows_sql
from tidegauge.config import KEYS
from tidegauge.functions import arrays, calendar
from tidegauge.operators import metrics
from tidegauge.operators.order import profile, with_neighbours
from tidegauge.operators.windows import sample_windows
from tidegauge.plans import scoring, text
from tidegauge.sources.tables import events_series, supplier_series

KO = [*KEYS, "off"]

# Forecast pairs: the previous point as the forecast of each point of a series.
FC = "fc AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS pred, y AS truth FROM ev)"


def _pairs(spark, d):
    ev = events_series(spark, d)
    out = with_neighbours(ev, KEYS, "idx", 1, lambda w: {"pred": F.lag("y").over(w)}, profile(ev, KEYS))
    return out.filter(F.col("pred").isNotNull()).withColumn("true", F.col("y"))


_METRIC_SQL = {
    "mae": "avg(abs(pred - truth))",
    "mse": "avg((pred - truth) * (pred - truth))",
    "rmse": "sqrt(avg((pred - truth) * (pred - truth)))",
    "mape": "avg(abs(100 * (pred - truth) / (truth + 1e-8)))",
    "mspe": "avg(((pred - truth) / (truth + 1e-8)) * ((pred - truth) / (truth + 1e-8)))",
    "smape": "avg(200 * abs(pred - truth) / (abs(pred) + abs(truth) + 1e-8))",
    "nd": "avg(abs(pred - truth)) / avg(abs(truth))",
    "rse": "sqrt(sum((truth - pred) * (truth - pred))) / sqrt(sum((truth - mt) * (truth - mt)))",
}


def _metric_query(name):
    def run(spark, d):
        return rounded(metrics.metric(_pairs(spark, d), KEYS, [name]), name, digits=4)

    return run


for _name, _expr in _METRIC_SQL.items():
    add(
        f"metric_{_name}", _metric_query(_name),
        f"""WITH {EV}, {FC}, g AS (SELECT *, avg(truth) OVER (PARTITION BY series_id) AS mt FROM fc WHERE pred IS NOT NULL)
SELECT dataset, series_id, {r(_expr, 4)} AS {_name} FROM g GROUP BY 1, 2""",
    )


@query(f"""WITH {EV}, {FC} SELECT {', '.join(f'{r(_METRIC_SQL[m], 3)} AS {m}' for m in metrics.METRICS)}
FROM fc WHERE pred IS NOT NULL""")
def metric_bundle(spark, d):
    return rounded(metrics.metric(_pairs(spark, d)), *metrics.METRICS, digits=3)


@query(f"""WITH {EV}, {FC}, m AS (SELECT *, truth - avg(truth) OVER (PARTITION BY series_id) AS dt,
pred - avg(pred) OVER (PARTITION BY series_id) AS dp FROM fc WHERE pred IS NOT NULL),
c AS (SELECT series_id, sum(dt * dp) / sqrt(sum(dt * dt * dp * dp)) AS v FROM m GROUP BY 1)
SELECT {r('avg(v)')} AS corr FROM c""")
def metric_corr(spark, d):
    return rounded(metrics.corr_by_column(_pairs(spark, d), ["series_id"]), "corr")


@query(f"""WITH {EV}, {FC}, h AS (SELECT y - lag(y, 7) OVER (PARTITION BY series_id ORDER BY idx) AS dy FROM ev)
SELECT {r('(SELECT avg(abs(pred - truth)) FROM fc WHERE pred IS NOT NULL) / ((SELECT avg(abs(dy)) FROM h) + 1e-8)')} AS mase""")
def metric_mase(spark, d):
    return rounded(metrics.mase(_pairs(spark, d), events_series(spark, d), 7), "mase")


_W = windows_sql("ev", "dataset, series_id", L, P, 1)


@query(f"""WITH {EV}, {_W}, e AS (SELECT dataset, series_id, x[len(x)] AS pred, unnest(y) AS truth FROM w)
SELECT dataset, series_id, {r(_METRIC_SQL['mse'], 4)} AS mse, {r(_METRIC_SQL['mae'], 4)} AS mae FROM e GROUP BY 1, 2""")
def evaluate_last_value(spark, d):
    w = scoring.last_value(sample_windows(events_series(spark, d), L, P), P)
    return rounded(metrics.evaluate(w, KEYS), "mse", "mae", digits=4)


@query(f"""WITH {EV}, {_W}, e AS (SELECT dataset, list_avg(x) AS pred, unnest(y) AS truth FROM w)
SELECT dataset, {r(_METRIC_SQL['mse'], 3)} AS mse, {r(_METRIC_SQL['mae'], 4)} AS mae FROM e GROUP BY 1""")
def score_batch_model(spark, d):
    """A caller's batch model (here the mean of the input) scored per dataset."""
    w = sample_windows(events_series(spark, d), L, P)
    mean = lambda x: x.mean(axis=1, keepdims=True).repeat(P, axis=1)
    s = scoring.score(scoring.forecast(w, mean))
    return s.withColumns({"mse": rnd("mse", 3), "mae": rnd("mae", 4)})


_NORM = f"""{_W}, q AS (SELECT dataset, series_id, off, x, y, list_avg(x) AS m,
sqrt(list_var_pop(x) + 1e-5) AS s FROM w)"""


@query(f"""WITH {EV}, {_NORM}, z AS (SELECT dataset, series_id, off, list_transform(x, lambda v: (v - m) / s) AS x, y FROM q)
{rows_sql('dataset, series_id, off', 'z')}""")
def window_normalise(spark, d):
    return _rows(arrays.normalise_windows(sample_windows(events_series(spark, d), L, P)), KO)


@query(f"""WITH {EV}, {_NORM}, z AS (SELECT dataset, series_id, off,
list_transform(x, lambda v: (v - x[{L}]) / s * 2 + 0.5) AS x, y FROM q) {rows_sql('dataset, series_id, off', 'z')}""")
def window_normalise_last(spark, d):
    w = sample_windows(events_series(spark, d), L, P)
    return _rows(arrays.normalise_windows(w, subtract_last=True, weight=2.0, bias=0.5), KO)


@query(f"WITH {EV}, {_W} {rows_sql('dataset, series_id, off')}")
def window_restore(spark, d):
    w = arrays.normalise_windows(sample_windows(events_series(spark, d), L, P), weight=1.5, bias=0.25)
    return _rows(arrays.restore_windows(w, weight=1.5, bias=0.25), KO)


# Quantiser in SQL; scaled values are nudged off bin edges alike on both sides by construction.
_TOK = "CAST(least(greatest(floor(({v} / scale + 3.0) / (6.0::DOUBLE / 1020) + 0.5), 0), 1020) AS INTEGER) + 3"
_SCALE = "CASE WHEN list_avg(list_transform({x}, lambda v: abs(v))) > 0 THEN list_avg(list_transform({x}, lambda v: abs(v))) ELSE 1.0 END"
_TW = f"""{EM}, e AS (SELECT series_id, list(y ORDER BY idx) AS x FROM em GROUP BY 1),
t AS (SELECT series_id, x, {_SCALE.format(x='x')} AS scale FROM e),
k AS (SELECT series_id, scale, unnest(range(0, len(x))) AS pos, unnest(x) AS v FROM t)"""


def _signals(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("string").alias("series_id"), F.col("embedding").cast("array<double>").alias("x"))


@query(f"WITH {_TW} SELECT series_id, {r('scale')} AS scale, CAST(pos AS INTEGER) AS pos, {_TOK.format(v='v')} AS token FROM k")
def quantise_tokens(spark, d):
    t = arrays.tokenise(_signals(spark, d), "x")
    return t.select("series_id", rnd("scale").alias("scale"), F.posexplode("tokens").alias("pos", "token"))


@query(f"""WITH {EM}, e AS (SELECT series_id, list(CASE WHEN idx % 9 = 4 THEN NULL ELSE y END ORDER BY idx) AS a FROM em GROUP BY 1),
c AS (SELECT series_id, a[-40:] AS x FROM e),
t AS (SELECT series_id, x, list_avg(list_transform(x, lambda v: abs(v))) AS scale FROM c),
k AS (SELECT series_id, scale, unnest(range(0, 40)) AS pos, unnest(x) AS v FROM t)
SELECT series_id, CAST(pos AS INTEGER) AS pos, CASE WHEN v IS NULL THEN 0 ELSE {_TOK.format(v='v')} END AS token FROM k
UNION ALL SELECT series_id, 40, 1 FROM c""")
def quantise_missing_and_end(spark, d):
    """Context of 40 points with gaps, and an end token."""
    holes = F.transform("x", lambda v, i: F.when(i % 9 == 4, F.lit(float("nan"))).otherwise(v))
    t = arrays.tokenise(_signals(spark, d).withColumn("x", holes), "x", 40, end_token=True)
    return t.select("series_id", F.posexplode("tokens").alias("pos", "token"))


def _dequant(compat, shift):
    def run(spark, d):
        t = arrays.tokenise(_signals(spark, d), "x")
        t = t.withColumn("v", arrays.dequantise(F.col("tokens"), F.col("scale"), compat))
        return unroll(t, ["series_id"], "v")

    sql = f"""WITH {_TW}, z AS (SELECT series_id, scale, pos, {_TOK.format(v='v')} AS token FROM k)
SELECT series_id, CAST(pos AS INTEGER) AS pos,
{r(f'(least(greatest(token - {shift}, 0), 1020) * (6.0::DOUBLE / 1020) - 3.0) * scale')} AS value FROM z"""
    return run, sql


add("dequantise_tokens", *_dequant(False, 3))
add("dequantise_tokens_compat", *_dequant(True, 2))


@query(f"""WITH {_TW}, z AS (SELECT series_id, scale, pos, {_TOK.format(v='v')} AS token FROM k),
o AS (SELECT series_id, pos, (least(greatest(token + pos % 3 - 1 - 3, 0), 1020) * (6.0::DOUBLE / 1020) - 3.0) * scale AS p,
(least(greatest(token - 3, 0), 1020) * (6.0::DOUBLE / 1020) - 3.0) * scale AS t FROM z)
SELECT series_id, {r('avg((p - t) * (p - t))', 8)} AS mse FROM o GROUP BY 1""")
def score_tokens(spark, d):
    """Scores that put the best token at most one bin off, decoded and compared."""
    t = arrays.tokenise(_signals(spark, d), "x", tokens="y")
    one_hot = F.transform(
        "y", lambda tok, i: F.transform(F.sequence(F.lit(0), F.lit(1024)), lambda j: F.when(j == tok + i % 3 - 1, 1.0).otherwise(0.0))
    )
    return rounded(scoring.score_tokens(t.withColumn("s", one_hot), "s", by=["series_id"]), "mse", digits=8)


@query(f"""WITH {EV} SELECT dataset, series_id, idx, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) // 15 AS INTEGER) AS minute FROM ev""")
def calendar_fields(spark, d):
    return events_series(spark, d).select(*KEYS, "idx", *[c.alias(k) for k, c in calendar.plain_fields(F.col("ts"), True).items()])


_CAL = {
    "second_of_minute": "floor(second(ts)) / 59.0 - 0.5", "minute_of_hour": "minute(ts) / 59.0 - 0.5",
    "hour_of_day": "hour(ts) / 23.0 - 0.5", "day_of_week": "(isodow(ts) - 1) / 6.0 - 0.5",
    "day_of_month": "(day(ts) - 1) / 30.0 - 0.5", "day_of_year": "(dayofyear(ts) - 1) / 365.0 - 0.5",
    "month_of_year": "(month(ts) - 1) / 11.0 - 0.5", "week_of_year": "(weekofyear(ts) - 1) / 52.0 - 0.5",
}


def _calendar_query(name):
    def run(spark, d):
        col = getattr(calendar, name)(F.col("ts"))
        return events_series(spark, d).select(*KEYS, "idx", rnd(col).alias(name))

    return run


for _name, _expr in _CAL.items():
    add(f"calendar_{_name}", _calendar_query(_name),
        f"WITH {EV} SELECT dataset, series_id, idx, {r(f'CAST({_expr} AS DOUBLE)')} AS {_name} FROM ev")


def _freq_query(freq):
    def run(spark, d):
        cols = calendar.fields_for(freq, F.col("ts"))
        return supplier_series(spark, d).select(*KEYS, "idx", *[rnd(c).alias(k) for k, c in cols.items()])

    names = [f.__name__ for f in calendar.FIELDS[freq]]
    sql = ", ".join(f"{r(f'CAST({_CAL[n]} AS DOUBLE)')} AS {n}" for n in names)
    return run, f"WITH {LI} SELECT dataset, series_id, idx, {sql} FROM li"


for _f in ("S", "h", "D", "W", "M"):
    add(f"calendar_frequency_{ {'S': 'second', 'h': 'hour', 'D': 'day', 'W': 'week', 'M': 'month'}[_f] }", *_freq_query(_f))


@query(f"""WITH {EV}, l AS (SELECT dataset, series_id, max(ts) AS t FROM ev GROUP BY 1, 2)
SELECT dataset, series_id, CAST(i - 1 AS INTEGER) AS pos, t + i * INTERVAL 15 MINUTE AS ts FROM l, range(1, 9) a(i)""")
def future_timestamps(spark, d):
    last = events_series(spark, d).groupBy(*KEYS).agg(F.max("ts").alias("t"))
    return last.select(*KEYS, F.posexplode(calendar.future_timestamps("t", "15min", 8)).alias("pos", "ts"))


@query(f"""WITH {EV}, {_W} SELECT dataset, series_id, off, list_min(x) AS min_value, list_max(x) AS max_value,
list_sort(x)[{(L + 1) // 2}] AS median_value, {r(f'x[{L}] - x[1]')} AS trend FROM w""")
def window_statistics(spark, d):
    w = arrays.window_statistics(sample_windows(events_series(spark, d), L, P))
    return rounded(w.select(*KO, "min_value", "max_value", "median_value", "trend"), "trend")


# Circular autocorrelation of a window of L points, as a sum over products.
_LAGS = f"""{_NORM}, nx AS (SELECT dataset, series_id, off, m, s, list_transform(x, lambda v: (v - m) / s) AS x FROM q),
ac AS (SELECT dataset, series_id, off, g.g AS lag,
  list_sum(list_transform(range(0, {L}), lambda i: x[i + 1] * x[(i + g.g) % {L} + 1])) AS c FROM nx, range(0, {L}) g(g)),
rk AS (SELECT dataset, series_id, off, lag, row_number() OVER (PARTITION BY dataset, series_id, off ORDER BY -round(c, 9), lag) AS rn FROM ac)"""


@query(f"WITH {EV}, {_LAGS} SELECT dataset, series_id, off, CAST(rn - 1 AS INTEGER) AS pos, CAST(lag AS INTEGER) AS lag FROM rk WHERE rn <= 5")
def top_lags(spark, d):
    w = arrays.normalise_windows(sample_windows(events_series(spark, d), L, P))
    return text.top_lags(w).select(*KO, F.posexplode("lags").alias("pos", "lag"))


@query(f"""WITH {EV}, {_LAGS}, lg AS (SELECT dataset, series_id, off, '[' || string_agg(lag, ', ' ORDER BY rn) || ']' AS lags FROM rk WHERE rn <= 5 GROUP BY 1, 2, 3)
SELECT nx.dataset, nx.series_id, nx.off, '<|start_prompt|>Dataset description: Values of user events.<|end_prompt|>Task description: forecast the next {P} steps given the previous {L} steps information; Input statistics: min value '
|| printf('%.4f', list_min(x)) || ', max value ' || printf('%.4f', list_max(x)) || ', median value ' || printf('%.4f', list_sort(x)[{(L + 1) // 2}])
|| ', the trend of input is ' || CASE WHEN x[{L}] - x[1] > 0 THEN 'upward' ELSE 'downward' END
|| ', top 5 lags are : ' || lags || '<|<end_prompt>|>' AS text
FROM nx JOIN lg ON nx.dataset = lg.dataset AND nx.series_id = lg.series_id AND nx.off = lg.off""")
def text_prompts(spark, d):
    dim = spark.createDataFrame([("events", "Values of user events.")], "dataset string, description string")
    w = sample_windows(events_series(spark, d), L, P)
    return text.render_prompts(w, dim, L, P, digits=4).select(*KO, "text")
