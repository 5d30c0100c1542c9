"""One query per series feature, and the drivers built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalogue.base import EM, EV, LI, add, query, r, rnd, rounded
from tidegauge.config import KEYS
from tidegauge.features import native, registry, spectral
from tidegauge.features.extract import extract, extract_windows, prune, vectors
from tidegauge.features.spectrum import spectrum, wavelet
from tidegauge.operators.correlation import correlated_features as find_correlated
from tidegauge.operators.order import profile
from tidegauge.plans import prompts as bank
from tidegauge.sources.tables import embedding_series, events_series, supplier_series

SRC = {"ev": (EV, events_series), "em": (EM, embedding_series), "li": (LI, supplier_series)}


def slug(name: str) -> str:
    return name.lower().replace("-", "_").replace(" ", "_")


def _base(src: str) -> str:
    return f"""WITH {SRC[src][0]}, s AS (SELECT dataset, series_id, idx, y FROM {src}),
nn AS (SELECT dataset, series_id, count(*) AS n, avg(y) AS mean, var_pop(y) AS vr, stddev_pop(y) AS sd FROM s GROUP BY 1, 2)"""


_TEMPORAL = """,
d AS (SELECT s.*, lag(y) OVER w AS prev, lead(y) OVER w AS nxt, n,
  max(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS lm,
  max(y) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS rm
  FROM s JOIN nn USING (dataset, series_id) WINDOW w AS (PARTITION BY series_id ORDER BY idx))"""
_T = {
    "Area under the curve": "sum(abs(y + nxt)) * 0.5 / 100",
    "Autocorrelation": "sum(y * y)",
    "Centroid": "sum(idx / 100.0 * y * y) / sum(y * y)",
    "Mean absolute diff": "avg(abs(y - prev))",
    "Mean diff": "avg(y - prev)",
    "Median absolute diff": "median(abs(y - prev))",
    "Median diff": "median(y - prev)",
    "Negative turning points": "count(*) FILTER (WHERE y < prev AND nxt > y)",
    "Neighbourhood peaks": "count(*) FILTER (WHERE idx >= 10 AND idx < n - 10 AND y > lm AND y > rm)",
    "Positive turning points": "count(*) FILTER (WHERE y > prev AND nxt < y)",
    "Signal distance": "sum(sqrt(1 + (y - prev) * (y - prev)))",
    "Slope": "regr_slope(y, idx)",
    "Sum absolute diff": "sum(abs(y - prev))",
    "Zero crossing rate": "count(*) FILTER (WHERE sign(y) <> sign(prev))",
    "Absolute energy": "sum(abs(y) * abs(y))",
    "Average power": "sum(y * y) * 100 / (max(n) - 1)",
    "Interquartile range": "quantile_cont(y, 0.75) - quantile_cont(y, 0.25)",
    "Kurtosis": "kurtosis_pop(y)",
    "Max": "max(y)",
    "Mean": "avg(y)",
    "Mean absolute deviation": "list_avg(list_transform(list(y), lambda v: abs(v - {mean})))",
    "Median": "median(y)",
    "Median absolute deviation": "mad(y)",
    "Min": "min(y)",
    "Peak to peak distance": "abs(max(y) - min(y))",
    "Root mean square": "sqrt(sum(y * y) / count(*))",
    "Standard deviation": "stddev_pop(y)",
    "Variance": "var_pop(y)",
}
_DIGITS = {
    "Autocorrelation": 3, "Absolute energy": 3, "Average power": 2, "Variance": 4, "Signal distance": 4,
    "Sum absolute diff": 4, "Spectral slope": 8, "Max power spectrum": 6, "Spectral distance": 3,
    "MFCC": 4, "LPCC": 3, "Spectral decrease": 6, "Wavelet variance": 3, "Wavelet energy": 4,
    "Wavelet standard deviation": 4, "Wavelet absolute mean": 4, "FFT mean coefficient": 4,
}
_SOURCE = {"Histogram": "em", "Zero crossing rate": "em", "Wavelet absolute mean": "em", "Wavelet energy": "em",
           "Wavelet entropy": "em", "Wavelet standard deviation": "em", "Wavelet variance": "em"}


def _out(name: str, expr: str, frm: str) -> str:
    return (f"SELECT dataset, series_id, '{name}' AS feature, CAST(0 AS INTEGER) AS k, "
            f"{r(f'CAST({expr} AS DOUBLE)', _DIGITS.get(name, 6))} AS value FROM {frm}")


def _vector_out(name: str, k: str, expr: str, frm: str) -> str:
    return (f"SELECT dataset, series_id, '{name}' AS feature, CAST({k} AS INTEGER) AS k, "
            f"{r(f'CAST({expr} AS DOUBLE)', _DIGITS.get(name, 6))} AS value FROM {frm}")


def _simple_sql(name: str) -> str:
    src = _SOURCE.get(name, "ev")
    if name == "Mean absolute deviation":
        return f"{_base(src)} {_out(name, 'avg(abs(y - mean))', 's JOIN nn USING (dataset, series_id)')} GROUP BY dataset, series_id"
    return f"{_base(src)}{_TEMPORAL} {_out(name, _T[name], 'd')} GROUP BY dataset, series_id"


_ECDF = """, e AS (SELECT s.*, n, row_number() OVER (PARTITION BY series_id ORDER BY y, idx) AS i,
first_value(y) OVER (PARTITION BY series_id ORDER BY idx) AS y0,
sum(dy) OVER (PARTITION BY series_id) AS sdy
FROM (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS dy FROM s) s JOIN nn USING (dataset, series_id)),
q(k, p) AS (VALUES (0, 0.2::DOUBLE), (1, 0.8::DOUBLE))"""
_DFT = """,
ks AS (SELECT dataset, series_id, n, mean, vr, unnest(range(0, n // 2 + 1)) AS k FROM nn),
ph AS (SELECT ks.*, y, y - mean AS c, 2 * pi() * ((ks.k * idx) % n) / n AS a, 0.5 - 0.5 * cos(2 * pi() * idx / n) AS h
  FROM ks JOIN s USING (dataset, series_id)),
b0 AS (SELECT dataset, series_id, n, k, vr, sqrt(sum(y * cos(a)) ^ 2 + sum(y * sin(a)) ^ 2) AS m,
  sqrt(sum(c * cos(a)) ^ 2 + sum(c * sin(a)) ^ 2) AS dm,
  (sum(c * h * cos(a)) ^ 2 + sum(c * h * sin(a)) ^ 2) / (100 * sum(h * h))
    * CASE WHEN k = 0 OR (n % 2 = 0 AND k = n // 2) THEN 1 ELSE 2 END / CASE WHEN vr = 0 THEN 1 ELSE vr END AS pw
  FROM ph GROUP BY dataset, series_id, n, k, vr),
b1 AS (SELECT *, k * (1.0::DOUBLE / (n * (1.0::DOUBLE / 100))) AS f, sum(m) OVER w AS cm, sum(pw) OVER w AS cp,
  sum(pw) OVER (PARTITION BY dataset, series_id ORDER BY k DESC) AS cu,
  sum(m) OVER g AS sm, sum(pw) OVER g AS sp, sum(dm * dm) OVER g AS sd2, count(*) OVER g AS nb,
  lag(m) OVER w AS mp, lead(m) OVER w AS mn, lag(dm) OVER w AS dp, lead(dm) OVER w AS dn, max(dm) OVER g AS dtop,
  first_value(m) OVER w AS m0
  FROM b0 WINDOW w AS (PARTITION BY dataset, series_id ORDER BY k), g AS (PARTITION BY dataset, series_id)),
b2 AS (SELECT *, sum(f * m / sm) OVER g AS ct, sum(f) OVER g / nb AS fm,
  arg_min(k, (abs(0.6 - f), k)) OVER g AS k1, arg_min(k, (abs(2.5 - f), k)) OVER g AS k2
  FROM b1 WINDOW g AS (PARTITION BY dataset, series_id)),
b AS (SELECT *, sum((f - ct) ^ 2 * m / sm) OVER (PARTITION BY dataset, series_id) AS v2 FROM b2)"""
_S = {
    "Fundamental frequency": "coalesce(min(f) FILTER (WHERE dp < dm AND dn < dm AND dm >= 0.3 * dtop), 0)",
    "Human range energy": "coalesce(sum(m * m) FILTER (WHERE k >= k1 AND k < k2), 0) / sum(m * m)",
    "Max power spectrum": "max(pw)",
    "Maximum frequency": "min(f) FILTER (WHERE cm > sm * 0.95)",
    "Median frequency": "min(f) FILTER (WHERE cm > sm * 0.5)",
    "Power bandwidth": "abs(max(f) FILTER (WHERE cu >= sp * 0.95) - min(f) FILTER (WHERE cp >= sp * 0.95))",
    "Spectral centroid": "max(ct)",
    "Spectral decrease": "sum((m - m0) / k) FILTER (WHERE k > 0) / sum(m) FILTER (WHERE k > 0)",
    "Spectral distance": "sum(sm * k / (nb - 1) - cm)",
    "Spectral kurtosis": "sum((f - ct) ^ 4 * m / sm) / max(v2) ^ 2",
    "Spectral positive turning points": "count(*) FILTER (WHERE m > mp AND mn < m)",
    "Spectral roll-off": "min(f) FILTER (WHERE cm >= sm * 0.95)",
    "Spectral roll-on": "min(f) FILTER (WHERE cm >= sm * 0.05)",
    "Spectral skewness": "sum((f - ct) ^ 3 * m / sm) / max(v2) ^ 1.5",
    "Spectral slope": "sum((f - fm) * m) / sum((f - fm) ^ 2) / max(sm)",
    "Spectral spread": "sqrt(max(v2))",
    "Spectral variation": "1 - sum(m * mn) / sqrt(sum(m * m) FILTER (WHERE k > 0) * sum(m * m) FILTER (WHERE mn IS NOT NULL))",
}
_CWT = """,
kn AS (SELECT w, j, 2 / (sqrt(3 * w) * pi() ^ 0.25) * (1 - t * t / (w * w)) * exp(-t * t / (2.0 * w * w)) AS c, lead_
  FROM (SELECT w, j, j - (len - 1) / 2.0 AS t, (len - 1) // 2 AS lead_ FROM (
    SELECT w, 10 * w AS len, unnest(range(0, 10 * w)) AS j FROM range(1, 10) a(w)))),
kc AS (SELECT dataset, series_id, w, j, CASE WHEN 10 * w > n
    THEN 2 / (sqrt(3 * w) * pi() ^ 0.25) * (1 - (j - (n - 1) / 2.0) ^ 2 / (w * w)) * exp(-1.0 * (j - (n - 1) / 2.0) ^ 2 / (2.0 * w * w))
    ELSE c END AS c, CASE WHEN 10 * w > n THEN (n - 1) // 2 ELSE lead_ END AS ld
  FROM nn JOIN kn ON j < n),
cw AS (SELECT s.dataset, s.series_id, w, o.idx, sum(c * s.y) AS c FROM s JOIN kc ON s.dataset = kc.dataset AND s.series_id = kc.series_id
  JOIN s o ON o.dataset = s.dataset AND o.series_id = s.series_id AND s.idx = o.idx + ld - j
  GROUP BY 1, 2, 3, 4),
wv AS (SELECT dataset, series_id, w, abs(avg(c)) AS a, sqrt(avg(c * c)) AS e, stddev_pop(c) AS s, var_pop(c) AS v, sum(abs(c)) AS t
  FROM cw GROUP BY 1, 2, 3)"""
_MFCC = """,
z AS (SELECT dataset, series_id, idx, y - 0.97 * coalesce(lag(y) OVER (PARTITION BY series_id ORDER BY idx), 0) AS y FROM s),
pb AS (SELECT dataset, series_id, k, (sum(y * cos(2 * pi() * ((k * idx) % 512) / 512)) ^ 2
  + sum(y * sin(2 * pi() * ((k * idx) % 512) / 512)) ^ 2) / 512 AS p
  FROM z, range(0, 257) a(k) WHERE idx < 512 GROUP BY 1, 2, 3),
hz AS (SELECT i, 700 * (10 ^ (2595 * log10(1 + 50 / 700.0::DOUBLE) * i / 41 / 2595) - 1) AS h FROM range(0, 42) a(i)),
bn AS (SELECT i, h, floor(513 * h / 100) AS b FROM hz),
tri AS (SELECT l.i AS mel, l.b AS lo, m.b AS mid, u.b AS hi, 2 / (u.h - l.h) AS nm
  FROM bn l JOIN bn m ON m.i = l.i + 1 JOIN bn u ON u.i = l.i + 2),
en AS (SELECT dataset, series_id, mel, sum(p * nm * CASE WHEN k >= lo AND k < mid THEN (k - lo) / (mid - lo)
  WHEN k >= mid AND k < hi THEN (hi - k) / (hi - mid) ELSE 0 END) AS e FROM pb, tri GROUP BY 1, 2, 3),
db AS (SELECT dataset, series_id, mel, 20 * log10(CASE WHEN e = 0 THEN 2.220446049250313e-16 ELSE e END) AS d FROM en),
ce AS (SELECT dataset, series_id, c, sqrt(2 / 40.0::DOUBLE) * sum(d * cos(pi() * c * (2 * mel + 1) / 80)) AS v
  FROM db, range(1, 13) a(c) GROUP BY 1, 2, 3),
cf AS (SELECT dataset, series_id, c - 1 AS k, (v - avg(v) OVER (PARTITION BY series_id) - 1e-8) * (1 + 11 * sin(pi() * (c - 1) / 22)) AS v FROM ce)"""
_SEGMENTS = """,
g AS (SELECT dataset, series_id, n, 2 * least(256, n // 2 + 1) - 2 AS seg FROM nn),
sg AS (SELECT *, seg - seg // 8 AS step, unnest(range(0, (n - seg) // (seg - seg // 8) + 1)) AS sid FROM g),
pt AS (SELECT s.dataset, s.series_id, sid, seg, idx - sid * step AS i, y,
  avg(y) OVER (PARTITION BY s.dataset, s.series_id, sid) AS mu FROM s JOIN sg ON s.dataset = sg.dataset AND s.series_id = sg.series_id
  AND idx >= sid * step AND idx < sid * step + seg),
tw AS (SELECT *, CASE WHEN least(i, seg - i) / seg::DOUBLE < 0.125 THEN 0.5 - 0.5 * cos(2 * pi() * least(i, seg - i) / seg / 0.25) ELSE 1 END AS t FROM pt),
bk AS (SELECT *, unnest(range(0, seg // 2 + 1)) AS k FROM tw),
sp AS (SELECT dataset, series_id, sid, k, seg, (sum((y - mu) * t * cos(2 * pi() * ((k * i) % seg) / seg)) ^ 2
  + sum((y - mu) * t * sin(2 * pi() * ((k * i) % seg) / seg)) ^ 2) / (100 * sum(t * t))
  * CASE WHEN k = 0 OR k = seg // 2 THEN 1 ELSE 2 END AS p FROM bk GROUP BY 1, 2, 3, 4, 5),
mc AS (SELECT dataset, series_id, k, avg(p) AS p FROM sp GROUP BY 1, 2, 3)"""
# Lag sums in single precision, then Durbin's recursion for the prediction coefficients.
_LPC = """,
lg AS (SELECT a.dataset, a.series_id, j, CAST(CAST(sum(a.y * b.y) AS FLOAT) AS DOUBLE) AS r
  FROM s a, range(0, 12) t(j) JOIN s b ON b.dataset = a.dataset AND b.series_id = a.series_id AND b.idx = a.idx - j
  GROUP BY 1, 2, 3),
rr AS (SELECT dataset, series_id, list(r ORDER BY j) AS r FROM lg GROUP BY 1, 2),
dur AS (
  SELECT dataset, series_id, r, 0 AS m, [1.0::DOUBLE] AS a, r[1] AS e FROM rr
  UNION ALL
  SELECT dataset, series_id, r, m + 1,
    list_transform(range(0, m + 2), lambda i: coalesce(a[i + 1], 0) + q * coalesce(a[m + 2 - i], 0)), e * (1 - q * q)
  FROM (SELECT *, -list_sum(list_transform(range(0, m + 1), lambda i: a[i + 1] * r[m + 2 - i])) / e AS q FROM dur WHERE m < 11)),
ar AS (SELECT dataset, series_id, a FROM dur WHERE m = 11),
pw AS (SELECT dataset, series_id, f, ln(
  list_sum(list_transform(range(0, 12), lambda i: a[i + 1] * cos(2 * pi() * f * i / 12))) ^ 2
  + list_sum(list_transform(range(0, 12), lambda i: a[i + 1] * sin(2 * pi() * f * i / 12))) ^ 2) AS l FROM ar, range(0, 12) t(f)),
cp AS (SELECT dataset, series_id, k, sqrt(sum(l * cos(2 * pi() * f * k / 12)) ^ 2 + sum(l * sin(2 * pi() * f * k / 12)) ^ 2) / 12 AS c
  FROM pw, range(0, 12) t(k) GROUP BY 1, 2, 3)"""


def _sql(name: str) -> str | None:
    src = _SOURCE.get(name, "ev")
    head = _base(src)
    if name in _T:
        return _simple_sql(name)
    if name in _S:
        return f"{head}{_DFT} {_out(name, _S[name], 'b')} GROUP BY dataset, series_id"
    if name == "ECDF":
        return f"{head} {_vector_out(name, 'i - 1', 'i / n::DOUBLE', 'nn, range(1, 11) a(i)')} WHERE i <= n"
    if name == "ECDF Percentile":
        value = "CASE WHEN max(sdy) = 0 THEN max(y0) ELSE max(y) FILTER (WHERE i / n::DOUBLE <= p) END"
        return f"{head}{_ECDF} {_vector_out(name, 'k', value, 'e, q')} GROUP BY dataset, series_id, k"
    if name == "ECDF Percentile Count":
        value = "CASE WHEN max(sdy) = 0 THEN max(y0) ELSE count(*) FILTER (WHERE i / n::DOUBLE <= p) END"
        return f"{head}{_ECDF} {_vector_out(name, 'k', value, 'e, q')} GROUP BY dataset, series_id, k"
    if name == "ECDF slope":
        def at(p):
            return f"max(y) FILTER (WHERE i / n::DOUBLE <= {p}::DOUBLE)"
        return f"{head}{_ECDF} {_out(name, f'0.25 / ({at(0.75)} - {at(0.5)})', 'e')} GROUP BY dataset, series_id"
    if name == "Entropy":
        value = "-sum(c / n::DOUBLE * log2(c / n::DOUBLE)) / log2(max(n))"
        frm = "(SELECT dataset, series_id, y, n, count(*) AS c FROM s JOIN nn USING (dataset, series_id) GROUP BY 1, 2, 3, 4)"
        return f"{head} {_out(name, value, frm)} GROUP BY dataset, series_id"
    if name == "Histogram":
        frm = """(SELECT s.dataset, s.series_id, j, count(y) FILTER (WHERE y >= lo AND (y < hi OR (j = 9 AND y = hi))) AS c
          FROM s, (SELECT j, -1 + j * 0.2::DOUBLE AS lo, CASE WHEN j = 9 THEN 1.0::DOUBLE ELSE -1 + (j + 1) * 0.2::DOUBLE END AS hi FROM range(0, 10) a(j))
          GROUP BY 1, 2, 3)"""
        return f"{head} {_vector_out(name, 'j', 'c', frm)}"
    if name == "Skewness":
        value = "avg((y - mean) ^ 3) / max(sd) ^ 3"
        return f"{head} {_out(name, value, 's JOIN nn USING (dataset, series_id)')} GROUP BY dataset, series_id"
    if name.startswith("Wavelet"):
        col = {"Wavelet absolute mean": "a", "Wavelet energy": "e", "Wavelet standard deviation": "s", "Wavelet variance": "v"}
        if name in col:
            return f"{head}{_CWT} {_vector_out(name, 'w - 1', col[name], 'wv')}"
        frm = "(SELECT *, t / sum(t) OVER (PARTITION BY dataset, series_id) AS p FROM wv)"
        return f"{head}{_CWT} {_out(name, '-sum(p * ln(p))', frm)} GROUP BY dataset, series_id"
    if name == "MFCC":
        return f"{head}{_MFCC} {_vector_out(name, 'k', 'v', 'cf')}"
    if name == "FFT mean coefficient":
        return f"{head}{_SEGMENTS} {_vector_out(name, 'k', 'p', 'mc')}"
    if name == "LPCC":
        return f"{head.replace('WITH', 'WITH RECURSIVE', 1)}{_LPC} {_vector_out(name, 'k', 'c', 'cp')}"
    # The divisor of the spectral entropy depends on whether rounding leaves bin 0 exactly zero.
    return None


def _feature_query(name: str):
    def run(spark, d):
        series = SRC[_SOURCE.get(name, "ev")][1](spark, d)
        return rounded(extract(series, KEYS, names=[name]), "value", digits=_DIGITS.get(name, 6))

    return run


for _f in (*registry.BUILT_IN, *registry.EXTRA):
    add(f"feature_{slug(_f.name)}", _feature_query(_f.name), _sql(_f.name))


@query(f"""{_base('ev')}, gr AS (SELECT s.dataset, s.series_id, idx, n, mean, sd, lo + idx * (hi - lo) / (n - 1) AS x
FROM s JOIN nn USING (dataset, series_id) JOIN (SELECT series_id, min(y) AS lo, max(y) AS hi FROM s GROUP BY 1) USING (series_id)),
pd AS (SELECT *, exp(-0.5 * ((x - mean) / sd) ^ 2) AS g FROM gr),
pp AS (SELECT *, g / sum(g) OVER (PARTITION BY series_id) AS p FROM pd)
SELECT dataset, series_id, {r('-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / log2(max(n))')} AS entropy FROM pp GROUP BY 1, 2""")
def entropy_gaussian_density(spark, d):
    return rounded(native.entropy_gauss(events_series(spark, d), KEYS), "entropy")


@query(f"""{_base('ev')}, gr AS (SELECT s.dataset, s.series_id, idx, n, lo + idx * (hi - lo) / (n - 1) AS x, s1 * (n * 0.75) ^ (-0.2) AS h
FROM s JOIN nn USING (dataset, series_id) JOIN (SELECT series_id, min(y) AS lo, max(y) AS hi, stddev_samp(y) AS s1 FROM s GROUP BY 1) USING (series_id)),
pd AS (SELECT gr.dataset, gr.series_id, gr.idx, n, sum(exp(-0.5 * ((x - s.y) / h) ^ 2)) AS g FROM gr JOIN s USING (dataset, series_id) GROUP BY 1, 2, 3, 4),
pp AS (SELECT *, g / sum(g) OVER (PARTITION BY series_id) AS p FROM pd)
SELECT dataset, series_id, {r('-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / log2(max(n))')} AS entropy FROM pp GROUP BY 1, 2""")
def entropy_kernel_density(spark, d):
    return rounded(native.entropy_kde(events_series(spark, d), KEYS), "entropy")


@query(f"""{_base('ev')} SELECT s.dataset, s.series_id, row_number() OVER (PARTITION BY s.series_id ORDER BY y, idx) - 1 AS i, y,
{r('row_number() OVER (PARTITION BY s.series_id ORDER BY y, idx) / n::DOUBLE')} AS p FROM s JOIN nn USING (dataset, series_id)""")
def ecdf_values(spark, d):
    sig = events_series(spark, d)
    return rounded(native.ecdf_table(sig, KEYS, profile(sig, KEYS)), "p")


@query(f"""{_base('em')}{_DFT} SELECT series_id, k, {r('m')} AS m, {r('dm')} AS dm FROM b0""")
def amplitude_spectrum(spark, d):
    sig = embedding_series(spark, d)
    return rounded(spectrum(sig, KEYS, profile(sig, KEYS)).select("series_id", "k", "m", "dm"), "m", "dm")


@query(f"{_base('em')}{_CWT} SELECT series_id, CAST(w AS INTEGER) AS width, idx, {r('c')} AS c FROM cw")
def wavelet_transform(spark, d):
    sig = embedding_series(spark, d)
    out = wavelet(sig.select(*KEYS, "idx", "y"), KEYS, registry.WIDTHS)
    return rounded(out.select("series_id", "width", "idx", "c"), "c")


@query(f"""{_base('ev')}, c AS (SELECT s.dataset, s.series_id, idx, y - mean AS y, n, vr FROM s JOIN nn USING (dataset, series_id))
SELECT a.dataset, a.series_id, CAST(j AS INTEGER) AS lag, {r('sum(a.y * b.y) / (max(a.vr) * max(a.n))')} AS acf
FROM c a, range(0, 12) t(j) JOIN c b ON b.series_id = a.series_id AND b.idx = a.idx - j GROUP BY 1, 2, 3""")
def autocorrelation_normalised(spark, d):
    sig = events_series(spark, d)
    out = spectral.autocorrelation(sig.select(*KEYS, "idx", "y"), KEYS, 12, profile(sig, KEYS))
    return out.select(*KEYS, F.posexplode("acf").alias("lag", "acf")).withColumn("acf", rnd("acf"))


@query(f"{_base('ev').replace('WITH', 'WITH RECURSIVE', 1)}{_LPC} SELECT dataset, series_id, CAST(i AS INTEGER) AS k, {r('a[i + 1]', 3)} AS value FROM ar, range(0, 12) t(i)")
def linear_prediction(spark, d):
    sig = events_series(spark, d)
    out = spectral.lpc(sig.select(*KEYS, "idx", "y"), KEYS, 12, profile(sig, KEYS))
    return out.select(*KEYS, F.posexplode("lpc").alias("k", "value")).withColumn("value", rnd("value", 3))


@query(f"{_base('ev')}{_MFCC} SELECT dataset, series_id, CAST(mel AS INTEGER) AS mel, {r('d', 4)} AS db FROM db")
def mel_filter_energies(spark, d):
    sig = events_series(spark, d)
    return rounded(spectral.filter_energies(sig, KEYS, 100.0), "db", digits=4)


_WIN = """, wv AS (SELECT dataset, series_id, idx // 25 AS win_id, count(*) AS c, {aggs} FROM s GROUP BY 1, 2, 3 HAVING count(*) = 25)"""
_WAGG = {"Max": "max(y)", "Mean": "avg(y)", "Slope": "regr_slope(y, idx)", "Root mean square": "sqrt(avg(y * y))"}


@query(f"""{_base('li')}{_WIN.format(aggs=', '.join(f'{e} AS "{n}"' for n, e in _WAGG.items()))}
SELECT dataset, series_id, win_id, feature, CAST(0 AS INTEGER) AS k, {r('value', 3)} AS value FROM (
{' UNION ALL '.join(f'''SELECT dataset, series_id, win_id, '{n}' AS feature, "{n}" AS value FROM wv''' for n in _WAGG)})""")
def features_per_window(spark, d):
    return rounded(extract_windows(supplier_series(spark, d), 25, names=list(_WAGG)), "value", digits=3)


def _rows_of(exprs: dict[str, str]) -> str:
    """Feature rows of plain aggregates over ``d``."""
    parts = " UNION ALL ".join(f"SELECT dataset, series_id, '{n}' AS feature, CAST(0 AS INTEGER) AS k, CAST({e} AS DOUBLE) AS value FROM d GROUP BY 1, 2" for n, e in exprs.items())
    return f"{_base('ev')}{_TEMPORAL} SELECT dataset, series_id, feature, k, {r('value', 3)} AS value FROM ({parts})"


@query(_rows_of({f.name: _T[f.name] for f in registry.select("temporal")}))
def features_by_domain(spark, d):
    """The features of one domain."""
    return rounded(extract(events_series(spark, d), KEYS, domain="temporal"), "value", digits=3)


_EMG = {n: _T[n] for n in ("Negative turning points", "Positive turning points", "Root mean square", "Zero crossing rate")}


@query(_rows_of(_EMG))
def features_by_tag(spark, d):
    """The features of one tag, but for the cepstra, which have a query of their own."""
    return rounded(extract(events_series(spark, d), KEYS, tag="emg").filter("feature <> 'MFCC'"), "value", digits=3)


@query(_rows_of({
    "Average power": _T["Average power"].replace("100", "50"), "Area under the curve": _T["Area under the curve"].replace("100", "50"),
    "Neighbourhood peaks": "count(*) FILTER (WHERE idx >= 3 AND idx < n - 3 AND y > lm AND y > rm)",
}).replace("10 PRECEDING", "3 PRECEDING").replace("10 FOLLOWING", "3 FOLLOWING"))
def features_with_overrides(spark, d):
    """Another sampling rate for all, and another reach for one."""
    names = ["Average power", "Area under the curve", "Neighbourhood peaks"]
    out = extract(events_series(spark, d), KEYS, names=names, fs=50, overrides={"Neighbourhood peaks": {"n": 3}})
    return rounded(out, "value", digits=3)


@query(_rows_of({"Range share": "max(y) / 2"}) + f""" UNION ALL SELECT dataset, series_id, 'Ends', CAST(k AS INTEGER), {r('CASE WHEN k = 0 THEN a ELSE b END', 3)}
FROM (SELECT dataset, series_id, arg_min(y, idx) AS a, arg_max(y, idx) AS b FROM d GROUP BY 1, 2), range(0, 2) t(k)""")
def features_of_users(spark, d):
    """Two registered features, one with a parameter and one with two outputs."""
    registry.register_feature("Range share", "statistical", lambda top: F.max("y") / top, params={"top": 2.0})
    registry.register_feature("Ends", "temporal", lambda: F.array(F.min_by("y", "idx"), F.max_by("y", "idx")), size=2)
    try:
        return rounded(extract(events_series(spark, d), KEYS, names=["Range share", "Ends"]), "value", digits=3)
    finally:
        registry.unregister_feature("Range share")
        registry.unregister_feature("Ends")


@query(f"""{_base('ev')} SELECT dataset, series_id, CAST(133 + least(256, n // 2 + 1) AS INTEGER) AS outputs, 133 AS pruned FROM nn""")
def feature_widths(spark, d):
    """Values per series of the whole catalogue (389 from 510 points on), and of what the prompt bank keeps."""
    every = extract(events_series(spark, d), KEYS)
    kept = prune(every).groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("pruned"))
    return every.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("outputs")).join(kept, KEYS)


@query()
def features_whole_series(spark, d):
    """Every catalogue feature of every user's series."""
    return rounded(extract(events_series(spark, d), KEYS), "value", digits=3)


@query(f"{_base('ev')} SELECT dataset, series_id, 14 AS expected, 14 AS outputs FROM nn")
def feature_count(spark, d):
    """Outputs per series beside the width the catalogue announces."""
    cat = registry.catalogue(spark, registry.select("temporal"))
    got = extract(events_series(spark, d), KEYS, domain="temporal").groupBy(*KEYS, "feature").agg(F.count("value").alias("got"))
    both = got.join(F.broadcast(cat.filter("use").select("feature", "n_features")), "feature")
    return both.groupBy(*KEYS).agg(
        F.sum("n_features").cast("int").alias("expected"), F.sum("got").cast("int").alias("outputs")
    )


_CORR = {"Max": "max(y)", "Mean": "avg(y)", "Min": "min(y)", "Median": "median(y)", "Standard deviation": "stddev_pop(y)",
         "Variance": "var_pop(y)", "Peak to peak distance": "max(y) - min(y)"}


@query(f"""{_base('ev')}, f AS (SELECT series_id, {', '.join(f'{e} AS f{i}' for i, e in enumerate(_CORR.values()))} FROM s GROUP BY 1),
p AS ({' UNION ALL '.join(f"SELECT '{b}' AS feature, corr(f{i}, f{j}) AS c FROM f" for j, b in enumerate(_CORR) for i in range(j))})
SELECT DISTINCT feature FROM p WHERE abs(c) > 0.95""")
def correlated_features(spark, d):
    long = extract(events_series(spark, d), KEYS, names=list(_CORR))
    wide = long.groupBy(*KEYS).agg(*[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in _CORR])
    return find_correlated(wide, list(_CORR), 0.95)


_SPLIT = f"""{_base('ev')}, sp AS (SELECT s.dataset, s.series_id, y, idx,
CASE WHEN idx < CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
WHEN idx < CAST(trunc(n * 0.7::DOUBLE) AS BIGINT) + CAST(trunc(n * 0.1::DOUBLE) AS BIGINT) THEN 'val' ELSE 'test' END AS split
FROM s JOIN nn USING (dataset, series_id))"""
_PNAMES = ["Max", "Mean", "Median", "Min", "Root mean square", "Standard deviation"]
_PF = f"""{_SPLIT}, pw AS (SELECT split, dataset, series_id, {', '.join(f'{_T[n]} AS "{n}"' for n in _PNAMES)} FROM sp GROUP BY 1, 2, 3),
pl AS MATERIALIZED ({' UNION ALL '.join(f'''SELECT split, dataset, series_id, '{n}' AS feature, CAST(0 AS INTEGER) AS k, "{n}" AS value FROM pw''' for n in _PNAMES)})"""
_FIT = """, pr AS MATERIALIZED (SELECT split, feature, k, avg(value) AS mean,
  CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS scale FROM pl GROUP BY 1, 2, 3)"""


def _few_prompts(spark, d):
    return bank.generate_prompts(events_series(spark, d), names=_PNAMES)


@query(f"{_PF} SELECT split, dataset, series_id, feature, k, {r('value')} AS value FROM pl")
def prompts_per_split(spark, d):
    return rounded(_few_prompts(spark, d), "value")


@query(f"{_PF}{_FIT} SELECT split, feature, k, {r('mean')} AS mean, {r('scale')} AS scale FROM pr")
def prompt_scaler_fit(spark, d):
    return rounded(bank.fit_prompt_scaler(_few_prompts(spark, d)), "mean", "scale")


@query(f"""{_PF}{_FIT} SELECT split, dataset, series_id, feature, k, {r('(value - mean) / scale')} AS value
FROM pl JOIN pr USING (split, feature, k)""")
def prompt_scale(spark, d):
    p = _few_prompts(spark, d)
    return rounded(bank.scale_prompts(p, bank.fit_prompt_scaler(p)), "value")


@query(f"""{_PF} SELECT split, dataset, series_id, CAST(row_number() OVER (PARTITION BY split, dataset, series_id ORDER BY feature) - 1 AS INTEGER) AS pos,
{r('value')} AS value FROM pl""")
def prompt_vectors(spark, d):
    v = bank.pack_prompts(_few_prompts(spark, d))
    return v.select(*bank.SPLIT_KEYS, F.posexplode("features").alias("pos", "value")).withColumn("value", rnd("value"))


@query()
def prompt_bank_full(spark, d):
    """The whole bank: 133 normalised numbers per split and series."""
    return bank.build_bank(events_series(spark, d)).select(*bank.SPLIT_KEYS, F.size("features").alias("width"),
                                            rnd(F.aggregate("features", F.lit(0.0), lambda a, v: a + v), 1).alias("total"))


@query(f"{_PF}, u AS (SELECT * FROM pl UNION ALL SELECT * FROM pl) SELECT split, feature, count(*) AS n, {r('sum(value)', 3)} AS total FROM u GROUP BY 1, 2")
def prompt_union(spark, d):
    p = _few_prompts(spark, d)
    return p.unionByName(p).groupBy("split", "feature").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 3).alias("total"))


@query(f"{_base('ev')}{_SEGMENTS}, a AS (SELECT dataset, series_id, max(y) AS v FROM s GROUP BY 1, 2) SELECT dataset, series_id, 'Max' AS feature, CAST(0 AS INTEGER) AS k, v AS value FROM a")
def prune_by_prefix(spark, d):
    return prune(extract(events_series(spark, d), KEYS, names=["FFT mean coefficient", "Max"]))


@query()
def prompt_map(spark, d):
    """Two principal components of all prompt vectors."""
    return rounded(bank.prompt_map(bank.pack_prompts(_few_prompts(spark, d))), "pc1", "pc2", digits=4)
