"""Spectral features as window passes and aggregates over the spectrum tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.features.spectrum import segment_spectrum, spectrum, wavelet
from tidegauge.functions.types import VECTOR, once
from tidegauge.operators.order import (
    GroupProfile,
    join_groups,
    rank_within,
    running_sum,
    whole_window,
    with_neighbours,
    with_totals,
)

def _ratio(a, b, empty: float = 0.0):
    return F.coalesce(F.try_divide(a, F.when(b != 0, b)), F.lit(empty))


def bin_frequency(k: Column, n: Column, fs: float) -> Column:
    """Frequency of a bin, rounded the way NumPy rounds it so that ties fall alike."""
    return k * (1.0 / (n * (1.0 / fs)))


def nearest_bin(freq: float, n: Column, fs: float) -> Column:
    """Bin whose frequency is nearest to ``freq``, the lower one of two."""
    top = F.floor(n / 2)
    near = F.floor(freq * n / fs)
    tried = [F.least(F.greatest(near + d, F.lit(0).cast("bigint")), top) for d in (-1, 0, 1, 2)]
    best = F.least(*[F.struct(F.abs(freq - bin_frequency(k, n, fs)).alias("d"), k.alias("k")) for k in tried])
    return best["k"]


def bin_profile(prof: GroupProfile) -> GroupProfile:
    return GroupProfile(prof.rows // 2 + 1, prof.longest // 2 + 1)


def spectral_table(signal: DataFrame, keys: list[str], fs: float, prof: GroupProfile) -> DataFrame:
    """One row per group with the features that read the whole amplitude spectrum."""
    bp = bin_profile(prof)
    n = F.col("n").cast("double")
    bins = spectrum(signal, keys, prof).withColumn("f", bin_frequency(F.col("k"), n, fs))
    # One-sided density of the unit-variance signal under a Hann window.
    wsum = F.when(F.col("n") <= 2, F.lit(1.0)).otherwise(n * 0.375)
    single = (F.col("k") == 0) | ((F.col("n") % 2 == 0) & (F.col("k") == F.expr("n div 2")))
    density = F.col("pw") / (wsum * fs) * F.when(single, F.lit(1.0)).otherwise(F.lit(2.0))
    bins = bins.withColumn("pw", density)
    bins = running_sum(bins, keys, "k", {"cm": F.col("m"), "cp": F.col("pw")}, bp)
    bins = with_neighbours(
        bins, keys, "k", 1,
        lambda w: {"m_prev": F.lag("m").over(w), "m_next": F.lead("m").over(w)}, bp,
    )
    bins = with_totals(
        bins, keys,
        {
            "sm": F.sum("m"), "sfm": F.sum(F.col("f") * F.col("m")), "spw": F.sum("pw"),
            "sd2": F.sum(F.col("dm") * F.col("dm")), "m0": F.max(F.when(F.col("k") == 0, F.col("m"))),
        },
        bp, "k",
    )
    p = F.col("dm") * F.col("dm") / F.when(F.col("sd2") != 0, F.col("sd2"))
    dev = F.col("f") - _ratio(F.col("sfm"), F.col("sm"))
    share = _ratio(F.col("m"), F.col("sm"))
    dev2 = dev * dev
    up, down = F.col("m") - F.col("m_prev"), F.col("m_next") - F.col("m")
    tail = F.col("k") >= 1
    bins = bins.withColumns({"_p": p, "_share": share, "_d2": dev2})
    human = (F.col("k") >= nearest_bin(0.6, n, fs)) & (F.col("k") < nearest_bin(2.5, n, fs))
    first = lambda cond: F.min(F.when(cond, F.col("f")))
    agg = bins.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).cast("double").alias("nb"),
        F.max("sm").alias("sm"), F.max("sfm").alias("sfm"),
        F.sum("f").alias("sf"), F.sum(F.col("f") * F.col("f")).alias("sff"),
        F.sum(F.col("m") * F.col("m")).alias("smm"),
        F.coalesce(F.sum(F.when(human, F.col("m") * F.col("m"))), F.lit(0.0)).alias("human"),
        F.max("var").alias("var"),
        F.max("pw").alias("pw_max"), F.max("spw").alias("spw"),
        first(F.col("cm") > F.col("sm") * 0.95).alias("maximum"),
        first(F.col("cm") > F.col("sm") * 0.5).alias("median"),
        first(F.col("cm") >= F.col("sm") * 0.95).alias("roll_off"),
        first(F.col("cm") >= F.col("sm") * 0.05).alias("roll_on"),
        first(F.col("cp") >= F.col("spw") * 0.95).alias("bw_low"),
        F.max(F.when(F.col("spw") - F.col("cp") + F.col("pw") >= F.col("spw") * 0.95, F.col("f"))).alias("bw_up"),
        F.coalesce(F.sum(F.when(tail, F.try_divide(F.col("m") - F.col("m0"), F.col("k").cast("double")))), F.lit(0.0)).alias("dec"),
        F.coalesce(F.sum(F.when(tail, F.col("m"))), F.lit(0.0)).alias("sm_tail"),
        F.sum(F.col("m") * (F.expr("n div 2") + 1 - F.col("k"))).alias("scum"),
        F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.log2("_p"))).alias("plogp"),
        F.count_if(F.col("_p") > 0).cast("double").alias("np"),
        F.sum(F.col("_d2") * F.col("_share")).alias("v2"),
        F.sum(F.col("_d2") * dev * F.col("_share")).alias("v3"),
        F.sum(F.col("_d2") * F.col("_d2") * F.col("_share")).alias("v4"),
        F.coalesce(F.count_if((up > 0) & (down < 0)), F.lit(0)).cast("double").alias("turns"),
        F.coalesce(F.sum(F.col("m") * F.col("m_next")), F.lit(0.0)).alias("cross"),
        F.coalesce(F.sum(F.when(tail, F.col("m") * F.col("m"))), F.lit(0.0)).alias("sq_tail"),
        F.coalesce(F.sum(F.when(F.col("m_next").isNotNull(), F.col("m") * F.col("m"))), F.lit(0.0)).alias("sq_head"),
    )
    nb, sm = F.col("nb"), F.col("sm")
    den = nb * F.col("sff") - F.col("sf") * F.col("sf")
    spread = F.sqrt("v2")
    unit = F.when(F.col("var") == 0, F.lit(1.0)).otherwise(F.col("var"))
    ent = F.when((F.col("np") <= 1) | F.col("plogp").isNull(), F.lit(0.0)).otherwise(
        -F.try_divide(F.col("plogp"), F.log2(F.when(F.col("np") > 1, F.col("np"))))
    )
    return (
        agg.select(
            *keys,
            F.coalesce("maximum", F.lit(0.0)).alias("max_frequency"),
            F.coalesce("median", F.lit(0.0)).alias("median_frequency"),
            F.col("roll_off").alias("spectral_roll_off"),
            F.col("roll_on").alias("spectral_roll_on"),
            (F.col("pw_max") / unit).alias("max_power_spectrum"),
            F.when(F.col("spw") == 0, F.lit(0.0)).otherwise(F.abs(F.col("bw_up") - F.col("bw_low"))).alias("power_bandwidth"),
            _ratio(F.col("sfm"), sm).alias("spectral_centroid"),
            _ratio(F.col("dec"), F.col("sm_tail")).alias("spectral_decrease"),
            (sm * nb / 2 - F.col("scum")).alias("spectral_distance"),
            ent.alias("spectral_entropy"),
            _ratio(F.col("v4"), F.col("v2") * F.col("v2")).alias("spectral_kurtosis"),
            _ratio(F.col("v3"), spread * F.col("v2")).alias("spectral_skewness"),
            spread.alias("spectral_spread"),
            F.col("turns").alias("spectral_positive_turning"),
            F.when(sm == 0, F.lit(0.0))
            .otherwise(_ratio((nb * F.col("sfm") - F.col("sf") * sm) / F.when(sm != 0, sm), den))
            .alias("spectral_slope"),
            (1 - _ratio(F.col("cross"), F.sqrt("sq_tail") * F.sqrt("sq_head"))).alias("spectral_variation"),
            _ratio(F.col("human"), F.col("smm")).alias("human_range_energy"),
        )
    )


def fundamental_frequency(signal: DataFrame, keys: list[str], fs: float, prof: GroupProfile) -> DataFrame:
    """Lowest frequency among spectrum peaks of at least 0.3 of the largest bin.

    A flat-topped peak counts at its middle: runs of equal bins are reduced to
    their first bin, and the next run tells where a run ends.
    """
    bp = bin_profile(prof)
    bins = spectrum(signal, keys, prof).select(*keys, "n", "k", F.col("dm").alias("m"))
    bins = with_totals(bins, keys, {"top": F.max("m")}, bp, "k")
    starts = with_neighbours(bins, keys, "k", 1, lambda w: {"_b": F.lag("m").over(w)}, bp)
    starts = starts.filter(F.col("_b").isNull() | (F.col("_b") != F.col("m"))).drop("_b")
    pos = "k"
    if not whole_window(signal, 1, bp):
        # Chunks need positions without holes.
        starts, pos = rank_within(starts, keys, ["k"], "_r", bp), "_r"
    runs = with_neighbours(
        starts, keys, pos, 1,
        lambda w: {"_p": F.lag("m").over(w), "_q": F.lead("m").over(w), "_nk": F.lead("k").over(w)}, bp,
    )
    m = F.col("m")
    hit = (F.col("_p") < m) & (F.col("_q") < m) & (m >= F.col("top") * 0.3)
    mid = F.floor((F.col("k") + F.col("_nk") - 1) / 2)
    low = F.min(F.when(hit, bin_frequency(mid, F.col("n").cast("double"), fs)))
    return runs.groupBy(*keys).agg(F.coalesce(low, F.lit(0.0)).alias("fundamental_frequency"))


def wavelet_table(signal: DataFrame, keys: list[str], widths: tuple[int, ...]) -> DataFrame:
    """Mean, energy, deviation and variance per wavelet width, and their entropy."""
    c = F.col("c")
    per = wavelet(signal, keys, widths).groupBy(*keys, "width").agg(
        F.abs(F.avg(c)).alias("a"), F.sqrt(F.avg(c * c)).alias("e"),
        F.stddev_pop(c).alias("s"), F.var_pop(c).alias("v"), F.sum(F.abs(c)).alias("t"),
    )
    rows = per.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("width", "a", "e", "s", "v", "t"))).alias("_r")
    )
    tot = F.aggregate("_r.t", F.lit(0.0), lambda x, v: x + v)
    ent = F.aggregate(
        F.transform("_r.t", lambda v: v / F.when(F.col("_t") != 0, F.col("_t"))),
        F.lit(0.0), lambda x, p: x - F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0)),
    )
    sums = signal.groupBy(*keys).agg(F.sum("y").alias("_sy"))
    return (
        rows.withColumn("_t", tot)
        .join(sums, keys)
        .select(
            *keys,
            F.col("_r.a").alias("wavelet_abs_mean"), F.col("_r.e").alias("wavelet_energy"),
            F.col("_r.s").alias("wavelet_std"), F.col("_r.v").alias("wavelet_var"),
            F.when((F.col("_sy") == 0) | (F.col("_t") == 0), F.lit(0.0)).otherwise(ent).alias("wavelet_entropy"),
        )
    )


def mel_filters(fs: float, nfft: int, nfilt: int) -> list[tuple[int, int, float]]:
    """Non-zero weights (filter, bin, weight) of the triangular mel filter bank."""
    # The mel scale, 2595 log10(1 + f/700).
    top = 2595 * math.log10(1 + fs / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, nfilt + 2) / 2595) - 1)
    at = np.floor((nfft + 1) * hz / fs)
    out = []
    for i in range(nfilt):
        left, mid, right = at[i], at[i + 1], at[i + 2]
        norm = 2 / (hz[i + 2] - hz[i])
        for k in range(int(left), int(right)):
            w = (k - left) / (mid - left) if k < mid else (right - k) / (right - mid)
            if w:
                out.append((i, k, float(w * norm)))
    return out


@F.pandas_udf(VECTOR)
def _power_bins(signals: pd.Series, pre: pd.Series, nfft: pd.Series) -> pd.Series:
    """Power of the first ``nfft`` pre-emphasised points, zero padded."""
    out = []
    for x, a, size in zip(signals, pre, nfft):
        x = np.asarray(x, dtype=float)
        z = np.append(x[:1], x[1:] - a * x[:-1])
        out.append(np.abs(np.fft.rfft(z, int(size))) ** 2 / size)
    return pd.Series(out)


_power_bins = once(_power_bins)


def mfcc(
    signal: DataFrame, keys: list[str], fs: float, pre_emphasis: float = 0.97, nfft: int = 512,
    nfilt: int = 40, num_ceps: int = 12, cep_lifter: int = 22,
) -> DataFrame:
    """Mel cepstral coefficients of the first ``nfft`` points."""
    db = filter_energies(signal, keys, fs, pre_emphasis, nfft, nfilt)
    cosine = [
        (c, m, math.sqrt(2 / nfilt) * math.cos(math.pi * c * (2 * m + 1) / (2 * nfilt)))
        for c in range(1, num_ceps + 1)
        for m in range(nfilt)
    ]
    dct = F.broadcast(signal.sparkSession.createDataFrame(cosine, "c int, mel int, w double"))
    coef = db.join(dct, "mel").groupBy(*keys, "c").agg(F.sum(F.col("db") * F.col("w")).alias("v"))
    packed = coef.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("_s"))
    mean = F.aggregate("_s.v", F.lit(0.0), lambda a, v: a + v) / F.size("_s") + 1e-8
    lift = lambda i: 1 + (cep_lifter / 2) * F.sin(math.pi * i / cep_lifter)
    return packed.withColumn("_m", mean).select(
        *keys, F.transform("_s.v", lambda v, i: (v - F.col("_m")) * lift(i)).alias("mfcc")
    )


def filter_energies(
    signal: DataFrame, keys: list[str], fs: float, pre_emphasis: float = 0.97, nfft: int = 512, nfilt: int = 40
) -> DataFrame:
    """Mel filter-bank energies in decibels: ``mel, db``."""
    spark = signal.sparkSession
    head = signal.select(*keys, "idx", "y").filter(F.col("idx") < nfft)
    packed = head.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").alias("p"), F.col("y").alias("v")))).alias("_s")
    )
    power = packed.withColumn("_p", _power_bins("_s.v", F.lit(pre_emphasis), F.lit(nfft)))
    # A filter whose corner bins coincide has no weights; a zero weight keeps its output.
    weights = [*mel_filters(fs, nfft, nfilt), *[(i, 0, 0.0) for i in range(nfilt)]]
    bank = F.broadcast(spark.createDataFrame(weights, "mel int, k int, w double"))
    bins = power.select(*keys, F.posexplode("_p").alias("k", "p"))
    energy = bins.join(bank, "k").groupBy(*keys, "mel").agg(F.sum(F.col("p") * F.col("w")).alias("_e"))
    eps = float(np.finfo(float).eps)
    safe = F.when(F.col("_e") == 0, F.lit(eps)).otherwise(F.col("_e"))
    return energy.select(*keys, "mel", (20 * F.log10(safe)).alias("db"))


def lag_products(signal: DataFrame, keys: list[str], lags: int, prof: GroupProfile) -> DataFrame:
    """Sums of y[i] * y[i-j] for j below ``lags`` as one array per group."""
    rows = with_neighbours(
        signal, keys, "idx", lags - 1,
        lambda w: {f"_l{j}": F.lag("y", j).over(w) for j in range(1, lags)}, prof,
    )
    y = F.col("y")
    sums = [F.sum(y * y)] + [F.coalesce(F.sum(y * F.col(f"_l{j}")), F.lit(0.0)) for j in range(1, lags)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("acf"))


def autocorrelation(signal: DataFrame, keys: list[str], lags: int, prof: GroupProfile) -> DataFrame:
    """Normalised autocorrelation of the centred signal; zeros for a constant one."""
    stats = signal.groupBy(*keys).agg(F.avg("y").alias("_mean"), F.var_pop("y").alias("_var"))
    centred = join_groups(signal, stats, keys, prof).withColumn("y", F.col("y") - F.col("_mean"))
    acf = lag_products(centred.select(*keys, "idx", "y"), keys, lags, prof).join(stats, keys)
    den = F.col("_var") * F.col("n")
    return acf.select(
        *keys, F.transform("acf", lambda r: F.coalesce(F.try_divide(r, F.when(den != 0, den)), F.lit(0.0))).alias("acf")
    )


def _predictor(r: np.ndarray) -> np.ndarray:
    """Linear prediction coefficients from lag sums, through the Toeplitz system."""
    r = np.asarray(r, dtype=np.float32).astype(float)
    order = len(r) - 1
    lag = np.abs(np.subtract.outer(np.arange(order), np.arange(order)))
    system = r[lag]
    if system.sum() == 0:
        return np.zeros(order + 1)
    return np.concatenate(([1.0], np.linalg.inv(system) @ -r[1:]))


@F.pandas_udf(VECTOR)
def _lpc(acf: pd.Series) -> pd.Series:
    return pd.Series([_predictor(np.asarray(r)) for r in acf])


_lpc = once(_lpc)


def _cepstrum_of(a: np.ndarray) -> np.ndarray:
    a = np.asarray(a, dtype=float)
    return a * 0 if a.sum() == 0 else np.abs(np.fft.ifft(np.log(np.abs(np.fft.fft(a)) ** 2)))


@F.pandas_udf(VECTOR)
def _cepstrum(coeffs: pd.Series) -> pd.Series:
    return pd.Series([_cepstrum_of(a) for a in coeffs])


_cepstrum = once(_cepstrum)


def lpc(signal: DataFrame, keys: list[str], n_coeff: int, prof: GroupProfile) -> DataFrame:
    """Linear prediction coefficients; signals shorter than ``n_coeff`` have none."""
    acf = lag_products(signal, keys, n_coeff, prof).filter(F.col("n") >= n_coeff)
    return acf.select(*keys, _lpc("acf").alias("lpc"))


def lpcc(signal: DataFrame, keys: list[str], n_coeff: int, prof: GroupProfile) -> DataFrame:
    return lpc(signal, keys, n_coeff, prof).select(*keys, _cepstrum("lpc").alias("lpcc"))


def fft_mean_coeff(
    signal: DataFrame, keys: list[str], nfreq: int, fs: float, sizes: DataFrame, prof: GroupProfile
) -> DataFrame:
    """Mean power per frequency over overlapping segments, as one array."""
    per = segment_spectrum(signal, keys, nfreq, fs, sizes, prof)
    packed = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("_s"))
    return packed.select(*keys, F.col("_s.p").alias("fft_mean_coeff"))
