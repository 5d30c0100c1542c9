"""All features that need a whole signal as an array, from one gathering of it.

Signals within the group bound are gathered once and given to one Arrow function, which yields the values of every requested
spectrum, segment, cepstrum and wavelet feature as (feature, k, value).  Signals of equal length are worked on together.
Missing points (NULL or NaN) are left out of the array, and the others close up.  Longer signals go through the tables of
``spectral``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from tidegauge.features.registry import Feature
from tidegauge.features.spectral import _cepstrum_of, _predictor, mel_filters
from tidegauge.features.spectrum import ricker, tukey

WHOLE_SPECTRUM = {
    "human_range_energy", "max_power_spectrum", "max_frequency", "median_frequency", "power_bandwidth",
    "spectral_centroid", "spectral_decrease", "spectral_distance", "spectral_entropy", "spectral_kurtosis",
    "spectral_positive_turning", "spectral_roll_off", "spectral_roll_on", "spectral_skewness",
    "spectral_slope", "spectral_spread", "spectral_variation",
}
WAVELET = {"wavelet_abs_mean", "wavelet_energy", "wavelet_entropy", "wavelet_std", "wavelet_var"}
ARRAY_FEATURES = WHOLE_SPECTRUM | WAVELET | {"fundamental_frequency", "fft_mean_coeff", "lpcc", "mfcc"}
BLOCK = 1 << 18  # points worked on at once


def _ratio(a, b):
    """a / b, and 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def _first(hit: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Frequency of the first bin of each row that holds; NaN if none."""
    return np.where(hit.any(1), f[hit.argmax(1)], np.nan)


class Spectra:
    """Spectra of signals of one length (rows of ``x``), each computed when it is first asked for."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, x.shape[1]
        self.k = np.arange(self.n // 2 + 1)
        self.mean = x.mean(1, keepdims=True)
        self._held: dict = {}

    def _once(self, name, make):
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    @property
    def raw(self):
        return self._once("raw", lambda: np.abs(np.fft.rfft(self.x)))

    @property
    def centred(self):
        return self._once("centred", lambda: np.abs(np.fft.rfft(self.x - self.mean)))

    def frequency(self, fs: float) -> np.ndarray:
        """Frequencies of the bins, rounded the way NumPy rounds them so that ties fall alike."""
        return self.k * (1.0 / (self.n * (1.0 / fs)))

    def density(self, fs: float) -> np.ndarray:
        """One-sided power density under a Hann window."""
        def power():
            n = self.n
            hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
            return np.abs(np.fft.rfft((self.x - self.mean) * hann)) ** 2
        single = (self.k == 0) | ((self.n % 2 == 0) & (self.k == self.n // 2))
        total = 1.0 if self.n <= 2 else self.n * 0.375
        return self._once("power", power) / (total * fs) * np.where(single, 1.0, 2.0)


def nearest(freq: float, n: int, fs: float) -> int:
    """Bin whose frequency is nearest to ``freq``, the lower one of two."""
    near = int(np.floor(freq * n / fs))
    tried = [min(max(near + d, 0), n // 2) for d in (-1, 0, 1, 2)]
    return min((abs(freq - k * (1.0 / (n * (1.0 / fs)))), k) for k in tried)[1]


def whole_spectrum(s: Spectra, fs: float) -> dict[str, np.ndarray]:
    """The features that read the whole amplitude spectrum."""
    m, dm, k, n = s.raw, s.centred, s.k, s.n
    nb, f, pw = float(len(k)), s.frequency(fs), s.density(fs)
    cm, cp = np.cumsum(m, 1), np.cumsum(pw, 1)
    sm, sfm, spw = m.sum(1), (f * m).sum(1), pw.sum(1)
    low = _first(cp >= spw[:, None] * 0.95, f)
    high = spw[:, None] - cp + pw >= spw[:, None] * 0.95
    up = np.where(high.any(1), f[len(f) - 1 - high[:, ::-1].argmax(1)], np.nan)
    tail = m[:, 1:]
    sd2 = (dm * dm).sum(1, keepdims=True)
    p = _ratio(dm * dm, sd2)
    kinds = (p > 0).sum(1)
    plogp = np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0).sum(1)
    entropy = np.where(kinds <= 1, 0.0, -plogp / np.log2(np.maximum(kinds, 2)))
    dev = f - _ratio(sfm, sm)[:, None]
    share = _ratio(m, sm[:, None])
    v2, v3, v4 = ((dev**e * share).sum(1) for e in (2, 3, 4))
    spread = np.sqrt(v2)
    turns = ((m[:, 1:-1] > m[:, :-2]) & (m[:, 2:] < m[:, 1:-1])).sum(1) if len(k) > 2 else np.zeros(len(m))
    slope = _ratio(_ratio(nb * sfm - f.sum() * sm, sm), nb * (f * f).sum() - f.sum() ** 2)
    human = (k >= nearest(0.6, n, fs)) & (k < nearest(2.5, n, fs))
    var = s.x.var(1)
    return {
        "max_frequency": np.nan_to_num(_first(cm > sm[:, None] * 0.95, f)),
        "median_frequency": np.nan_to_num(_first(cm > sm[:, None] * 0.5, f)),
        "spectral_roll_off": _first(cm >= sm[:, None] * 0.95, f), "spectral_roll_on": _first(cm >= sm[:, None] * 0.05, f),
        "max_power_spectrum": pw.max(1) / np.where(var == 0, 1.0, var),
        "power_bandwidth": np.where(spw == 0, 0.0, np.abs(up - low)),
        "spectral_centroid": _ratio(sfm, sm),
        "spectral_decrease": _ratio(((tail - m[:, :1]) / k[1:]).sum(1), tail.sum(1)),
        "spectral_distance": sm * nb / 2 - (m * (n // 2 + 1 - k)).sum(1),
        "spectral_entropy": entropy, "spectral_kurtosis": _ratio(v4, v2 * v2), "spectral_skewness": _ratio(v3, spread * v2),
        "spectral_spread": spread, "spectral_positive_turning": turns.astype(float), "spectral_slope": slope,
        "spectral_variation": 1 - _ratio((m[:, 1:] * m[:, :-1]).sum(1), np.sqrt((tail * tail).sum(1)) * np.sqrt((m[:, :-1] ** 2).sum(1))),
        "human_range_energy": _ratio((m[:, human] ** 2).sum(1), (m * m).sum(1)),
    }


def fundamental(s: Spectra, fs: float) -> np.ndarray:
    """Lowest frequency among peaks of the centred spectrum of at least 0.3 of the largest bin; a flat top counts at its middle."""
    f, out = s.frequency(fs), np.zeros(len(s.x))
    for r, m in enumerate(s.centred):
        start = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        v = m[start]
        hit = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (v[1:-1] >= m.max() * 0.3)) + 1
        if len(hit):
            out[r] = f[((start[hit] + start[hit + 1] - 1) // 2).min()]
    return out


def segment_means(s: Spectra, nfreq: int, fs: float) -> np.ndarray | None:
    """Mean power per frequency over overlapping segments under a Tukey window."""
    if s.n < 2:
        return None
    seg = min(nfreq, s.n // 2 + 1) * 2 - 2
    step = seg - seg // 8
    parts = np.lib.stride_tricks.sliding_window_view(s.x, seg, axis=1)[:, ::step]
    w = tukey(seg)
    p = np.abs(np.fft.rfft((parts - parts.mean(2, keepdims=True)) * w)) ** 2 / (w * w).sum()
    side = np.where(np.isin(np.arange(p.shape[2]), (0, p.shape[2] - 1)), 1.0, 2.0)
    return (p * side / fs).mean(1)


def cepstra(s: Spectra, n_coeff: int) -> np.ndarray | None:
    """Linear prediction cepstral coefficients; signals shorter than ``n_coeff`` have none."""
    if s.n < n_coeff:
        return None
    lags = np.stack([(s.x[:, j:] * s.x[:, : s.n - j]).sum(1) for j in range(n_coeff)], 1)
    return np.stack([_cepstrum_of(_predictor(r)) for r in lags])


def mel_cepstra(s: Spectra, fs: float, pre_emphasis: float = 0.97, nfft: int = 512, nfilt: int = 40, num_ceps: int = 12, cep_lifter: int = 22) -> np.ndarray:
    """Mel cepstral coefficients of the first ``nfft`` points."""
    x = s.x[:, :nfft]
    z = np.concatenate([x[:, :1], x[:, 1:] - pre_emphasis * x[:, :-1]], 1)
    power = np.abs(np.fft.rfft(z, nfft)) ** 2 / nfft
    bank = np.zeros((power.shape[1], nfilt))
    for mel, k, w in mel_filters(fs, nfft, nfilt):
        if k < len(bank):
            bank[k, mel] = w
    energy = power @ bank
    db = 20 * np.log10(np.where(energy == 0, np.finfo(float).eps, energy))
    c, m = np.arange(1, num_ceps + 1), np.arange(nfilt)[:, None]
    coef = db @ (np.sqrt(2 / nfilt) * np.cos(np.pi * c * (2 * m + 1) / (2 * nfilt)))
    mean = coef.sum(1, keepdims=True) / num_ceps + 1e-8
    return (coef - mean) * (1 + (cep_lifter / 2) * np.sin(np.pi * np.arange(num_ceps) / cep_lifter))


def wavelet_features(s: Spectra, widths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Mean, energy, deviation and variance per width of the Ricker wavelet transform, and its entropy."""
    stats = []
    for w in sorted(widths):
        length = int(min(10 * w, s.n))
        kernel, begin = ricker(length, w), (length - 1) // 2
        if s.n <= 256:  # row j of the matrix holds the kernel as point j meets it
            at = np.arange(s.n)[None] + begin - np.arange(s.n)[:, None]
            c = s.x @ np.where((at >= 0) & (at < length), kernel[np.clip(at, 0, length - 1)], 0.0)
        else:
            c = np.stack([np.convolve(x, kernel)[begin : begin + s.n] for x in s.x])
        stats.append((np.abs(c.mean(1)), np.sqrt((c * c).mean(1)), c.std(1), c.var(1), np.abs(c).sum(1)))
    a, e, d, v, t = (np.stack(x, 1) for x in zip(*stats, strict=True))
    total = t.sum(1, keepdims=True)
    p = _ratio(t, total)
    entropy = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0).sum(1)
    return {"wavelet_abs_mean": a, "wavelet_energy": e, "wavelet_std": d, "wavelet_var": v,
            "wavelet_entropy": np.where((s.x.sum(1) == 0) | (total[:, 0] == 0), 0.0, entropy)}


def values(s: Spectra, features: list[Feature]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the feature, values (signals, outputs)) of every feature the signals are long enough for."""
    held: dict = {}

    def table(make, *args):
        if (make, *args) not in held:
            held[make, *args] = make(s, *args)
        return held[make, *args]

    for at, f in enumerate(features):
        p, c = f.params, f.column
        if c in WHOLE_SPECTRUM:
            out = table(whole_spectrum, p["fs"])[c]
        elif c in WAVELET:
            out = table(wavelet_features, tuple(p["widths"]))[c]
        elif c == "fundamental_frequency":
            out = fundamental(s, p["fs"])
        elif c == "fft_mean_coeff":
            out = segment_means(s, p["nfreq"], p["fs"])
        elif c == "lpcc":
            out = cepstra(s, p["n_coeff"])
        else:
            out = mel_cepstra(s, **p)
        if out is None:
            continue
        if out.ndim == 2:
            out = np.where(np.isnan(out[:, :1]), 0.0, out)  # an array whose first value is NaN becomes zeros
        yield at, out.reshape(len(s.x), -1)


def extract_arrays(signal: DataFrame, keys: list[str], features: list[Feature]) -> DataFrame:
    """``keys, feature, k, value`` of every group; groups must be within the group bound."""
    packed = signal.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("p"), F.col("y").cast("double").alias("v")))).alias("_s"))
    packed = packed.select(*keys, F.col("_s.v").alias("_x"))
    schema = StructType([packed.schema[k] for k in keys]).add("feature", StringType()).add("k", IntegerType()).add("value", DoubleType())
    names = pa.array([f.name for f in features])

    def work(batches):
        for batch in batches:
            col = batch.column(len(keys))
            flat, at = col.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(np.diff(col.offsets.to_numpy())))
            there = ~np.isnan(flat)
            ends = np.append(0, np.cumsum(there))[at]
            flat, length = flat[there], np.diff(ends)
            for n in np.unique(length[length > 0]).tolist():
                rows = np.flatnonzero(length == n)
                for lo in range(0, len(rows), max(1, BLOCK // n)):
                    some = rows[lo : lo + max(1, BLOCK // n)]
                    found = list(values(Spectra(flat[ends[some][:, None] + np.arange(n)]), features))
                    wide = np.concatenate([v for _, v in found], 1) if found else np.zeros((len(some), 0))
                    number = np.concatenate([np.full(v.shape[1], a) for a, v in found]) if found else np.zeros(0, int)
                    place = np.concatenate([np.arange(v.shape[1]) for _, v in found]) if found else np.zeros(0, int)
                    own = np.repeat(some, wide.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(pa.array(own)) for i in range(len(keys))), names.take(pa.array(np.tile(number, len(some)))),
                         pa.array(np.tile(place, len(some)), pa.int32()), pa.array(wide.ravel())], schema.names)

    return packed.mapInArrow(work, schema)
