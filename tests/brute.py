"""Direct NumPy formulas the Spark features are checked against."""

import math

import numpy as np

FS = 100.0


def dft(x):
    n = len(x)
    k = np.arange(n // 2 + 1)
    mat = np.exp(-2j * np.pi * np.outer(k, np.arange(n)) / n)
    return np.fft.rfftfreq(n, 1 / FS), mat @ np.asarray(x, float)


def ols_slope(x):
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return float(t @ x / (t @ t))


def distinct_entropy(x):
    n = len(x)
    if n <= 2:
        return 0.0
    counts = [list(x).count(v) for v in set(x)]
    return abs(-sum(c / n * math.log2(c / n) for c in counts) / math.log2(n))


def ecdf_rank(n, p):
    return sum(1 for i in range(1, n + 1) if i / n <= p)


def temporal(x):
    d = np.diff(x)
    t = np.arange(len(x)) / FS
    e = x * x
    peaks = sum(
        1 for i in range(10, len(x) - 10)
        if all(x[i] > x[j] for j in range(i - 10, i + 11) if j != i)
    )
    s = np.sign(x)
    return {
        "Area under the curve": sum(abs(a + b) for a, b in zip(x, x[1:])) / (2 * FS),
        "Autocorrelation": e.sum(),
        "Centroid": (t @ e) / e.sum() if e.sum() and t @ e else 0.0,
        "Mean absolute diff": abs(d).mean(),
        "Mean diff": d.mean(),
        "Median absolute diff": np.median(abs(d)),
        "Median diff": np.median(d),
        "Negative turning points": sum(a < 0 < b for a, b in zip(d, d[1:])),
        "Neighbourhood peaks": peaks,
        "Positive turning points": sum(a > 0 > b for a, b in zip(d, d[1:])),
        "Signal distance": np.hypot(1, d).sum(),
        "Slope": ols_slope(x),
        "Sum absolute diff": abs(d).sum(),
        "Zero crossing rate": sum(a != b for a, b in zip(s, s[1:])),
    }


def statistical(x):
    n, xs = len(x), np.sort(x)
    m, sd = x.mean(), x.std()
    flat = np.diff(x).sum() == 0
    r = [ecdf_rank(n, p) for p in (0.2, 0.8)]
    bins = np.linspace(-1, 1, 11)
    hist = [
        int(sum((x >= a) & ((x < b) if j < 9 else (x <= b)))) for j, (a, b) in enumerate(zip(bins, bins[1:]))
    ]
    return {
        "Absolute energy": (x * x).sum(),
        "Average power": (x * x).sum() / ((n - 1) / FS),
        "ECDF": [i / n for i in range(1, min(n, 10) + 1)],
        "ECDF Percentile": [x[0]] * 2 if flat else [xs[c - 1] for c in r],
        "ECDF Percentile Count": [x[0]] * 2 if flat else r,
        "Entropy": distinct_entropy(x),
        "Histogram": hist,
        "Interquartile range": np.percentile(x, 75) - np.percentile(x, 25),
        "Kurtosis": ((x - m) ** 4).mean() / sd**4 - 3 if sd else math.nan,
        "Max": x.max(),
        "Mean": m,
        "Mean absolute deviation": abs(x - m).mean(),
        "Median": np.median(x),
        "Median absolute deviation": np.median(abs(x - np.median(x))),
        "Min": x.min(),
        "Peak to peak distance": np.ptp(x),
        "Root mean square": math.sqrt((x * x).mean()),
        "Skewness": ((x - m) ** 3).mean() / sd**3 if sd else math.nan,
        "Standard deviation": sd,
        "Variance": x.var(),
    }


def hann_density(x):
    n = len(x)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    f, z = dft((x - x.mean()) * w)
    p = abs(z) ** 2 / (FS * (w * w).sum())
    p[1:] *= 2
    if n % 2 == 0:
        p[-1] /= 2
    return f, p / (x.var() or 1.0)


def spectral(x):
    f, z = dft(x)
    m = abs(z)
    cum, tot = np.cumsum(m), m.sum()
    share = m / tot
    c = f @ share
    var = ((f - c) ** 2) @ share
    dm = abs(dft(x - x.mean())[1])
    peaks = [k for k in range(1, len(dm) - 1) if dm[k - 1] < dm[k] > dm[k + 1] and dm[k] >= 0.3 * dm.max()]
    pr = dm**2 / (dm**2).sum()
    pr = pr[pr > 0]
    fw, pw = hann_density(x)
    cp = np.cumsum(pw)
    up = np.cumsum(pw[::-1])
    kk = np.arange(1, len(m))
    dd = np.diff(m)
    lo, hi = abs(f - 0.6).argmin(), abs(f - 2.5).argmin()
    first = lambda cond: f[np.flatnonzero(cond)[0]]
    fc = f - f.mean()
    return {
        "Fundamental frequency": f[peaks[0]] if peaks else 0.0,
        "Human range energy": (m[lo:hi] ** 2).sum() / (m**2).sum(),
        "Max power spectrum": pw.max(),
        "Maximum frequency": first(cum > 0.95 * tot),
        "Median frequency": first(cum > 0.5 * tot),
        "Power bandwidth": abs(fw[len(fw) - 1 - np.flatnonzero(up >= 0.95 * cp[-1])[0]] - fw[np.flatnonzero(cp >= 0.95 * cp[-1])[0]]),
        "Spectral centroid": c,
        "Spectral decrease": ((m[1:] - m[0]) / kk).sum() / m[1:].sum(),
        "Spectral distance": (np.linspace(0, tot, len(m)) - cum).sum(),
        "Spectral entropy": -(pr * np.log2(pr)).sum() / math.log2(len(pr)),
        "Spectral kurtosis": ((f - c) ** 4 @ share) / var**2,
        "Spectral positive turning points": sum(a > 0 > b for a, b in zip(dd, dd[1:])),
        "Spectral roll-off": first(cum >= 0.95 * tot),
        "Spectral roll-on": first(cum >= 0.05 * tot),
        "Spectral skewness": ((f - c) ** 3 @ share) / var**1.5,
        "Spectral slope": (fc @ m) / (fc @ fc) / tot,
        "Spectral spread": math.sqrt(var),
        "Spectral variation": 1 - (m[:-1] @ m[1:]) / math.sqrt((m[1:] @ m[1:]) * (m[:-1] @ m[:-1])),
    }


def mexican_hat(points, a):
    t = np.array([i - (points - 1) / 2 for i in range(points)])
    return 2 / (math.sqrt(3 * a) * math.pi**0.25) * (1 - t * t / a**2) * np.exp(-t * t / (2 * a * a))


def cwt(x, widths=range(1, 10)):
    out = []
    for w in widths:
        k = mexican_hat(min(10 * w, len(x)), w)
        lead = (len(k) - 1) // 2
        out.append([
            sum(k[j] * x[i + lead - j] for j in range(len(k)) if 0 <= i + lead - j < len(x))
            for i in range(len(x))
        ])
    return np.array(out)


def wavelets(x):
    c = cwt(x)
    e = abs(c).sum(1)
    p = e / e.sum()
    return {
        "Wavelet absolute mean": abs(c.mean(1)),
        "Wavelet energy": np.sqrt((c**2).mean(1)),
        "Wavelet standard deviation": c.std(1),
        "Wavelet variance": c.var(1),
        "Wavelet entropy": -(p * np.log(p)).sum(),
    }


def predictor_cepstrum(x, n=12):
    r = np.array([np.dot(x[j:], x[: len(x) - j]) for j in range(n)], dtype=np.float32).astype(float)
    mat = np.array([[r[abs(i - j)] for j in range(n - 1)] for i in range(n - 1)])
    a = np.concatenate([[1.0], np.linalg.solve(mat, -r[1:])])
    return abs(np.fft.ifft(np.log(abs(np.fft.fft(a)) ** 2)))


def mel_cepstrum(x, nfft=512, nfilt=40, keep=12, lifter=22):
    z = np.concatenate([x[:1], x[1:] - 0.97 * x[:-1]])[:nfft]
    z = np.concatenate([z, np.zeros(nfft - len(z))])
    p = abs(np.fft.fft(z)[: nfft // 2 + 1]) ** 2 / nfft
    mel = np.linspace(0, 2595 * math.log10(1 + FS / 1400), nfilt + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    b = np.floor((nfft + 1) * hz / FS)
    db = []
    for i in range(nfilt):
        tri = [
            (k - b[i]) / (b[i + 1] - b[i]) if b[i] <= k < b[i + 1]
            else (b[i + 2] - k) / (b[i + 2] - b[i + 1]) if b[i + 1] <= k < b[i + 2] else 0.0
            for k in range(len(p))
        ]
        e = np.dot(tri, p) * 2 / (hz[i + 2] - hz[i])
        db.append(20 * math.log10(e or np.finfo(float).eps))
    c = np.array([
        math.sqrt(2 / nfilt) * sum(db[m] * math.cos(math.pi * q * (2 * m + 1) / (2 * nfilt)) for m in range(nfilt))
        for q in range(1, keep + 1)
    ])
    c -= c.mean() + 1e-8
    return c * [1 + lifter / 2 * math.sin(math.pi * i / lifter) for i in range(keep)]


def segment_means(x, nfreq=256):
    size = 2 * min(nfreq, len(x) // 2 + 1) - 2
    step = size - size // 8
    w = []
    for i in range(size):
        edge = min(i, size - i) / size
        w.append(0.5 - 0.5 * math.cos(2 * math.pi * edge / 0.25) if edge < 0.125 else 1.0)
    w = np.array(w)
    rows = []
    for s in range(0, len(x) - size + 1, step):
        part = x[s : s + size]
        p = abs(dft((part - part.mean()) * w)[1]) ** 2 / (FS * (w * w).sum())
        p[1:-1] *= 2
        rows.append(p)
    return np.mean(rows, axis=0)


def density_entropy(x, kind):
    n = len(x)
    lo, hi = x.min(), (-x.max() if x.max() < 0 else x.max())
    grid = np.linspace(lo, hi, n)
    if kind == "gauss":
        p = np.exp(-0.5 * ((grid - x.mean()) / x.std()) ** 2)
    else:
        h = x.std(ddof=1) * (0.75 * n) ** -0.2
        p = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1)
    p = p / p.sum()
    p = p[p > 0]
    return -(p * np.log2(p)).sum() / math.log2(n)
