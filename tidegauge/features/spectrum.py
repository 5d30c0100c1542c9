"""Amplitude spectra, wavelet coefficients and segment spectra as tables.

Signals within the group bound are gathered and transformed by NumPy inside an
Arrow function.  Longer signals go through ``long_dft``, which spreads one
transform over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidegauge.config import CHUNK_ROWS, MAX_GROUP_ROWS, bound
from tidegauge.functions.types import VECTOR, once, vectors_struct
from tidegauge.operators.order import GroupProfile, gather, join_groups, profile
from tidegauge.session import cut_lineage


@F.pandas_udf(vectors_struct("m", "dm", "pw"))
def _spectra(signals: pd.Series) -> pd.DataFrame:
    """Magnitudes of the raw and the centred signal, and Hann-windowed power."""
    m, dm, pw = [], [], []
    for x in signals:
        x = np.asarray(x, dtype=float)
        n = len(x)
        centred = x - x.mean()
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
        m.append(np.abs(np.fft.rfft(x)))
        dm.append(np.abs(np.fft.rfft(centred)))
        pw.append(np.abs(np.fft.rfft(centred * hann)) ** 2)
    return pd.DataFrame({"m": m, "dm": dm, "pw": pw})


_spectra = once(_spectra)


def spectrum(signal: DataFrame, keys: list[str], prof: GroupProfile) -> DataFrame:
    """Bins of each signal: ``n, var, k, m, dm, pw``; frequency is ``k * fs / n``.

    ``n`` and ``var`` (population variance) repeat on every bin of a signal.
    """
    limit = bound(signal.sparkSession, MAX_GROUP_ROWS)
    if prof.longest <= limit:
        return _short_spectrum(signal, keys)
    sizes = signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    short = signal.join(sizes.filter(F.col("n") <= limit).select(*keys), keys, "left_semi")
    long = join_groups(signal, sizes.filter(F.col("n") > limit), keys, prof)
    # Several passes read the bins; a distributed transform is worth keeping.
    return cut_lineage(_short_spectrum(short, keys).unionByName(_long_spectrum(long, keys, prof)))


def _short_spectrum(signal: DataFrame, keys: list[str]) -> DataFrame:
    packed = signal.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").alias("p"), F.col("y").alias("v")))).alias("_x"),
        F.var_pop("y").alias("var"),
    )
    done = packed.withColumn("_s", _spectra("_x.v"))
    bins = F.posexplode(F.arrays_zip("_s.m", "_s.dm", "_s.pw")).alias("k", "_b")
    return done.select(*keys, F.size("_x").cast("bigint").alias("n"), "var", bins).select(
        *keys, "n", "var", F.col("k").cast("bigint").alias("k"), "_b.m", "_b.dm", "_b.pw"
    )


def _long_spectrum(signal: DataFrame, keys: list[str], prof: GroupProfile) -> DataFrame:
    """The same bins from distributed transforms of the centred signal.

    The raw spectrum differs from the centred one in bin 0 only, and the
    Hann-windowed one is a three-term difference of centred bins.
    """
    means = signal.groupBy(*keys).agg(
        F.avg("y").alias("mean"), F.sum("y").alias("total"), F.var_pop("y").alias("var")
    )
    centred = join_groups(signal, means, keys, prof).withColumns(
        {"re": F.col("y") - F.col("mean"), "im": F.lit(0.0)}
    )
    dft = long_dft(centred.select(*keys, "n", F.col("idx").alias("j"), "re", "im"), keys, prof)
    half = cut_lineage(dft.filter(F.col("k") <= F.expr("n div 2") + 1))
    # Bin k of the windowed signal is X[k]/2 - X[k-1]/4 - X[k+1]/4, with X[-1] the conjugate of X[1].
    weight = F.element_at(F.array(F.lit(-0.25), F.lit(0.5), F.lit(-0.25)), F.col("s") + 2)
    spread = half.withColumn("s", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    spread = spread.select(
        *keys, "n", (F.col("k") + F.col("s")).alias("k"), F.col("re") * weight, F.col("im") * weight,
        F.when(F.col("s") == 0, F.hypot("re", "im")).alias("dm"),
    ).toDF(*keys, "n", "k", "re", "im", "dm")
    mirror = half.filter(F.col("k") == 1).select(
        *keys, "n", F.lit(0).cast("bigint").alias("k"), (F.col("re") * -0.25).alias("re"),
        (F.col("im") * 0.25).alias("im"), F.lit(None).cast("double").alias("dm"),
    )
    bins = spread.unionByName(mirror).filter((F.col("k") >= 0) & (F.col("k") <= F.expr("n div 2")))
    bins = bins.groupBy(*keys, "n", "k").agg(
        F.sum("re").alias("re"), F.sum("im").alias("im"), F.max("dm").alias("dm")
    )
    return join_groups(bins, means.select(*keys, "total", "var"), keys, prof, "k").select(
        *keys, "n", "var", "k", F.when(F.col("k") == 0, F.abs("total")).otherwise(F.col("dm")).alias("m"), "dm",
        (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("pw"),
    )


def _column_fft(inverse: bool):
    @F.pandas_udf(vectors_struct("re", "im"))
    def run(re: pd.Series, im: pd.Series, pos: pd.Series, size: pd.Series) -> pd.DataFrame:
        out_re, out_im = [], []
        for a, b, p, n in zip(re, im, pos, size):
            z = np.zeros(int(n), dtype=complex)
            z[np.asarray(p, dtype=np.int64)] = np.asarray(a) + 1j * np.asarray(b)
            z = np.fft.ifft(z) * n if inverse else np.fft.fft(z)
            out_re.append(z.real)
            out_im.append(z.imag)
        return pd.DataFrame({"re": out_re, "im": out_im})

    return run


def _grid_fft(points: DataFrame, keys: list[str], inverse: bool = False) -> DataFrame:
    """Transform of length ``size`` (a power of two) over rows (j, re, im).

    Four-step method: with j = j1*c + j2, short transforms over j1 for every j2,
    a twiddle product, then short transforms over j2 for every k1.  No task
    holds more than one row or one column of the grid.  Absent points are zero.
    """
    fft = _column_fft(inverse)
    sign = 1.0 if inverse else -1.0

    def short(df, group, pos, length):
        packed = df.groupBy(*keys, "size", "rows", "cols", group).agg(
            F.collect_list(F.struct(pos, "re", "im")).alias("_l")
        )
        done = packed.withColumn(
            "_f", fft(F.col("_l.re"), F.col("_l.im"), F.col(f"_l.{pos}"), F.col(length))
        )
        z = F.posexplode(F.arrays_zip("_f.re", "_f.im")).alias("_k", "_z")
        return done.select(*keys, "size", "rows", "cols", group, z).select(
            *keys, "size", "rows", "cols", group, F.col("_k").cast("bigint").alias("_k"), "_z.re", "_z.im"
        )

    cells = points.withColumns({"j1": F.expr("j div cols"), "j2": F.col("j") % F.col("cols")})
    first = short(cells, "j2", "j1", "rows").withColumnRenamed("_k", "k1")
    ang = sign * 2 * math.pi * (F.col("k1") * F.col("j2")).cast("double") / F.col("size")
    c, s = F.cos(ang), F.sin(ang)
    turned = first.withColumns(
        {"re": F.col("re") * c - F.col("im") * s, "im": F.col("re") * s + F.col("im") * c}
    )
    second = short(turned, "k1", "j2", "cols")
    return second.select(
        *keys, "size", "rows", "cols", (F.col("k1") + F.col("rows") * F.col("_k")).alias("j"), "re", "im"
    )


def long_dft(points: DataFrame, keys: list[str], prof: GroupProfile | None = None) -> DataFrame:
    """Discrete Fourier transform of any length n over rows (n, j, re, im).

    Chirp method: X[k] = w[k] * sum_j (x[j] w[j]) conj(w)[k-j] with
    w[j] = exp(-i pi j^2 / n), a convolution done by power-of-two transforms.
    j^2 is reduced modulo 2n in integers to keep the angles exact.
    """
    prof = prof or profile(points, keys)
    bits = F.ceil(F.log2((2 * F.col("n")).cast("double"))).cast("int")
    power = lambda b: F.expr(f"shiftleft(1L, {b})")
    shape = points.select(*keys, "n").distinct().withColumn("_b", bits)
    shape = shape.withColumns({"size": power("_b"), "rows": power("_b div 2"), "cols": power("_b - _b div 2")})
    sq = F.pmod(F.expr("cast(j as decimal(38,0)) * j"), (2 * F.col("n")).cast("decimal(38,0)"))
    angle = sq.cast("double") * math.pi / F.col("n")
    x = join_groups(points, shape.select(*keys, "size", "rows", "cols"), keys, prof, "j")
    c, s = F.cos(angle), F.sin(angle)
    a = x.withColumns({"re": F.col("re") * c + F.col("im") * s, "im": F.col("im") * c - F.col("re") * s})
    chirp = x.select(*keys, "n", "size", "rows", "cols", "j", c.alias("re"), s.alias("im"))
    back = chirp.filter("j > 0").withColumn("j", F.col("size") - F.col("j"))
    fa = _grid_fft(a.drop("n"), keys)
    fb = _grid_fft(chirp.unionByName(back).drop("n"), keys).select(
        *keys, "j", F.col("re").alias("bre"), F.col("im").alias("bim")
    )
    prod = fa.join(fb, [*keys, "j"]).select(
        *keys, "size", "rows", "cols", "j",
        (F.col("re") * F.col("bre") - F.col("im") * F.col("bim")).alias("re"),
        (F.col("re") * F.col("bim") + F.col("im") * F.col("bre")).alias("im"),
    )
    conv = join_groups(_grid_fft(prod, keys, inverse=True), shape.select(*keys, "n"), keys, prof, "j").filter("j < n")
    re, im = F.col("re") / F.col("size"), F.col("im") / F.col("size")
    return conv.select(
        *keys, "n", F.col("j").alias("k"), (re * c + im * s).alias("re"), (im * c - re * s).alias("im")
    )


def ricker(points: int, width: float) -> np.ndarray:
    """Ricker wavelet sampled at ``points`` places around its centre."""
    t = np.arange(points) - (points - 1.0) / 2
    r = (t / width) ** 2
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - r) * np.exp(-r / 2)


def _convolver(widths: tuple[int, ...], drop: list[str]):
    """Convolve each chunk with each kernel; one width at a time keeps batches small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = list(zip(batch["x"], batch["skip"], batch["count"], batch["n"]))
            kept = batch.drop(columns=drop)
            for w in widths:
                rows = []
                for x, skip, count, size in spans:
                    length = int(min(10 * w, size))
                    full = np.convolve(np.asarray(x, dtype=float), ricker(length, w))
                    begin = int(skip) + (length - 1) // 2
                    rows.append(full[begin : begin + int(count)])
                yield kept.assign(width=w, c=rows)

    return run


def wavelet(signal: DataFrame, keys: list[str], widths: tuple[int, ...]) -> DataFrame:
    """Continuous wavelet transform with the Ricker wavelet: ``width, idx, c``.

    A kernel reaches at most ``5 * max(widths)`` points to each side, so signals
    are cut into chunks that carry that many points of their neighbours.  The
    kernel is as long as the signal where that is shorter than ten widths; such
    a signal lies whole in chunk 0, so its length is the length of the chunk.
    """
    reach = 5 * max(widths)
    size = max(bound(signal.sparkSession, CHUNK_ROWS), 2 * reach)
    own = F.expr(f"idx div {size}")
    off = F.col("idx") % size
    chunks = F.array_compact(
        F.array(own, F.when((off < reach) & (own > 0), own - 1), F.when(off >= size - reach, own + 1))
    )
    placed = signal.select(*keys, "idx", "y", F.explode(chunks).alias("_chunk"))
    packed = gather_span(placed, [*keys, "_chunk"])
    start = F.col("_chunk") * size
    count = F.least(F.lit(size).cast("bigint"), F.col("lo") + F.size("x") - start)
    length = F.when(F.col("_chunk") == 0, F.size("x")).otherwise(F.lit(2 * reach))
    packed = packed.filter(count > 0).select(
        *keys, start.alias("start"), "x", length.alias("n"), (start - F.col("lo")).alias("skip"), count.alias("count")
    )
    extra = [StructField("width", IntegerType()), StructField("c", VECTOR)]
    schema = StructType([packed.schema[k] for k in [*keys, "start"]] + extra)
    per = packed.mapInPandas(_convolver(tuple(widths), ["x", "n", "skip", "count"]), schema)
    return per.select(*keys, "width", "start", F.posexplode("c").alias("_i", "c")).select(
        *keys, "width", (F.col("start") + F.col("_i")).alias("idx"), "c"
    )


def gather_span(df: DataFrame, keys: list[str]) -> DataFrame:
    """Array of a bounded chunk and the position of its first point."""
    packed = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").alias("p"), F.col("y").alias("v")))).alias("_s")
    )
    return packed.select(*keys, F.col("_s.v").alias("x"), F.element_at("_s.p", 1).alias("lo"))


@F.pandas_udf(VECTOR)
def _segment_power(segments: pd.Series) -> pd.Series:
    """Squared magnitudes of a centred segment under a Tukey window (taper 0.25)."""
    out = []
    for x in segments:
        x = np.asarray(x, dtype=float)
        w = tukey(len(x))
        out.append(np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (w * w).sum())
    return pd.Series(out)


_segment_power = once(_segment_power)


def tukey(points: int, taper: float = 0.25) -> np.ndarray:
    """Periodic Tukey window: cosine flanks over ``taper`` of its length."""
    t = np.arange(points) / points
    edge = np.minimum(t, 1 - t)
    return np.where(edge < taper / 2, 0.5 - 0.5 * np.cos(2 * np.pi * edge / taper), 1.0)


def segment_spectrum(
    signal: DataFrame, keys: list[str], nfreq: int, fs: float, sizes: DataFrame, prof: GroupProfile
) -> DataFrame:
    """Mean power density per frequency over overlapping segments: ``k, p``.

    Segments hold ``2*nfreq - 2`` points (less for short signals) and overlap by
    an eighth, so every gathered group is small.
    """
    half = F.least(F.lit(nfreq).cast("bigint"), F.expr("n div 2") + 1)
    geo = sizes.select(*keys, "n", (half * 2 - 2).alias("seg")).filter("n >= 2")
    geo = geo.withColumn("step", F.col("seg") - F.expr("seg div 8"))
    geo = geo.withColumn("last", F.expr("(n - seg) div step"))
    rows = join_groups(signal.select(*keys, "idx", "y"), geo.drop("n"), keys, prof)
    low = F.greatest(F.ceil((F.col("idx") - F.col("seg") + 1) / F.col("step")), F.lit(0).cast("bigint"))
    high = F.least(F.expr("idx div step"), F.col("last"))
    ids = F.explode(F.when(low <= high, F.sequence(low, F.greatest(low, high))))
    placed = rows.withColumn("_sid", ids)
    packed = gather(placed, [*keys, "_sid"], "idx", "y").withColumn("_p", _segment_power("x"))
    top = F.size("_p") - 1
    bins = packed.select(*keys, top.alias("_top"), F.posexplode("_p").alias("k", "p"))
    side = F.when((F.col("k") == 0) | (F.col("k") == F.col("_top")), F.lit(1.0)).otherwise(F.lit(2.0))
    return bins.groupBy(*keys, "k").agg(F.avg(F.col("p") * side / F.lit(fs)).alias("p"))
