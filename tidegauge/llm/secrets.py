"""Secrets in whole texts: fixed patterns and a battery of randomness tests.

Fixed patterns (kinds ``assign``, ``access``, ``hex``) are found leftmost and without overlap within a kind. The battery looks
at what the fixed patterns leave of the runs of characters of the base64 alphabets: pieces of 20 or more characters, parted by
``=`` (but for the padding at the end) and, where no single alphabet has all characters, by ``/`` or by ``-`` and ``_``. The
encoding is inferred from a piece's characters; for that alphabet three tests ask whether it may be uniform noise: chi-squared
over character counts, Wald-Wolfowitz runs about the middle symbol, and serial correlation of neighbours. Their p-values are
combined by Fisher's rule. Ordinary names, paths and words are rejected as noise; the Benjamini-Hochberg rule, applied within
each length class over the whole corpus, keeps the expected share of true noise among the rejected at ``fdr`` or less. Runs
that are not rejected are secrets (kind ``noise``).

NULL and empty texts have no spans; very long texts are read whole; repeated rows are judged one by one and all of them count
as hypotheses; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import stored

KINDS = ("assign", "access", "hex", "noise")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_RUN = re.compile("[A-Za-z0-9+/_=-]{16,}")
SHORTEST = 20
CLASSES = (20, 24, 32, 48, 64, 128)  # lower ends of the length classes
BINS = 400  # p-values are counted in bins of a tenth of a power of e

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", _DIGIT + "abcdef"), ("HEX", _DIGIT + "ABCDEF"), ("base32", _UPPER + "234567"), ("base36", _DIGIT + _LOWER),
    ("BASE36", _DIGIT + _UPPER), ("base62", _DIGIT + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGIT + "-_"))
_INDEX = {name: {c: i for i, c in enumerate(letters)} for name, letters in ENCODINGS}


def infer(run: str) -> str | None:
    """The narrowest encoding that has all characters; runs without letters have none."""
    body = run.rstrip("=")
    if not any(c.isalpha() for c in body):
        return None
    own = set(body)
    return next((name for name, letters in ENCODINGS if own <= set(letters)), None)


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_tail(x: float, k: float) -> float:
    """Upper tail of the chi-squared distribution by the series or continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = k / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-14:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = 1 / ((step * d + b) or 1e-300)
        c = (b + step / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return min(1.0, front * h)


def battery(run: str, encoding: str) -> tuple[float, float, float, float]:
    """p-values of uniformity, runs and serial correlation, and their combination."""
    place = _INDEX[encoding]
    m = len(place)
    x = [place[c] for c in run.rstrip("=")]
    n = len(x)
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    chi = sum(c * c for c in counts.values()) * m / n - n
    # Few characters per symbol: the exact mean m - 1 and variance 2 (m - 1) (n - 1) / n are matched by a scaled law.
    scale = (n - 1) / n
    uniform = chi_squared_tail((chi - (m - 1) * (1 - scale)) / scale, m - 1) if n > 1 else 1.0
    high = [2 * v >= m for v in x]
    up = sum(high)
    down = n - up
    changes = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    if up and down and n > 2:
        mean = 2 * up * down / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 2 * _upper_normal(abs(changes - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    mid = sum(x) / n
    spread = sum((v - mid) ** 2 for v in x)
    if spread > 0 and n > 3:
        rho = sum((a - mid) * (b - mid) for a, b in zip(x, x[1:], strict=False)) / spread
        serial = 2 * _upper_normal(abs(rho + 1 / n) * math.sqrt(n))
    else:
        serial = 0.0
    floor = 1e-300
    fisher = -2 * sum(math.log(max(p, floor)) for p in (uniform, runs, serial))
    return uniform, runs, serial, chi_squared_tail(fisher, 6)


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of the fixed patterns."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for run in _RUN.finditer(text):
        lo, hi = run.span()
        if hi - lo >= 16:
            found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text, lo, hi) if m.end() - m.start() >= 16]
        if hi - lo >= 32:
            found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text, lo, hi) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _between(lo: int, hi: int, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What the fixed patterns leave of a run."""
    for a, b, _ in taken:
        if a < hi and lo < b:
            if lo < a:
                yield lo, a
            lo = b
    if lo < hi:
        yield lo, hi


def _parted(text: str, lo: int, hi: int, marks: str) -> Iterator[tuple[int, int]]:
    start = lo
    for at in range(lo, hi + 1):
        if at == hi or text[at] in marks:
            if at > start:
                yield start, at
            start = at + 1


def tested(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, encoding) of the pieces that the battery judges."""
    for run in _RUN.finditer(text):
        if run.end() - run.start() < SHORTEST:
            continue
        for lo, hi in _between(*run.span(), taken):
            body = lo + len(text[lo:hi].rstrip("="))
            for a, b in _parted(text, lo, body, "="):
                own = set(text[a:b])
                if own & set("+/") and own & set("-_"):  # the slash of a path, or the dash before a base64 value
                    pieces = _parted(text, a, b, "-_" if "+" in own else "/")
                else:
                    pieces = [(a, b)]
                for start, end in pieces:
                    if end == body and hi == run.end():
                        end = hi  # with its padding
                    if end - start >= SHORTEST and (encoding := infer(text[start:end])):
                        yield start, end, encoding


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, p) of the pieces that the battery judges."""
    return [(a, b, battery(text[a:b], encoding)[3]) for a, b, encoding in tested(text, taken)]


_FOUND = "doc_id bigint, base array<struct<start:bigint,end:bigint,kind:int>>, more array<struct<start:bigint,end:bigint,class:int,bin:int>>"


def _length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def _bin(p: float) -> int:
    """Bins rise with p; the last holds p = 1."""
    return BINS if p >= 1 else max(0, BINS - 1 - int(-10 * math.log(max(p, 1e-300))))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its fixed spans and tested runs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()),
            ("base", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))),
            ("more", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())])))])
        for batch in batches:
            keys, base, more = batch.column(0), [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                own = fixed_spans(text)
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in own])
                more.append([{"start": a, "end": b, "class": _length_class(b - a), "bin": _bin(p)} for a, b, p in candidates(text, own)])
            yield pa.RecordBatch.from_arrays([keys, pa.array(base, schema.field(1).type), pa.array(more, schema.field(2).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(find, _FOUND)


def cut_offs(found: DataFrame, fdr: float) -> dict[int, int]:
    """Per length class, the highest bin that counts as rejected (-1: none). At most a few thousand counts reach the driver."""
    counts = found.select(F.explode("more").alias("m")).groupBy("m.class", "m.bin").count().collect()
    out = {}
    for c in range(len(CLASSES)):
        own = {r["bin"]: r["count"] for r in counts if r["class"] == c}
        total, seen, last = sum(own.values()), 0, -1
        for b in sorted(own):
            seen += own[b]
            highest = 1.0 if b >= BINS - 1 else math.exp(-(BINS - 1 - b) / 10)  # upper end of the bin
            if b < BINS - 1 and highest * total <= fdr * seen:
                last = b
        out[c] = last
    return out


def find_secrets(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """doc_id and ``spans``, an array of (start, end, kind) by start and kind, over whole texts; ends are exclusive."""
    found = stored(scan(docs), "secrets")
    last = F.create_map(*[F.lit(x) for kv in cut_offs(found, fdr).items() for x in kv])
    noise = F.transform(
        F.filter("more", lambda m: m["bin"] > last[m["class"]]),
        lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    return found.select("doc_id", F.array_sort(F.concat(base, noise)).alias("spans"))


def digest(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    return find_secrets(docs, fdr).select(
        "doc_id", count(0), count(1), count(2),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, fdr: float = 0.01, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``. Needs unique doc_id; other columns are kept."""
    spans = find_secrets(docs, fdr).where(F.size("spans") > 0)
    cut = F.expr(
        "aggregate(_spans, struct('' as done, 0L as at), (a, s) -> struct(if(s.end <= a.at, a.done, concat(a.done, "
        f"substring(text, cast(a.at + 1 as int), cast(greatest(s.start - a.at, 0) as int)), '{mark}')) as done, "
        "greatest(a.at, s.end) as at), a -> concat(a.done, substring(text, cast(a.at + 1 as int))))")
    joined = docs.join(spans.select("doc_id", F.col("spans").alias("_spans")), "doc_id", "left")
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)


def digest_of(text: str) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in fixed_spans(text)).encode()).hexdigest()
