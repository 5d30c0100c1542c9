"""Language identification: TF-IDF over hashed character n-grams of whole texts and sparse softmax regression.

Characters are lower-cased, what is no letter is a blank, and n-grams of 1 to 3 characters fall into 2^14 buckets. Document
frequencies come from every training document. The regression is fitted, and its temperature calibrated, on at most
``sample`` training documents, dealt evenly over the languages (but 50 of each); everything else reads all rows.

Learned from are only rows with text, lang and doc_id whose crc32(doc_id) mod 5 is not 0; ``doc_id`` decides nothing else.
NULL texts and texts without a letter are ``und`` with score 0, as is everything when there is nothing to learn from. Repeated
rows count each time; ties go to the language that sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import ftrl
from tidegauge.llm.arrow_text import column_bytes, pieces

DIMS, LONGEST = 1 << 14, 3
_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 32. By rule from the Unicode data of Python."""
    if not _table:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _table.append(t)
    return _table[0]


def counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense n-gram counts (texts, DIMS) and the number of letters of each text."""
    rows = len(at) - 1
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    edge = np.searchsorted(starts, at)
    c = _letters()[point]
    row = np.repeat(np.arange(rows), np.diff(edge))
    letters = np.bincount(row[c != 32], minlength=rows)
    h, spots = np.zeros(len(c), np.uint32), [np.zeros(0, np.int64)]
    base = row.astype(np.int32) * DIMS
    for n in range(min(LONGEST, len(c))):
        m = len(c) - n
        h = h[:m] * _MULTIPLY[0] + c[n:] * _MULTIPLY[1]
        spot = base[:m] + (((h ^ (h >> np.uint32(15))) * _MULTIPLY[2]) >> np.uint32(32 - 14)).astype(np.int32)
        spots.append(spot[row[n:] == row[:m]] if n else spot)
    return np.bincount(np.concatenate(spots), minlength=rows * DIMS).reshape(rows, DIMS), letters


def _blocks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = column_bytes(col)
    for lo, hi, part, own in pieces(data, at, 1 << 20):
        for a in range(0, hi - lo, 64):
            b = min(a + 64, hi - lo)
            yield lo + a, lo + b, part[own[a] : own[b]], own[a : b + 1] - own[a]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def _frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per bucket, and their number (as bucket DIMS): a fixed number of counts reaches the driver."""

    def work(batches):
        df = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for lo, hi, part, own in _blocks(batch.column(0)):
                df[:DIMS] += (counts(part, own)[0] > 0).sum(0)
                df[DIMS] += hi - lo
        spot = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(df[spot])], ["bucket", "n"])

    found = train.select(F.col("text").cast("string")).mapInArrow(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(DIMS + 1)
    df[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return df[:DIMS], int(df[DIMS])


def _weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1; the term frequency is damped by a logarithm."""
    y = x.astype(np.float32)
    some = y > 0
    y[some] = np.log1p(y[some])
    y *= idf
    return y / np.maximum(np.sqrt(np.einsum("ij,ij->i", y, y))[:, None], 1e-12)


def fit(docs: DataFrame, sample: int = 3000) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, idf, weights and temperature."""
    train = _training(docs)
    sizes = {r["lang"]: r["count"] for r in train.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros(DIMS), np.zeros((DIMS, 0)), 1.0
    df, n = _frequencies(train)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    quota = max(50, sample // len(langs))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, quota / sizes[k]))])

    def work(batches):
        for batch in batches:
            for lo, hi, part, own in _blocks(batch.column(0)):
                x = counts(part, own)[0]
                at, values = zip(*[(np.flatnonzero(r).astype(np.int32), r[r > 0].astype(np.int32)) for r in x], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, hi - lo), pa.array(list(at), pa.list_(pa.int32())), pa.array(list(values), pa.list_(pa.int32()))],
                    ["lang", "at", "n"])

    some = (train.where(F.rand(11) < share[F.col("lang").cast("string")])
            .select(F.col("text").cast("string"), F.col("lang").cast("string").alias("lang")).mapInArrow(work, "lang string, at array<int>, n array<int>").toArrow())
    rows, labels, taken = [], [], dict.fromkeys(langs, 0)
    number = {k: i for i, k in enumerate(langs)}
    for lang, at, values in zip(*(some.column(c) for c in ("lang", "at", "n")), strict=True):
        lang = lang.as_py()
        taken[lang] += 1
        if taken[lang] > 2 * quota:
            continue
        at, y = at.values.to_numpy(), np.log1p(values.values.to_numpy()).astype(np.float32)
        y = y * idf[at]
        rows.append((at, y / max(float(np.sqrt((y * y).sum())), 1e-12)))
        labels.append(number[lang])
    labels = np.array(labels, np.int64)
    aside = np.arange(len(rows)) % 5 == 4  # for the temperature
    keep = [r for r, out in zip(rows, aside, strict=True) if not out]
    w = ftrl.train(keep, np.eye(len(langs))[labels[~aside]], DIMS, rate=1.0, l1=1e-3, l2=1e-4)
    logits = np.array([x @ w[at] for (at, x), out in zip(rows, aside, strict=True) if out]).reshape(-1, len(langs))
    return langs, idf, w, ftrl.temperature(logits, labels[aside])


def identify(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    langs, idf, w, heat = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast((langs, idf, w.astype(np.float32), heat))

    def work(batches):
        langs, idf, w, heat = shared.value
        for batch in batches:
            for lo, hi, part, own in _blocks(batch.column(2)):
                names, scores = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if langs:
                    x, letters = counts(part, own)
                    p = ftrl.softmax(_weigh(x, idf) @ w / heat)
                    some = letters > 0
                    names[some] = np.array(langs, object)[p.argmax(1)][some]
                    scores[some] = np.minimum(1.0, p.max(1))[some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names.tolist(), pa.string()), pa.array(scores)],
                    ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id bigint, held_out boolean, lang_pred string, score double")
