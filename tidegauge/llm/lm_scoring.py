"""Cross-entropy difference of two character n-gram models.

The target model counts the documents labelled good and not toxic, the background model all documents. Both are interpolated
trigram models of one form over one vocabulary, the characters of the corpus. Counts are exact: a table of one row per trigram,
from which those of pairs and contexts follow. A document's score is the mean over its characters of target loss minus
background loss (in nats): the lower, the more it is like the target.

Documents are dealt into blocks of about ``block`` characters. A block counts its trigrams, and gets back the losses of just
those to score its documents, so no task holds the whole model.

NULL and empty texts have no characters and score 0; very long texts are read whole; repeated rows count each time; without
target documents the target model is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.arrow_text import column_bytes, pieces
from tidegauge.session import stored

WEIGHTS = (0.05, 0.15, 0.3, 0.5)  # uniform, characters, pairs, triples
STARTS = (0, sys.maxunicode + 1)  # most characters there can be
BLOCK = 1 << 22
BITS = 21  # of a character in a trigram's key; 0 is the mark before a text
_ONE = (1 << BITS) - 1


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of every character, and the key of it and the two before; a text begins after two marks."""
    c = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    edge = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(edge))
    first = edge[:-1][np.diff(edge) > 0]
    one, two = np.zeros_like(c), np.zeros_like(c)
    one[1:], two[2:] = c[:-1], c[:-2]
    one[first] = 0
    two[first] = 0
    second = first + 1
    second = second[second < len(c)]
    two[second[row[second] == row[second - 1]]] = 0
    return row, (two << 2 * BITS) | (one << BITS) | c


def _good(labels: DataFrame) -> DataFrame:
    return (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
            .agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _blocks(docs: DataFrame, block: int) -> int:
    """How many blocks the texts make; one number reaches the driver."""
    return max(1, -(-(_texts(docs).agg(F.sum(F.length("text"))).first()[0] or 0) // block))


def _dealt(df: DataFrame, blocks: int) -> DataFrame:
    """With ``block``, which follows from doc_id, and without one from the text."""
    own = F.xxhash64("doc_id")
    if "text" in df.columns:
        own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(own)
    return df.withColumn("block", F.pmod(own, F.lit(blocks)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts (keys, 2)."""
    key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.concatenate([c for _, c in parts])
    return key, np.stack([np.bincount(back, n[:, m], len(key)) for m in range(2)], 1).astype(np.int64)


def block_counts(docs: DataFrame, labels: DataFrame, blocks: int) -> DataFrame:
    """(block, key, target, every): how often each trigram stands in the target and in all documents of a block."""

    def work(key: tuple, texts: pa.Table, good: pa.Table) -> pa.Table:
        data, at = column_bytes(texts.column("text"))
        target = np.isin(texts.column("doc_id").fill_null(0).to_numpy(), good.column("doc_id").to_numpy())
        target &= texts.column("doc_id").is_valid().to_numpy()
        out = [(np.zeros(0, np.int64), np.zeros((0, 2), np.int64))]
        for lo, hi, part, own in pieces(data, at):
            row, keys = trigrams(part, own)
            found, back = np.unique(keys, return_inverse=True)
            chosen = target[lo:hi][row]
            out.append((found, np.stack([np.bincount(back, chosen, len(found)), np.bincount(back, minlength=len(found))], 1).astype(np.int64)))
        found, n = _merged(out)
        return pa.table({"block": pa.repeat(key[0], len(found)).cast(pa.int64()), "key": found, "target": n[:, 0], "every": n[:, 1]})

    good = _dealt(_good(labels), blocks).groupBy("block")
    return _dealt(_texts(docs), blocks).groupBy("block").cogroup(good).applyInArrow(
        work, "block bigint, key bigint, target bigint, every bigint")


def _summed(counts: DataFrame, key) -> DataFrame:
    return counts.groupBy(key.alias("key")).agg(F.sum("target").alias("target"), F.sum("every").alias("every"))


def _last(key="key"):
    return F.col(key).bitwiseAND(F.lit(_ONE))


def _characters(counts: DataFrame) -> np.ndarray:
    found = _summed(counts, _last()).toArrow()  # at most STARTS[1] rows
    return np.stack([found.column(m).to_numpy() for m in ("target", "every")])


def count(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """(2, characters) counts of the target and of all documents."""
    return _characters(block_counts(docs, labels, _blocks(docs, BLOCK)))


def losses(counts: DataFrame) -> DataFrame:
    """(key, target_loss, background_loss): the negative log probability of every trigram's last character."""
    table = _characters(counts)
    vocabulary, total = table.shape[1] + 1, np.maximum(table.sum(1), 1)
    middle = F.shiftright("key", BITS).bitwiseAND(F.lit(_ONE))
    every = _summed(counts, F.col("key"))
    # Tables of one row per character are broadcast: Unicode bounds them.
    ones = _summed(counts, _last()).toDF("_c", "one_target", "one_every")
    before = _summed(counts, middle).toDF("_b", "before_target", "before_every")
    pair = Window.partitionBy(F.col("key").bitwiseAND(F.lit((1 << 2 * BITS) - 1)))
    context = Window.partitionBy(F.shiftright("key", BITS))
    for m in ("target", "every"):
        every = every.withColumn(f"pair_{m}", F.sum(m).over(pair))
    for m in ("target", "every"):
        every = every.withColumn(f"context_{m}", F.sum(m).over(context))
    joined = every.join(F.broadcast(ones), _last() == F.col("_c")).join(F.broadcast(before), middle == F.col("_b"))

    def loss(m, n):
        return -F.log(
            F.lit(WEIGHTS[0] / vocabulary) + F.lit(WEIGHTS[1] / float(n)) * F.col(f"one_{m}")
            + F.lit(WEIGHTS[2]) * F.col(f"pair_{m}") / F.greatest(F.col(f"before_{m}"), F.lit(1))
            + F.lit(WEIGHTS[3]) * F.col(m) / F.greatest(F.col(f"context_{m}"), F.lit(1)))

    return joined.select("key", loss("target", total[0]).alias("target_loss"), loss("every", total[1]).alias("background_loss"))


def score(docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every document."""
    blocks = _blocks(docs, block)
    counts = stored(block_counts(docs, labels, blocks), "trigrams")
    own = counts.select("block", "key").join(losses(counts).hint("merge"), "key")

    def work(key: tuple, texts: pa.Table, table: pa.Table) -> pa.Table:
        data, at = column_bytes(texts.column("text"))
        keys = table.column("key").to_numpy()
        order = np.argsort(keys)
        keys = keys[order]
        models = [table.column(m).to_numpy()[order] for m in ("target_loss", "background_loss")]
        n, sums = np.zeros(len(texts), np.int64), np.zeros((2, len(texts)))
        for lo, hi, part, edges in pieces(data, at):
            row, found = trigrams(part, edges)
            n[lo:hi] = np.bincount(row, minlength=hi - lo)
            if len(found):
                spot = np.searchsorted(keys, found)
                for m, model in enumerate(models):
                    sums[m, lo:hi] = np.bincount(row, model[spot], hi - lo)
        means = sums / np.maximum(n, 1)
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": n, "target_loss": means[0],
                         "background_loss": means[1], "score": means[0] - means[1]})

    return _dealt(_texts(docs), blocks).groupBy("block").cogroup(own.groupBy("block")).applyInArrow(
        work, "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double")
