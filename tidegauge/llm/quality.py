"""Quality classifier without hand-made training labels for every row.

Ten heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of all vote
patterns estimates how each labeller votes on poor, harmful and good documents; rows of ``labels`` enter as documents whose
class is known. The targets of a hashed linear scorer over words and votes, which judges every document, are the hand labels of
labelled documents; for the others the posterior of their vote pattern, joined as five documents with the labelled ones of that
pattern, so that it fades where a pattern has many labels.

Bounds: the scorer is fitted on at most about ``train_sample`` distinct texts, drawn per class so that a rare class is covered: half
of them good, a quarter poor and a quarter harmful, by label or by the likeliest class of their votes; patterns are at most 3^10.
Everything else covers all rows. The score is thus the probability of good where good and bad are as frequent as in that sample.

NULL and empty texts have no words and are judged by their votes; very long texts are read whole; repeated rows are judged
one by one; without labels the labellers' agreement alone decides; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import ftrl
from tidegauge.llm.arrow_text import IS_WORD, PIECE, Words, column_bytes, mix, pieces
from tidegauge.llm.columns import free_name
from tidegauge.session import stored

LABELLERS = ("length", "symbols", "capitals", "repeats", "variety", "bars", "shouting", "word_size", "flagged", "sentences")
VOTES = 3  # 0 bad, 1 nothing, 2 good
DIMS = 1 << 16
FIRST_WORD = len(LABELLERS) * VOTES
_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, 13, 32, *b".,;:'\"-()?!"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_ODD = ~(IS_WORD | _PLAIN)


def _share(a, b):
    return a / np.maximum(b, 1)


def short(word: np.ndarray) -> np.ndarray:
    """The 40 bits by which flagged words are told apart."""
    return word >> np.uint64(4)


class Counted:
    """A run of texts with its distinct words and their counts."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.rows = data, at, len(at) - 1
        self.words = Words(data, at)
        row = self.words.rows().astype(np.uint64)
        keys = (row << np.uint64(44)) | (self.words.hash >> np.uint64(20))
        keys.sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        spot = np.flatnonzero(new)
        self.count = np.diff(np.append(spot, len(keys)))
        self.row, self.word = (keys[spot] >> np.uint64(44)).astype(np.int64), keys[spot] & np.uint64((1 << 44) - 1)

    def votes(self, flagged: np.ndarray) -> np.ndarray:
        """(texts, labellers) votes."""
        d, rows, w = self.data, self.rows, self.words

        def of_texts(flags):
            total = np.zeros(len(d) + 1, np.int32)
            np.cumsum(flags, dtype=np.int32, out=total[1:])
            return np.diff(total[self.at])

        odd, upper, letter, bars, shouts = (of_texts(x) for x in (_ODD[d], _UPPER[d], _LETTER[d], d == 124, d == 33))
        size, n = np.diff(self.at), np.diff(w.row_at)
        chars = np.bincount(w.rows(), w.end - w.start, rows)
        same = np.zeros(len(w), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.rows()[1:] == w.rows()[:-1])
        twice = np.bincount(w.rows(), same, rows)
        kinds = np.bincount(self.row, minlength=rows)
        ends = np.zeros(len(w), bool)
        inside = w.end < self.at[1:][w.rows()]
        ends[inside] = np.isin(d[w.end[inside]], np.frombuffer(b".?!:", np.uint8))
        stops = np.bincount(w.rows(), ends, rows)
        hits = np.bincount(self.row, np.isin(short(self.word), flagged), rows) if len(flagged) else np.zeros(rows)

        def vote(bad, good):
            return np.where(bad, 0, np.where(good, 2, 1))

        mean = _share(chars, n)
        return np.stack([
            vote(n < 3, n >= 20),
            vote(_share(odd, size) > 0.04, _share(odd, size) < 0.01),
            vote(_share(upper, letter) > 0.3, _share(upper, letter) < 0.12),
            vote(_share(twice, n) > 0.2, _share(twice, n) < 0.05),
            vote((_share(kinds, n) < 0.2) & (n >= 50), _share(kinds, n) > 0.4),
            vote(_share(bars, n) > 0.1, bars == 0),
            vote(_share(shouts, n) > 0.1, _share(shouts, n) < 0.02),
            vote((mean > 14) | (mean < 2), (mean >= 3) & (mean <= 10)),
            vote(hits > 0, np.zeros(rows, bool)),
            vote((_share(stops, n) < 0.01) & (n >= 50), _share(stops, n) > 0.02),
        ], 1)

    def features(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, dimension, value): one per vote, and damped word counts of length 1."""
        at = FIRST_WORD + (mix(self.word) % np.uint64(DIMS - FIRST_WORD)).astype(np.int64)
        x = np.log1p(self.count)
        x = x / np.sqrt(np.maximum(np.bincount(self.row, x * x, self.rows), 1e-12))[self.row]
        own = np.arange(self.rows).repeat(votes.shape[1])
        spots = (np.arange(votes.shape[1]) * VOTES + votes).ravel()
        return np.concatenate([own, self.row]), np.concatenate([spots, at]), np.concatenate([np.ones(len(spots)), x])


def pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (VOTES ** np.arange(votes.shape[1]))


def unpack(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // VOTES ** np.arange(len(LABELLERS))) % VOTES


POOR, HARMFUL, GOOD, UNKNOWN = 0, 1, 2, 3


def gold(labels: DataFrame) -> DataFrame:
    """(doc_id, gold): the class of every labelled document; of several labels the worst counts."""
    toxic, poor = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False))
    return (labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
            .agg(F.when(F.max(toxic), HARMFUL).when(F.max(poor), POOR).otherwise(GOOD).alias("gold")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def flagged_words(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Hashes of words that mark toxic documents among all labelled ones.

    Copies of one text count once: documents are told apart by the least hash of their five-word shingles. A word must stand in
    so many toxic texts that a thousandth word of the vocabulary is expected there by chance, and be 20 times as frequent there.
    """
    from tidegauge.llm.near_dedup import shingles

    marks = gold(labels).select("doc_id", (F.col("gold") == HARMFUL).cast("int").alias("toxic"))

    def slim(batches):
        """Every document's least shingle and its distinct words, five bytes each."""
        for batch in batches:
            data, at = column_bytes(batch.column(1))
            for lo, hi, part, own in pieces(data, at, PIECE):
                row, element, _ = shingles(part, own)
                out = np.zeros(hi - lo, np.uint64)
                if len(row):
                    start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    out[row[start]] = np.minimum.reduceat(mix(element), start)
                x = Counted(part, own)
                raw = np.ascontiguousarray(short(x.word).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                ends = 5 * np.searchsorted(x.row, np.arange(hi - lo + 1))
                words = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(out.view(np.int64)), words], ["doc_id", "least", "words"])

    def tally(batches):
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(0)
                size = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]) // 5
                wide = np.zeros((int(size.sum()), 8), np.uint8)
                wide[:, :5] = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, 5)
                word, back = np.unique(wide.view("<u8").ravel(), return_inverse=True)
                t = np.bincount(back, np.repeat(batch.column(1).to_numpy(), size), len(word)).astype(np.int64)
                c = np.bincount(back, minlength=len(word)) - t
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(t), pa.array(c)], ["word", "t", "c"])

    if marks.where("toxic = 1").isEmpty():
        return np.zeros(0, np.uint64)
    # Labels meet the slim rows, never the texts, by sort and merge at every size.
    known = _texts(docs).mapInArrow(slim, "doc_id bigint, least bigint, words binary").join(marks.hint("merge"), "doc_id")
    # Of a text's copies one is read; texts without shingles are read one by one.
    one = stored(known.groupBy("least", "toxic", F.when(F.col("least") == 0, F.col("doc_id")).alias("_own"))
                 .agg(F.min_by("words", "doc_id").alias("words")).select("words", "toxic"), "labelled")
    most = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    bad, good = most.get(1, 0), max(most.get(0, 0), 1)
    if not bad:
        return np.zeros(0, np.uint64)
    words = stored(one.select("words", "toxic").mapInArrow(tally, "word bigint, t bigint, c bigint")
                   .groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "words")
    least_t = max(3, int(np.ceil(np.log(1000 * max(words.count(), 1)) / -np.log(min(bad / (bad + good), 0.5)))))
    found = words.where((F.col("t") >= least_t) & (F.col("t") / bad >= 20 * (F.col("c") + 0.5) / good)).select("word").toArrow()
    return np.sort(found.column("word").to_numpy().view(np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that copies of a text share."""
    return _texts(docs).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))


def _votes(docs: DataFrame, shared) -> DataFrame:
    def work(batches):
        for batch in batches:
            data, at = column_bytes(batch.column(1))
            for lo, hi, part, own in pieces(data, at, PIECE):
                found = pattern(Counted(part, own).votes(shared.value))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(found, pa.int32())], ["doc_id", "key", "pattern"])

    return _keyed(docs).mapInArrow(work, "doc_id bigint, key bigint, pattern int")


def class_sample(rows: DataFrame, likeliest: dict[int, int], train_sample: int) -> DataFrame:
    """key, pattern and gold of at most about ``train_sample`` distinct texts: half good, a quarter poor, a quarter harmful.

    ``rows`` (key, pattern, gold); a text's class is its label (of several the worst), else the likeliest of its pattern.
    """
    texts = rows.groupBy("key").agg(F.min("pattern").alias("pattern"), F.min("gold").alias("gold"))
    sizes = texts.groupBy("pattern", "gold").count().collect()  # at most four rows a pattern
    kind = {(r["pattern"], r["gold"]): r["gold"] if r["gold"] != UNKNOWN else likeliest[r["pattern"]] for r in sizes}
    total = np.zeros(3)
    for r in sizes:
        total[kind[r["pattern"], r["gold"]]] += r["count"]
    quota = {POOR: train_sample / 4, HARMFUL: train_sample / 4, GOOD: train_sample / 2}
    shares = rows.sparkSession.createDataFrame(
        [(p, g, float(min(1.0, quota[c] / total[c]))) for (p, g), c in kind.items()], "pattern int, gold int, share double")
    drawn = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    return texts.join(F.broadcast(shares), ["pattern", "gold"]).where(drawn < F.col("share")).select("key", "pattern", "gold")


def estimate(votes: np.ndarray, weight: np.ndarray, known: np.ndarray, turns: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Class shares and P(vote | class, labeller), by expectation-maximisation over poor, harmful and good documents.

    ``votes`` (patterns, labellers), ``weight`` their counts, ``known`` the class or ``UNKNOWN``.
    """
    one = np.eye(VOTES)[votes]  # (patterns, labellers, votes)
    good = 1 / (1 + np.exp(-6 * ((votes - 1).mean(1) - 0.3)))
    harm = np.where(votes[:, LABELLERS.index("flagged")] == 0, 0.9, 0.01)
    now = np.stack([(1 - good) * (1 - harm), harm, good * (1 - harm)], 1)
    fixed = known != UNKNOWN
    for _ in range(turns):
        now[fixed] = np.eye(3)[known[fixed]]
        post = now * weight[:, None]
        share = (post.sum(0) + 1) / (post.sum() + 3)
        table = np.einsum("pc,plv->clv", post, one) + 0.5
        table /= table.sum(2, keepdims=True)
        after = posterior(votes, share, table)
        moved = np.abs(after - now)[~fixed].max(initial=0)
        now = after
        if moved < 1e-6:
            break
    return share, table


def posterior(votes: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probability of every class for each row of votes."""
    own = np.log(table)[:, np.arange(votes.shape[1]), votes].sum(2) + np.log(share)[:, None]
    return ftrl.softmax(own.T)


def pattern_chance(patterns: np.ndarray, n: np.ndarray, known: np.ndarray, good: np.ndarray, prior: float = 5.0) -> dict[int, float]:
    """Probability of good per pattern: the model's, worth ``prior`` documents, joined with the known ones of that pattern."""
    seen: dict[int, list[float]] = {}
    for p, count, mark, g in zip(patterns.tolist(), n.tolist(), known.tolist(), good.tolist(), strict=True):
        own = seen.setdefault(p, [prior * g, prior])
        if mark != UNKNOWN:
            own[0] += count * (mark == GOOD)
            own[1] += count
    return {p: a / b for p, (a, b) in seen.items()}


def fit(docs: DataFrame, labels: DataFrame, train_sample: int = 6000):
    """Flagged words and the weights of the scorer."""
    sc = docs.sparkSession.sparkContext
    flagged = flagged_words(docs, labels)
    shared = sc.broadcast(flagged)
    votes = stored(_votes(docs, shared), "votes")
    marks = gold(labels).select("doc_id", "gold")
    known_rows = votes.join(marks, "doc_id", "left").select("key", "pattern", F.coalesce("gold", F.lit(UNKNOWN)).alias("gold"))
    seen = known_rows.groupBy("pattern", "gold").count().toArrow()
    patterns, known = seen.column("pattern").to_numpy().astype(np.int64), seen.column("gold").to_numpy()
    n = seen.column("count").to_numpy().astype(float)
    if not len(n):
        return flagged, np.zeros((DIMS, 2))
    share, table = estimate(unpack(patterns), n, known)
    after = posterior(unpack(patterns), share, table)
    chance = pattern_chance(patterns, n, known, after[:, GOOD])
    picked = class_sample(known_rows, dict(zip(patterns.tolist(), after.argmax(1).tolist())), train_sample)

    def work(batches):
        for batch in batches:
            data, at = column_bytes(batch.column(0))
            for lo, hi, part, own in pieces(data, at, PIECE):
                x = Counted(part, own)
                row, dim, value = x.features(x.votes(shared.value))
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(hi - lo + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(a[order], t)) for a, t in ((dim, pa.int32()), (value, pa.float32()))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *lists], ["pattern", "gold", "at", "x"])

    some = _keyed(docs).join(F.broadcast(picked), "key").dropDuplicates(["key"]).select("text", "pattern", "gold").mapInArrow(
        work, "pattern int, gold int, at array<int>, x array<float>").toArrow()
    good = np.array([chance[p] for p in some.column("pattern").to_pylist()])
    mark = some.column("gold").to_numpy()
    good = np.where(mark == GOOD, 1.0, np.where(mark != UNKNOWN, 0.0, good))
    rows = [(a.values.to_numpy(), x.values.to_numpy()) for a, x in zip(some.column("at"), some.column("x"), strict=True)]
    return flagged, ftrl.train(rows, np.stack([1 - good, good], 1), DIMS, rate=0.2, l1=0.02, l2=1e-3)


def scored(docs: DataFrame, flagged: np.ndarray, weights: np.ndarray, score_col: str = "_score") -> DataFrame:
    """``docs`` (columns unchanged, NULL texts too) with ``score_col``, the probability of good."""
    shared = docs.sparkSession.sparkContext.broadcast((flagged, (weights[:, 1] - weights[:, 0]).astype(np.float32)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        flagged, w = shared.value
        data, at = column_bytes(texts)
        out = np.zeros(len(texts))
        for lo, hi, part, own in pieces(data, at, PIECE):
            x = Counted(part, own)
            row, dim, value = x.features(x.votes(flagged))
            out[lo:hi] = 1 / (1 + np.exp(-np.bincount(row, w[dim] * value, hi - lo)))
        return pa.array(out)

    return docs.withColumn(score_col, score(F.col("text").cast("string")))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and whether the document stays."""
    model = fit(docs, labels)
    return scored(docs.select("doc_id", "text"), *model).select(
        F.col("doc_id").cast("bigint"), F.col("_score").alias("score"), (F.col("_score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier accepts; columns unchanged."""
    name = free_name(docs.columns, "_score")
    judged = scored(docs, *fit(docs, labels), name)
    return judged.where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])

