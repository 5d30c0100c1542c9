"""Ranked lexical search, best first over intervals of documents bounded by range maxima.

Documents are reduced to the terms that some query holds, stored with their counts, and read again in shards of about a
million postings. In a shard, documents are numbered by id, every term has a posting list of impacts, and a sparse table over
each list answers "largest impact among these documents" in two look-ups. For a query, the answers of its terms add up to a
bound on an interval of documents. The interval of the highest bound is taken first and split at the document with the largest
impact in it (and halved, where a part keeps more than half of it); an interval of at most ``leaf`` documents is scored
outright. The search stops when no interval left can beat the k-th score found so far, which is carried from shard to shard of
a task. The best ``k`` of every task meet in two rounds of ranking.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z fold. They are told apart by 64-bit hashes:
for 10^5 terms of queries and 10^9 distinct terms of documents, the chance of any mix-up is about 10^-5. Scores are whole
numbers and exact.

Queries are broadcast in blocks of at most about ``most_pairs`` distinct (query, term) pairs and ``most_queries`` queries; more
of them take further passes over the documents. NULL texts have no terms; queries without terms find nothing; equal scores go
by id, NULL ids last; rows of equal id are documents, or queries, of their own; very long texts count whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.arrow_text import Words, column_bytes, pieces, signed
from tidegauge.session import stored

SHARD = 1 << 20  # postings indexed at once
LEAF = 8  # documents of an interval that are scored outright
BATCH = 128  # intervals taken at once
NO_ID = np.iinfo(np.int64).max


def term_counts(data: np.ndarray, at: np.ndarray, known: np.ndarray | None = None):
    """Terms of every text, the (text, term, count) of the known ones (all, if None); terms are places in ``known``, or hashes."""
    words = Words(data, at)
    h, row = signed(words.hash), words.rows()
    if known is None:
        by = np.lexsort((h, row))
        row, h = row[by], h[by]
    else:
        place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        hit = known[place] == h if len(known) else np.zeros(len(h), bool)
        key = np.sort(row[hit] * len(known) + place[hit])
        row, h = np.divmod(key, max(len(known), 1))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return np.diff(words.row_at), row[first], h[first], np.diff(np.append(first, len(h)))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, item_id, term): the distinct terms of every row, which gets a number of its own; queries without terms are left out."""
    own = queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches):
        for batch in batches:
            data, at = column_bytes(batch.column(2))
            for lo, hi, part, edges in pieces(data, at):
                _, row, term, _ = term_counts(part, edges)
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row)), pa.array(term)],
                                                 ["query", "item_id", "term"])

    kind = own.schema["item_id"].dataType.simpleString()
    return own.mapInArrow(work, f"query bigint, item_id {kind}, term bigint")


def postings(docs: DataFrame, known, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: how many terms it has, and which known ones how often."""

    def work(batches):
        for batch in batches:
            data, at = column_bytes(batch.column(1))
            for lo, hi, part, edges in pieces(data, at):
                n, row, term, count = term_counts(part, edges, known.value)
                offsets = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32()))], ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a document's length counts for, 100 at the mean."""
    if 50 * int(n.max(initial=0)) * documents < 1 << 63:
        return 50 + 50 * n * documents // terms
    return 50 + np.array([50 * int(x) * documents // terms for x in n], np.int64)


class Shard:
    """Posting lists of some documents with a sparse table of range maxima over each."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, weights: np.ndarray,
                 documents: int, terms: int):
        by = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[by] = np.arange(len(ids))
        self.ids, self.size = ids[by], len(ids)
        m = norms(n, documents, terms)
        impact = weights[term] * (1_000_000_000 * count // (1000 * count + 20 * m[row]))
        key = term * self.size + number[row]
        by = np.argsort(key)
        self.key, self.impact = key[by], impact[by]
        self.doc = self.key % max(self.size, 1)
        lists = np.flatnonzero(np.diff(np.concatenate([[-1], self.key // max(self.size, 1)])))
        longest = int(np.diff(np.append(lists, len(self.key))).max(initial=1))
        self.best = [np.arange(len(self.key), dtype=np.int32)]  # best[k][p]: place of the largest impact among 2^k from p
        for k in range(longest.bit_length() - 1):
            wide, half = self.best[-1].copy(), 1 << k
            a, b = self.best[-1][:-half], self.best[-1][half:]
            wide[:-half] = np.where(self.impact[a] >= self.impact[b], a, b)
            self.best.append(wide)
        self.best = np.stack(self.best)

    def bounds(self, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the terms' range maxima in every interval of documents, and the document of the largest."""
        a = np.searchsorted(self.key, terms * self.size + lo[:, None])
        b = np.searchsorted(self.key, terms * self.size + hi[:, None])
        length = b - a
        k = np.frexp(np.maximum(length, 1))[1] - 1
        a = np.minimum(a, len(self.key) - 1)
        one, two = self.best[k, a], self.best[k, np.where(length > 0, b - (1 << k), a)]
        one = np.where(self.impact[one] >= self.impact[two], one, two)
        top = np.where(length > 0, self.impact[one], 0)
        widest = top.argmax(1)
        return top.sum(1), self.doc[one[np.arange(len(lo)), widest]]

    def scores(self, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the intervals, and their scores."""
        size = hi - lo
        before = np.cumsum(size) - size
        docs = np.repeat(lo - before, size) + np.arange(size.sum())
        a = np.searchsorted(self.key, terms * self.size + lo[:, None])
        b = np.searchsorted(self.key, terms * self.size + hi[:, None])
        length = (b - a).ravel()
        p = np.repeat(a.ravel() - (np.cumsum(length) - length), length) + np.arange(length.sum())
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, self.doc[p] + np.repeat(np.repeat(before - lo, len(terms)), length), self.impact[p])
        return docs, out

    def search(self, terms: np.ndarray, k: int, found: tuple[np.ndarray, np.ndarray], leaf: int = LEAF, batch: int = BATCH):
        """The k best (score, id), those ``found`` before among them, and how many documents were scored."""
        score, ids = found
        lo, hi, opened = np.zeros(1, np.int64), np.full(1, self.size), 0
        bound, middle = self.bounds(terms, lo, hi)
        while len(lo):
            if len(score) == k:
                open_ = (bound > score[-1]) | ((bound == score[-1]) & (self.ids[lo] < ids[-1]))
            else:
                open_ = bound > 0
            lo, hi, bound, middle = lo[open_], hi[open_], bound[open_], middle[open_]
            if not len(lo):
                break
            by = np.lexsort((lo, -bound))
            now, later = by[:batch], by[batch:]
            small = hi[now] - lo[now] <= leaf
            done, split = now[small], now[~small]
            if len(done):
                docs, own = self.scores(terms, lo[done], hi[done])
                opened += len(docs)
                some = own > 0
                score, ids = np.concatenate([score, own[some]]), np.concatenate([ids, self.ids[docs[some]]])
                best = np.lexsort((ids, -score))[:k]
                score, ids = score[best], ids[best]
            l_, h_, d = lo[split], hi[split], middle[split]
            half = (l_ + h_) // 2
            cut = np.sort(np.stack([l_, np.clip(half, l_, h_), d, d + 1, h_]), 0)
            a, b = cut[:-1].ravel(), cut[1:].ravel()
            a, b = a[a < b], b[a < b]
            if len(a):
                more, at = self.bounds(terms, a, b)
                lo, hi = np.concatenate([lo[later], a]), np.concatenate([hi[later], b])
                bound, middle = np.concatenate([bound[later], more]), np.concatenate([middle[later], at])
            else:
                lo, hi, bound, middle = lo[later], hi[later], bound[later], middle[later]
        return (score, ids), opened


def _shards(batches, size: int):
    """Postings of a task, some ``size`` at a time."""
    kept, held = [], 0
    for batch in batches:
        kept.append(batch)
        held += len(batch.column(2).flatten())
        if held >= size:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept, held = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _search_all(rows: DataFrame, shared, k: int, leaf: int, shard: int) -> DataFrame:
    """(task, query, doc_id, score): the k best of every query in each task."""

    def work(batches):
        from pyspark import TaskContext

        asked, edge, terms, weights, documents, total = shared.value
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for table in _shards(batches, shard):
            column = {c: table.column(c).chunk(0) if table.num_rows else table.column(c).combine_chunks() for c in table.column_names}
            lengths = np.diff(column["terms"].offsets.to_numpy())
            index = Shard(column["doc_id"].fill_null(NO_ID).to_numpy(), column["n"].to_numpy(), np.repeat(np.arange(len(lengths)), lengths),
                          column["terms"].flatten().to_numpy().astype(np.int64), column["counts"].flatten().to_numpy().astype(np.int64),
                          weights, documents, total)
            if len(index.key):
                for q in range(len(asked)):
                    found[q], _ = index.search(terms[edge[q] : edge[q + 1]], k, found[q], leaf)
        task = TaskContext.get().partitionId()
        for q, (score, ids) in enumerate(found):
            if len(score):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), task, np.int64)), pa.array(np.full(len(ids), asked[q])), pa.array(ids, mask=ids == NO_ID), pa.array(score)],
                    ["task", "query", "doc_id", "score"])

    return rows.mapInArrow(work, "task bigint, query bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id",
           query_text_col: str = "text", leaf: int = LEAF, shard: int = SHARD, most_pairs: int = 1 << 20, most_queries: int = 20_000) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` documents that score highest, above 0, for every query."""
    spark = docs.sparkSession
    asked = stored(query_terms(queries, query_id_col, query_text_col), "query-terms")
    size = asked.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("query").alias("queries")).first()
    blocks = max(-(-size["pairs"] // most_pairs), -(-size["queries"] // most_queries))
    out = None
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        pairs = some.select("query", "term").toArrow()  # a stated number of rows, see above
        query, term = pairs.column("query").to_numpy(), pairs.column("term").to_numpy()
        known, place = np.unique(term, return_inverse=True)
        by = np.lexsort((place, query))
        query, place = query[by], place[by].astype(np.int64)
        numbers, edge = np.unique(query, return_index=True)
        shared_terms = spark.sparkContext.broadcast(known)
        rows = stored(postings(docs, shared_terms, id_col, text_col), "postings")
        total = rows.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
        if not total["documents"]:
            continue
        holding = np.zeros(len(known), np.int64)
        df = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most one row per term of the block
        holding[df.column("term").to_numpy()] = df.column("count").to_numpy()
        weights = np.array([weight(total["documents"], int(h)) for h in holding], np.int64)
        shared = spark.sparkContext.broadcast((numbers, np.append(edge, len(query)), place, weights, total["documents"], total["terms"]))
        best = _search_all(rows, shared, k, leaf, shard)
        out = best if out is None else out.unionByName(best)
    kind = asked.schema["item_id"].dataType.simpleString()
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = out.withColumn("_part", F.col("task") % 256)
    for keys in (["query", "_part"], ["query"]):
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = asked.select("query", "item_id").distinct()
    return some.join(names, "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN size USING (doc_id), whole GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50"""
