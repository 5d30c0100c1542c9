"""Periodic runs of words, found on an enhanced suffix array by the branching-tandem test.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), at least ``times * q`` and
``shortest`` words long, that no neighbour extends. Every run ends in one branching tandem: two equal blocks of q words, one
after the other, whose first words start suffixes in different children of one LCP interval of depth q. So for every LCP
interval, and every suffix i in all of its children but the largest, the inverse suffix array tells whether i + depth or
i - depth lies in the interval too, in another child. A tandem found is rotated to the left as far as its words repeat, which
gives the whole run; runs of the same extent are merged into that of the smallest period. Intervals come from next-smaller
searches on the LCP array; no tree is built.

Texts are worked on in batches inside a task, each suffix staying within its text. Stretches of 2^k words are ranked by
doubling, and the ranks kept: they give the LCP values and the rotations exactly. A task holds about four bytes times k for
every word of a batch; one text is always held whole.

NULL and empty texts, and texts of white space only, have no words and no runs; very long texts are searched whole; repeated
rows and rows without id are searched one by one; other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.arrow_text import column_bytes, pieces
from tidegauge.llm.columns import free_name

CHUNK = 1 << 20  # bytes of text searched at once
RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))


class WhiteWords:
    """Words between white space (space, \\t, \\n, \\v, \\f, \\r) of a run of texts, with a number for each distinct word."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(data)
        inside = (data != 32) & ((data < 9) | (data > 13))
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            begins, ends = at[:-1][at[:-1] < n], at[1:][at[1:] > 0] - 1
            first[begins], last[ends] = inside[begins], inside[ends]
        start = np.flatnonzero(first)
        self.size = np.flatnonzero(last) + 1 - start
        self.edge = np.searchsorted(start, at)  # words of text r: edge[r]:edge[r + 1]
        self.bytes = data[inside]
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        words = pa.Array.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.bytes))])
        self.code = words.dictionary_encode().indices.to_numpy().astype(np.int64)

    def joined(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each text with one space between them: bytes of all texts, and where each begins."""
        chosen = np.flatnonzero(kept)
        size = self.size[chosen] + 1
        to = np.cumsum(size)
        out = np.full(to[-1] if len(to) else 0, 32, np.uint8)
        spot = np.arange(int(self.size[chosen].sum()))
        inner = np.concatenate([[0], np.cumsum(self.size[chosen])])[:-1]
        own = np.repeat(np.arange(len(chosen)), self.size[chosen])
        spot -= inner[own]
        out[(to - size)[own] + spot] = self.bytes[self.at[chosen][own] + spot]
        edge = np.searchsorted(chosen, self.edge)
        ends = np.concatenate([[0], to])[edge]
        some = np.flatnonzero(np.diff(edge))
        drop = np.zeros(len(out), bool)
        drop[ends[some + 1] - 1] = True  # the space after a text's last word
        gone = np.concatenate([[0], np.cumsum(np.diff(edge) > 0)])
        return out[~drop], ends - gone


def suffix_ranks(code: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of each text, one after the other, and the ranks of the stretches of 1, 2, 4, ... words.

    A rank is the first place its group has in the suffix array. The last ranks are the inverse of the suffix array. Each
    array of ranks ends with a -1.
    """
    n = len(code)
    text = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    end = edge[1:][text]
    key = text * (int(code.max(initial=0)) + 1) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    slots, levels, rank = np.arange(n), [], np.full(n + 1, -1, np.int32)
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[slots]] = slots[new][np.cumsum(new) - 1]
        levels.append(rank)
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = slots[~alone]
        if not len(slots):
            return order, levels
        i = order[slots]
        after = i + (1 << len(levels) - 1)
        follow = np.where(after < end[i], rank[np.minimum(after, n)] + 1, 0)
        key = rank[i].astype(np.int64) * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        key, order[slots] = key[by], i[by]
        rank = rank.copy()


def neighbour_depths(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP values: of the suffixes at x - 1 and x; 0 at both ends and between texts."""
    out = np.zeros(len(order) + 1, np.int32)
    x = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[x - 1], order[x]
    depth = np.zeros(len(x), np.int64)
    for k in reversed(range(len(levels))):
        depth += (levels[k][a + depth] == levels[k][b + depth]).astype(np.int64) << k
    out[x] = depth
    return out


def smaller_children(depth: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """Children of all LCP intervals but the largest of each: first and last place of the child and of its interval, depth.

    Only intervals as deep as ``most`` at their place, or less deep, are listed.
    """
    x = np.flatnonzero((depth > 0) & (depth <= most))
    if not len(x):
        return (np.zeros(0, np.int64),) * 5
    live = np.concatenate([[0], (depth > 0).view(np.int8), [0]])
    jumps = np.flatnonzero(np.diff(live))
    top = int((jumps[1::2] - jumps[::2]).max()).bit_length()
    least = [depth]  # least[k][y]: of the 2^k values from y
    for k in range(top):
        wide = least[-1].copy()
        wide[: -(1 << k)] = np.minimum(wide[: -(1 << k)], least[-1][1 << k :])
        wide[-(1 << k) :] = 0
        least.append(wide)
    d, n = depth[x], len(depth)

    def before(limit):
        at = x.copy()
        for k in reversed(range(top)):
            to = at - (1 << k)
            at = np.where((to >= 0) & (least[k][np.maximum(to, 0)] >= limit), to, at)
        return at - 1

    def behind(limit):
        at = x + 1
        for k in reversed(range(top)):
            at = np.where(least[k][np.minimum(at, n - 1)] >= limit, at + (1 << k), at)
        return at

    left, right = before(d), behind(d) - 1
    first = before(d + 1) == left  # the interval's first inner edge
    lo, hi = np.concatenate([x, left[first]]), np.concatenate([behind(d + 1) - 1, x[first] - 1])
    left, right, d = (np.concatenate([v, v[first]]).astype(np.int64) for v in (left, right, d))
    by = np.lexsort((hi - lo, d, left))
    lo, hi, left, right, d = (v[by] for v in (lo, hi, left, right, d))
    largest = np.ones(len(lo), bool)
    largest[:-1] = (left[1:] != left[:-1]) | (d[1:] != d[:-1])
    return tuple(v[~largest] for v in (lo, hi, left, right, d))


def runs_of(code: np.ndarray, edge: np.ndarray, times: int = 4, shortest: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in all words), end and period of every run, by start, then period."""
    none = (np.zeros(0, np.int64),) * 3
    if len(code) < shortest:
        return none
    order, levels = suffix_ranks(code, edge)
    depth = neighbour_depths(order, levels)
    begin, length = np.repeat(edge[:-1], np.diff(edge)), np.repeat(np.diff(edge), np.diff(edge))
    lo, hi, left, right, d = smaller_children(depth, np.append(length[order] // times, 0))
    size = hi - lo + 1
    child = np.repeat(np.arange(len(lo)), size)
    i = order[lo[child] + np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size)]
    place = levels[-1]
    found = []
    for sign in (1, -1):
        j = i + sign * d[child]
        inside = (j >= 0) & (j < len(code))
        spot = np.where(inside, place[np.where(inside, j, 0)], -1)
        hit = (spot >= left[child]) & (spot <= right[child]) & ((spot < lo[child]) | (spot > hi[child]))
        found.append(np.minimum(i, j)[hit] * (len(code) + 1) + d[child][hit])
    start, period = np.divmod(np.unique(np.concatenate(found)), len(code) + 1)
    end = start + 2 * period
    floor = begin[start]
    for k in reversed(range(len(levels))):
        to = start - (1 << k)
        same = levels[k][np.maximum(to, 0)] == levels[k][np.maximum(to, 0) + period]
        start = np.where((to >= floor) & same, to, start)
    long = end - start >= np.maximum(shortest, times * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[smallest], end[smallest], period[smallest]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _searched(text: pa.Array, times: int, shortest: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of every row."""
    data, at = column_bytes(text)
    counts, fields, texts, ends = [], [[], [], []], [], [np.zeros(1, np.int64)]
    for lo, hi, part, own in pieces(data, at, CHUNK):
        words = WhiteWords(part, own)
        start, end, period = runs_of(words.code, words.edge, times, shortest)
        row = np.searchsorted(words.edge, start, "right") - 1
        counts.append(np.bincount(row, minlength=hi - lo))
        for to, v in zip(fields, (start - words.edge[row], end - start, period), strict=True):
            to.append(v)
        cover = np.zeros(len(words.code) + 1, np.int64)
        np.add.at(cover, start + period, 1)
        np.add.at(cover, end, -1)
        joined, edge = words.joined(np.cumsum(cover)[:-1] == 0)
        texts.append(joined)
        ends.append(edge[1:] + ends[-1][-1])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    parts = [np.concatenate(f) if f else np.zeros(0, np.int64) for f in fields]
    found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(p, pa.int64()) for p in parts], ["start", "length", "period"]))
    whole = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    collapsed = pa.Array.from_buffers(pa.large_string(), len(text), [
        None, pa.py_buffer(np.concatenate(ends).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(whole))])
    return found, collapsed.cast(pa.string())


def find_runs(docs: DataFrame, text_col: str = "text", times: int = 4, shortest: int = 6, runs_col: str = "runs",
              collapsed_col: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of each text (array of start, length and period, in words, by start, then period) and the text
    without the words that repeat a run's first period, its words joined by one space.

    The two columns replace columns of the same names.
    """
    place = docs.columns.index(text_col)
    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in (runs_col.lower(), collapsed_col.lower())]
    schema = T.StructType([docs.schema[k] for k in kept])
    schema = schema.add(runs_col, RUNS).add(collapsed_col, T.StringType())

    def work(batches):
        for batch in batches:
            found, collapsed = _searched(batch.column(place), times, shortest)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), found, collapsed], schema.names)

    return docs.mapInArrow(work, schema)


def collapse(docs: DataFrame, text_col: str = "text", times: int = 4, shortest: int = 6) -> DataFrame:
    """``docs`` with each text that holds a run replaced by its collapsed form; other texts stay as they are."""
    runs, collapsed = free_name(docs.columns, "runs"), free_name(docs.columns, "collapsed")
    out = find_runs(docs, text_col, times, shortest, runs, collapsed)
    return out.withColumn(text_col, F.when(F.size(runs) > 0, F.col(collapsed)).otherwise(F.col(text_col))).select(*docs.columns)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in about a tenth of the texts, by a checksum of the id, the words from some word on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    word = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    words, n, a, p = F.col("_w"), F.col("_n"), F.col("_a"), F.col("_p")
    picked = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.element_at(
        words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.coalesce(h % 10 == 0, F.lit(False)).alias("_chosen"), g.alias("_g"))
    split = chosen.withColumn("_w", F.when(F.col("_chosen"), word))
    sized = split.withColumn("_n", F.size("_w").cast("bigint"))
    at = sized.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    period = at.withColumn("_p", F.when(n > 0, F.expr("1 + (_n - _a) div (3 + _g % 8)")))
    return period.select("doc_id", F.when(F.col("_chosen") & (n > 0), F.array_join(picked, " ")).otherwise(F.col("text")).alias("text"))


def _best(runs: Column) -> Column:
    """The run with the greatest length by period, then the smallest start, then the smallest period; NULL if none.

    Lengths by period are compared as doubles, which tell all fractions apart in texts of less than 2^27 words.
    """
    key = F.transform(runs, lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n")))
    return F.array_max(key)


def report(docs: DataFrame) -> DataFrame:
    """Per document of ``find_runs``: number of runs, the strongest one, and checksums of the runs and the collapsed text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    best = F.col("_best")
    return docs.withColumn("_best", _best(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-best["s"]).alias("start"), best["n"].alias("length"), (-best["p"]).alias("period"),
        F.expr("(1000 * _best.n) div (-_best.p)").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
