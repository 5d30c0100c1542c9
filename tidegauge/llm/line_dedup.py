"""Removal of repeated and near-equal lines by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity over the whole corpus; two lines with a Jaccard similarity of
0.8 or more share a word among the first n // 5 + 1 of the longer one and the first n // 9 + 1 of the shorter one. Lines meet
at such words; length, position and a parity bitmap of 128 bits (each differing word flips one bit, so the bitmaps of similar
lines differ in few) leave few candidates, and these are verified on whole word sets.

A line goes if an equal or similar line stands before it; "before" is the order of (doc_id, place in the table, line), NULL
doc_id last. Whether the earlier line itself goes does not matter, so the outcome depends on no order of work. Lines without
words stay. NULL texts stay NULL; an empty table gives an empty result; texts are read whole.

Where a line has a very promising candidate at a word, at most ``best`` of its candidates there are verified at first. Lines
for which there were more, and of which none fitted, are joined again without that bound at the words where there were more,
so no match is lost. Words are 40-bit and lines 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import bloom
from tidegauge.llm.arrow_text import PIECE, Words, column_bytes, mix, pieces
from tidegauge.llm.columns import free_name
from tidegauge.session import stored

LOG_BUCKETS = 21  # word counts are kept per bucket of hashes
BLOCK = 1 << 12  # buckets whose counts travel together
TOKEN_BITS = 40
WIDTH = TOKEN_BITS // 8
STORED = 1 << 25  # bytes of words handed on at once
HOT = 50_000  # lines that may meet at one word in one task
SAMPLE = 64  # one row in so many tells which words are hot; it only balances the work
_F = mix(np.arange(100, 120, dtype=np.uint64)) | np.uint64(1)
_LAST = np.iinfo(np.int64).max
_ONCE = np.uint64(8)  # rarity of a bucket that holds one word of one line


class Sets:
    """Word sets one after the other, each sorted, with their sizes and names."""

    def __init__(self, token: np.ndarray, n: np.ndarray, name: np.ndarray):
        self.token, self.n, self.name = token, n, name
        self.at = np.cumsum(n) - n  # where each set begins among the words

    def some(self, chosen: np.ndarray) -> Sets:
        return Sets(self.token[np.repeat(chosen, self.n)], self.n[chosen], self.name[chosen])

    def firsts(self, doc: np.ndarray) -> np.ndarray:
        """Marks one set of each name, that of the smallest ``doc``."""
        order = np.lexsort((doc, self.name))
        head = np.ones(len(order), bool)
        head[1:] = self.name[order][1:] != self.name[order][:-1]
        out = np.zeros(len(order), bool)
        out[order[head]] = True
        return out

    def words(self) -> pa.Array:
        """The words as lists."""
        ends = np.append(self.at, len(self.token))
        return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(self.token.view(np.int64))).cast(pa.list_(pa.int64()))

    def bitmaps(self) -> tuple[np.ndarray, np.ndarray]:
        spot = mix(self.token) & np.uint64(127)
        bit = np.uint64(1) << (spot & np.uint64(63))
        out = []
        for half in (0, 1):
            own = np.where(spot >> np.uint64(6) == half, bit, np.uint64(0))
            out.append(np.bitwise_xor.reduceat(own, self.at) if len(self.at) else own)
        return out[0], out[1]

    def packed(self) -> pa.Array:
        """The words of each set as bytes."""
        data = np.ascontiguousarray(self.token.view(np.uint8).reshape(-1, 8)[:, :WIDTH])
        ends = np.append(self.at, len(self.token)).astype(np.int64) * WIDTH
        return pa.Array.from_buffers(pa.large_binary(), len(self.n), [None, pa.py_buffer(ends), pa.py_buffer(data)])


class Lines(Sets):
    """The lines of a run of texts: distinct words, their number and a name for the set."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        words = Words(data, at)
        breaks = np.flatnonzero(data == 10)
        rows = words.rows()
        first = np.searchsorted(breaks, at[:-1]) + np.arange(len(at) - 1)  # number of each text's first line
        total = len(breaks) + len(at) - 1
        number = np.searchsorted(breaks, words.start) + rows
        token = words.hash >> np.uint64(64 - TOKEN_BITS)
        if total < 1 << (64 - TOKEN_BITS):
            keys = (number.astype(np.uint64) << np.uint64(TOKEN_BITS)) | token
            keys.sort()
            number, token = (keys >> np.uint64(TOKEN_BITS)).astype(np.int64), keys & np.uint64((1 << TOKEN_BITS) - 1)
        else:
            order = np.lexsort((token, number))
            number, token = number[order], token[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (number[1:] != number[:-1])
        number, token = number[new], token[new]
        start = np.ones(len(number), bool)
        start[1:] = number[1:] != number[:-1]
        begin = np.flatnonzero(start)
        line, n = number[begin], np.diff(np.append(begin, len(token)))
        sums = np.add.reduceat(mix(token + _F[0]), begin) if len(begin) else np.zeros(0, np.uint64)
        super().__init__(token, n, mix(sums + n.astype(np.uint64) * _F[1]).view(np.int64))
        self.row = np.searchsorted(first, line, "right") - 1
        self.place = line - first[self.row]  # line within its text


def _unpacked(name: pa.Array, data: pa.Array) -> Iterator[tuple[int, Sets]]:
    """Runs of stored sets: number of the first, sets."""
    data = data.cast(pa.large_binary())
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]]
    for lo, hi, part, own in pieces(raw, at - at[0], PIECE):
        token = np.zeros((len(part) // WIDTH, 8), np.uint8)
        token[:, :WIDTH] = part.reshape(-1, WIDTH)
        yield lo, Sets(token.view(np.uint64).ravel(), np.diff(own) // WIDTH, name.slice(lo, hi - lo).to_numpy())


def _survey(docs: DataFrame) -> DataFrame:
    """Lines (kind 0: row, doc_id, line, set, data) and counts of words by bucket (kind 1: row = block of buckets, data).

    ``data`` of a line is its words, NULL where the same run of texts has an equal line (of a smaller doc_id) with them; texts
    are cut into words only here.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "row", "doc_id", "line", "set", "data"]
        counts = np.zeros(1 << LOG_BUCKETS, np.int64)
        for batch in batches:
            data, at = column_bytes(batch.column(2))
            ids = batch.column(1).fill_null(_LAST).to_numpy()
            for lo, hi, part, own in pieces(data, at, PIECE):
                x = Lines(part, own)
                if not len(x.n):
                    continue
                np.add.at(counts, (x.token >> np.uint64(TOKEN_BITS - LOG_BUCKETS)).astype(np.int64), 1)
                keys = batch.column(0).slice(lo, hi - lo).take(pa.array(x.row))
                docs_ = batch.column(1).slice(lo, hi - lo).take(pa.array(x.row))
                new = x.firsts(ids[lo + x.row])
                packed = pc.if_else(pa.array(new), x.packed(), pa.scalar(None, pa.large_binary()))
                i = 0
                while i < len(x.n):
                    j = max(i + 1, int(np.searchsorted(x.at, x.at[i] + STORED // WIDTH, "right")) - 1)
                    j = len(x.n) if x.at[-1] < x.at[i] + STORED // WIDTH else j
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.zeros(j - i, np.int32)), keys.slice(i, j - i), docs_.slice(i, j - i), pa.array(x.place[i:j]),
                         pa.array(x.name[i:j]), packed.slice(i, j - i).cast(pa.binary())], names)
                    i = j
        blocks = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(used), np.int32)), pa.array(used), none, none, none, pa.array([blocks[b].tobytes() for b in used], pa.binary())], names)

    return docs.mapInArrow(work, "kind int, row bigint, doc_id bigint, line bigint, set bigint, data binary")


def _rarity(survey: DataFrame) -> Broadcast:
    """One byte per bucket: an eighth of a power of two of its count. 2 MB, whatever the corpus."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counts.as_buffer(), np.int64)
                total[block] = total[block] + own if block in total else own.copy()
        ranks = [np.minimum(255, np.ceil(8 * np.log2(n + 1.0))).astype(np.uint8).tobytes() for n in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(ranks, pa.binary())], ["row", "ranks"])

    spark = survey.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = survey.where("kind = 1").select("row", "data").repartition(parts, "row").mapInArrow(work, "row bigint, ranks binary").toArrow()
    table = np.zeros(((1 << LOG_BUCKETS) // BLOCK, BLOCK), np.uint8)
    for block, ranks in zip(found.column("row").to_pylist(), found.column("ranks").to_pylist(), strict=True):
        table[block] = np.frombuffer(ranks, np.uint8)
    return spark.sparkContext.broadcast(table.tobytes())


def _prefixes(x: Sets, rarity: np.ndarray):
    """(line number among sets, 31-bit word, position) of every prefix word that may stand in another line too."""
    rank = rarity[(x.token >> np.uint64(TOKEN_BITS - LOG_BUCKETS)).astype(np.int64)].astype(np.uint64)
    own = np.repeat(np.arange(len(x.at)), x.n)
    order = (rank << np.uint64(32)) | (x.token & np.uint64(0xFFFFFFFF))
    if len(x.at) < 1 << 24:
        keys = (own.astype(np.uint64) << np.uint64(40)) | order
        keys.sort()
        order = keys & np.uint64((1 << 40) - 1)
    else:
        order = order[np.lexsort((order, own))]
    position = np.arange(len(own)) - np.repeat(x.at, x.n)
    keep = (position < np.repeat(x.n // 5 + 1, x.n)) & ((order >> np.uint64(32)) > _ONCE)
    return own[keep], order[keep] & np.uint64(0x7FFFFFFF), position[keep]


def _postings(lines: DataFrame, rarity: Broadcast, cells: Broadcast, only: Broadcast | None = None) -> DataFrame:
    """One row per distinct line of a run of lines (row, doc_id, set, data) and prefix word: word, size and position packed in
    ``k``; name of the line, bitmaps, first document and cell. Hot words are dealt to several cells, so that each two of their
    lines meet in one.

    With ``only``, a filter of words, other words are left out, and each line that is left has one more row with its words.
    """

    def work(batches):
        table, hot = np.frombuffer(rarity.value, np.uint8), cells.value
        words, parts = hot
        for batch in batches:
            ids = batch.column(1).fill_null(_LAST).to_numpy()
            for lo, x in _unpacked(batch.column(2), batch.column(3)):
                doc = ids[lo : lo + len(x.n)]
                if only is not None:
                    near = np.logical_or.reduceat(bloom.hits(only, bloom.key_of(x.token & np.uint64(0x7FFFFFFF))), x.at)
                    x, doc = x.some(near), doc[near]
                new = x.firsts(doc)
                x, doc = x.some(new), doc[new]
                if not len(x.n):
                    continue
                b1, b2 = x.bitmaps()
                line, word, position = _prefixes(x, table)
                if only is not None:
                    keep = bloom.hits(only, bloom.key_of(word))
                    line, word, position = line[keep], word[keep], position[keep]
                n = x.n[line]
                k = (word << np.uint64(32)) | (np.minimum(n, (1 << 20) - 1).astype(np.uint64) << np.uint64(12)) | np.minimum(position, 4095).astype(np.uint64)
                cell = np.zeros(len(line), np.int32)
                if len(words):
                    at_hot = np.minimum(np.searchsorted(words, word), len(words) - 1)
                    nb = np.where(words[at_hot] == word, parts[at_hot], 1)
                    # With m blocks, cell i * m + j (i <= j) holds the lines of blocks i and j.
                    copies = np.repeat(np.arange(len(line)), nb)
                    turn = np.arange(len(copies)) - np.repeat(np.cumsum(nb) - nb, nb)
                    m = nb[copies]
                    block = (mix(x.name[line].view(np.uint64)) % nb.astype(np.uint64)).astype(np.int64)[copies]
                    cell = (np.minimum(block, turn) * m + np.maximum(block, turn)).astype(np.int32)
                    line, k = line[copies], k[copies]
                names = ["k", "cell", "set", "b1", "b2", "doc"]
                out = [pa.array(k.view(np.int64)), pa.array(cell), pa.array(x.name[line]), pa.array(b1[line].view(np.int64)),
                       pa.array(b2[line].view(np.int64)), pa.array(doc[line])]
                if only is None:
                    yield pa.RecordBatch.from_arrays(out, names)
                    continue
                yield pa.RecordBatch.from_arrays([*out, pa.nulls(len(line), pa.list_(pa.int64()))], [*names, "words"])
                some = np.zeros(len(x.at), bool)
                some[line] = True
                x = x.some(some)
                none = [pa.nulls(len(x.n), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([none[0], none[1], pa.array(x.name), *none[2:], x.words()], [*names, "words"])

    return lines.mapInArrow(work, "k bigint, cell int, set bigint, b1 bigint, b2 bigint, doc bigint" + (", words array<bigint>" if only else ""))


def _hot_words(lines: DataFrame, rarity: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Words at which many lines may meet, by a sample of rows, and the blocks each is dealt to."""
    some = lines.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)
    empty = lines.sparkSession.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    found = (_postings(some, rarity, empty).groupBy(F.shiftrightunsigned("k", 32).alias("word")).count()
             .where(F.col("count") * SAMPLE > HOT).toArrow())  # at most all postings / HOT rows
    words = found.column("word").to_numpy().astype(np.uint64)
    order = np.argsort(words)
    return words[order], (found.column("count").to_numpy()[order] * SAMPLE) // HOT + 1


def _pairs(postings: DataFrame, best: int, only: Broadcast | None) -> DataFrame:
    """(later, earlier, word) candidates; where a line had more than ``best`` at a word, ``earlier`` is NULL and ``word`` its key."""
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(parts, F.shiftrightunsigned("k", 32), "cell").sortWithinPartitions("k")

    def work(batches):
        kept: list[pa.RecordBatch] = []
        rows = 0

        def ready(last: bool):
            t = pa.Table.from_batches(kept)
            cell, k, name, b1, b2, doc = (t.column(c).to_numpy() for c in ("cell", "k", "set", "b1", "b2", "doc"))
            k, b1, b2 = k.view(np.uint64), b1.view(np.uint64), b2.view(np.uint64)
            word = k >> np.uint64(32)
            turns = np.flatnonzero(word[1:] != word[:-1]) + 1
            end = len(k) if last else int(turns[-1]) if len(turns) else 0  # the last group may go on in the next batch
            kept.clear()
            if end < len(k):
                kept.extend(t.slice(end).combine_chunks().to_batches())
            if end:
                own = [a[:end] for a in (cell, k, name, b1, b2, doc)]
                # Cells of one hot word, and copies of a line, lie side by side.
                order = np.lexsort((own[2], own[1], own[0])) if own[0].any() else np.lexsort((own[2], own[1]))
                own = [a[order] for a in own]
                yield from _meet(*own, best, only)

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                rows += batch.num_rows
            if rows >= 400_000:
                yield from ready(False)
                rows = sum(b.num_rows for b in kept)
                if rows >= 400_000:
                    rows = 0  # one long group: read on
        if kept:
            yield from ready(True)

    return dealt.mapInArrow(work, "later bigint, earlier bigint, word bigint").distinct()


def _meet(cell, k, name, b1, b2, doc, best: int, only: Broadcast | None) -> Iterator[pa.RecordBatch]:
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (name[1:] != name[:-1]) | (cell[1:] != cell[:-1])
    at = np.flatnonzero(new)
    cell, k, name, b1, b2, doc = cell[at], k[at], name[at], b1[at], b2[at], np.minimum.reduceat(doc, at)
    names = ["later", "earlier", "word"]
    n, position = ((k >> np.uint64(12)) & np.uint64((1 << 20) - 1)).astype(np.int64), (k & np.uint64(4095)).astype(np.int64)
    wanted = bloom.hits(only, name) if only is not None else None
    # Entries are sorted by cell, word and size: the partners of i are the next ones, up to a quarter longer.
    edge = np.flatnonzero(np.diff(cell)) + 1
    stop = np.empty(len(k), np.int64)
    for a, b in zip(np.append(0, edge), np.append(edge, len(k)), strict=True):
        top = (k[a:b] & ~np.uint64(0xFFFFFFFF)) | (np.minimum(n[a:b] * 5 // 4, (1 << 20) - 1).astype(np.uint64) << np.uint64(12)) | np.uint64(4095)
        stop[a:b] = a + np.searchsorted(k[a:b], top, "right")
    count = np.where(position < n // 9 + 1, stop - np.arange(len(k)) - 1, 0)
    # Of equal size, either may be the one with the longer prefix.
    same = np.where(position >= n // 9 + 1, 0, count)
    total = np.cumsum(same)
    lo = 0
    while lo < len(k):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 2_000_000, "right")))
        i = np.repeat(np.arange(lo, hi), same[lo:hi])
        j = np.arange(len(i)) - np.repeat(np.cumsum(same[lo:hi]) - same[lo:hi], same[lo:hi]) + i + 1
        need = -(-4 * (n[i] + n[j]) // 9)
        far = np.bitwise_count(b1[i] ^ b1[j]).astype(np.int64) + np.bitwise_count(b2[i] ^ b2[j])
        ok = (far <= n[i] + n[j] - 2 * need) & (1 + np.minimum(n[i] - position[i], n[j] - position[j]) - 1 + np.minimum(position[i], position[j]) >= need)
        i, j, far = i[ok], j[ok], far[ok]
        swap = doc[i] > doc[j]
        later, earlier = np.where(swap, i, j), np.where(swap, j, i)
        tie = doc[i] == doc[j]  # the verified pair is put in order by the lines themselves
        later, earlier, far = np.concatenate([later, earlier[tie]]), np.concatenate([earlier, later[tie]]), np.concatenate([far, far[tie]])
        if wanted is not None:
            use = wanted[later]
            later, earlier, far = later[use], earlier[use], far[use]
        elif best:
            order = np.lexsort((far, later))
            later, earlier = later[order], earlier[order]
            start = np.ones(len(later), bool)
            start[1:] = later[1:] != later[:-1]
            head = np.flatnonzero(start)[np.cumsum(start) - 1] if len(later) else later
            rank = np.arange(len(later)) - head
            # Only where the best candidate is half as far as it may be are the others left for later.
            room = n[later] + n[earlier] - 2 * -(-4 * (n[later] + n[earlier]) // 9)
            keep = (rank < best) | (2 * far[order][head] > room[head])
            over = np.unique(later[~keep])
            later, earlier = later[keep], earlier[keep]
            if len(over):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[over]), pa.nulls(len(over), pa.int64()), pa.array(bloom.key_of(k[over] >> np.uint64(32)))], names)
        yield pa.RecordBatch.from_arrays([pa.array(name[later]), pa.array(name[earlier]), pa.nulls(len(later), pa.int64())], names)
        lo = hi


def _word_sets(lines: DataFrame, needed: DataFrame) -> DataFrame:
    """(set, words) of the lines in ``needed``; a fixed-size filter keeps most other lines from being sent on."""
    shared = bloom.build(needed)

    def work(batches):
        for batch in batches:
            name, data = batch.column(0), batch.column(1)
            near = pa.array(bloom.hits(shared, name.to_numpy()))
            for _, x in _unpacked(name.filter(near), data.filter(near)):
                x = x.some(x.firsts(np.zeros(len(x.n))))
                yield pa.RecordBatch.from_arrays([pa.array(x.name), x.words()], ["set", "words"])

    return lines.select("set", "data").mapInArrow(work, "set bigint, words array<bigint>").join(needed, "set", "left_semi").dropDuplicates(["set"])


def _either(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("later", "earlier")).alias("set")).distinct()


def _matches(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidate pairs with a Jaccard similarity of 0.8 or more."""
    one = pairs.join(sets.select(F.col("set").alias("later"), F.col("words").alias("x")), "later")
    two = one.join(sets.select(F.col("set").alias("earlier"), F.col("words").alias("y")), "earlier")
    return two.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("later", "earlier")


def _similar_before(lines: DataFrame, firsts: DataFrame, rarity: Broadcast, best: int) -> DataFrame:
    """Names of the lines that have a similar line before them."""
    cells = lines.sparkSession.sparkContext.broadcast(_hot_words(lines, rarity))
    place = firsts.select("set", "first")

    def found(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        matched = _matches(pairs, sets)
        one = matched.join(place.withColumnsRenamed({"set": "later", "first": "a"}), "later")
        two = one.join(place.withColumnsRenamed({"set": "earlier", "first": "b"}), "earlier")
        return two.where("b < a").select(F.col("later").alias("set")).distinct()

    pairs = stored(_pairs(_postings(lines, rarity, cells), best, None), "line-pairs")
    some = pairs.where("earlier is not null").select("later", "earlier")
    gone = stored(found(some, stored(_word_sets(lines, _either(some)), "line-words-0")), "similar-0")
    left = pairs.where("earlier is null").select(F.col("later").alias("set"), "word").join(gone, "set", "left_anti")
    rest = stored(left, "open-lines")
    if rest.isEmpty():
        return gone
    # Open lines meet again only at the words where they had too many candidates.
    again = stored(_postings(lines, rarity, cells, bloom.build(rest.select("word").distinct())), "open-postings")
    more = stored(_pairs(again.where("k is not null").drop("words"), 0, bloom.build(rest.select("set").distinct())).select("later", "earlier"), "line-pairs-1")
    sets = stored(again.where("k is null").select("set", "words").join(_either(more), "set", "left_semi").dropDuplicates(["set"]), "line-words-1")
    return gone.unionByName(stored(found(more, sets), "similar-1")).distinct()


def removed_lines(docs: DataFrame, best: int = 8) -> DataFrame:
    """(row, lines) with the numbers of the lines to remove; ``docs`` has row, doc_id and text."""
    docs = docs.select(F.col("row").cast("bigint"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    survey = stored(_survey(docs), "lines")
    lines = survey.where("kind = 0").select("row", "doc_id", "line", "set")
    order = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "row", "line")
    firsts = stored(lines.groupBy("set").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("times")), "first-lines")
    whole = survey.where("kind = 0 and data is not null").select("row", "doc_id", "set", "data")
    similar = _similar_before(whole, firsts, _rarity(survey), best).withColumn("similar", F.lit(True))
    judged = firsts.join(similar, "set", "left").where("times > 1 or similar").select("set", "first", F.coalesce("similar", F.lit(False)).alias("similar"))
    gone = lines.join(judged, "set").where("similar or first.row <> row or first.line <> line")
    return gone.groupBy("row").agg(F.collect_list(F.col("line").cast("int")).alias("lines"))


def without_repeats(docs: DataFrame, best: int = 8, n_lines: str = "_n_lines", n_removed: str = "_n_removed") -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``, and two more columns: how many lines there were, and went.

    ``docs`` must be read from files: its rows are numbered twice.
    """
    row, gone_, lines = (free_name(docs.columns, c) for c in ("_row", "_gone", "_lines"))
    gone = removed_lines(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), best)
    gone = gone.withColumnsRenamed({"row": row, "lines": gone_})
    joined = docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left").withColumn(lines, F.split("text", "\n"))
    kept = F.expr(f"concat_ws('\n', transform(array_except(sequence(0, size({lines}) - 1), {gone_}), i -> {lines}[i]))")

    def size(c):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")

    return joined.select(*[F.when(F.col(gone_).isNull(), F.col("text")).otherwise(kept).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                         size(lines).alias(n_lines), size(gone_).alias(n_removed))


def dedup_lines(docs: DataFrame, best: int = 8) -> DataFrame:
    """Columns unchanged; documents all of whose words were in removed lines go."""
    names = [free_name(docs.columns, c) for c in ("_n_lines", "_n_removed")]
    out = without_repeats(docs, best, *names).where(f"{names[1]} = 0 or text rlike '[0-9A-Za-z]|[^\\\\x00-\\\\x7F]'")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, best: int = 8) -> DataFrame:
    return without_repeats(docs.select("doc_id", "text"), best).select(
        F.col("doc_id").cast("bigint"), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")
