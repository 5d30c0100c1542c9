"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

Elements are a document's distinct shingles of ``size`` words (a document of fewer words is one shingle). Each element owns a
region, its weight by the rank axis, into which darts fall as a Poisson process drawn from hashes of the element alone. A
document throws darts up to a rank at which about k (ln k + 4) are expected; every dart hits one of k coordinates, and the
earliest per coordinate is kept. Two documents agree at a coordinate with the probability of their weighted Jaccard
similarity. Bands of ``rows`` coordinates are join keys.

Within a band's bucket nothing is paired with everything: members are compared with one pivot, then, in the few buckets that
still hold several components, with other pivots, as long as these close most of them. The sets of the buckets that are open
after that go through an exact similarity join instead: shingles are ordered by rarity among these sets, and two sets meet at a shingle that is among the
first n // 5 + 1 of the larger and the first m // 9 + 1 of the smaller one, if sizes, places and parity bitmaps allow a
match. Where many sets share shingles, the pairs come in rounds, and sets that a round has linked are no longer paired. Every
link is verified on whole shingle sets: shared * 9 >= 4 * (n1 + n2) is a Jaccard similarity of 0.8 or more.

NULL texts and texts without words are never linked; repeated rows and copies are one class; very long texts are read whole;
an empty table gives an empty result. Input rows are told apart by their place in a stored table, so doc_id may be NULL or
repeat. Shingles are 44-bit and shingle sets 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import bloom
from tidegauge.llm.arrow_text import PIECE, Words, column_bytes, mix, pieces
from tidegauge.llm.columns import free_name
from tidegauge.llm.components import components
from tidegauge.session import stored

SIZE, COORDINATES, ROWS = 5, 128, 4
LOG_BUCKETS = 20  # how often a shingle occurs is kept per bucket of hashes
ID_BITS = 44
MEETINGS = 4  # of two rows of the exact join per row of its first round
_ID = np.uint64((1 << ID_BITS) - 1)
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, at: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the distinct shingles of a run of texts, by row and shingle."""
    words = Words(data, at)
    h, row_at = words.hash, words.row_at
    n = np.diff(row_at)
    total = np.zeros(len(h), np.uint64)
    for k in range(size):
        total[: len(h) - k] += h[k:] * _FACTORS[k] if k < len(h) else np.uint64(0)
    rows = words.rows()
    whole = np.arange(len(h)) + size <= row_at[rows + 1] if len(h) else np.zeros(0, bool)
    keys = (rows[whole].astype(np.uint64) << np.uint64(ID_BITS)) | (mix(total[whole]) >> np.uint64(64 - ID_BITS))
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n[short] > k
            extra[has] += h[row_at[short[has]] + k] * _FACTORS[k]
        extra = mix(extra + n[short].astype(np.uint64)) >> np.uint64(64 - ID_BITS)
        keys = np.concatenate([keys, (short.astype(np.uint64) << np.uint64(ID_BITS)) | extra])
    keys.sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    spot = np.flatnonzero(first)
    count = np.diff(np.append(spot, len(keys)))
    keys = keys[spot]
    return (keys >> np.uint64(ID_BITS)).astype(np.int64), keys & _ID, count


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int = COORDINATES) -> np.ndarray:
    """Earliest dart per coordinate, ``rows`` x ``k``; a row without elements has zeros. Weights may be fractions."""
    out = np.zeros((rows, k), np.uint64)
    total = np.bincount(row, weight, rows)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(rows)
    reach[todo] = k * (math.log(k) + 4) / total[todo]
    # One unit of weight is one cell, so that equal elements of unequal weight share the cells they both have.
    cells = np.ceil(weight).astype(np.int64)
    if len(cells) and cells.max() > 1:
        order = np.repeat(np.arange(len(row)), cells)
        cell = np.arange(len(order)) - np.repeat(np.cumsum(cells) - cells, cells)
        row, element, room = row[order], mix(element[order] + cell.astype(np.uint64) * _FACTORS[7]), weight[order] - cell
    else:
        element, room = mix(element), weight
    for lo in range(0, len(todo), 4096):
        part = todo[lo : lo + 4096]
        while len(part):
            a, b = np.searchsorted(row, [part[0], part[-1] + 1])
            wanted = np.zeros(part[-1] - part[0] + 1, bool)
            wanted[part - part[0]] = True
            pick = wanted[row[a:b] - part[0]]
            found = _darts(row[a:b][pick], element[a:b][pick], room[a:b][pick], reach, np.searchsorted(part, row[a:b][pick]), k)
            best = np.zeros(len(part) * k, np.uint64)
            found.sort()
            slot = (found >> np.uint64(40)).astype(np.int64)
            first = np.ones(len(found), bool)
            first[1:] = slot[1:] != slot[:-1]
            best[slot[first]] = found[first] & np.uint64((1 << 40) - 1)
            best = best.reshape(len(part), k)
            full = (best > 0).all(1)
            out[part[full]] = best[full]
            part = part[~full]
            reach[part] *= 2
    return out


def _darts(row, element, room, reach, place, k) -> np.ndarray:
    """Every dart below its row's reach, packed as (place, coordinate, rank)."""
    found, rank, step = [], np.zeros(len(row)), 0
    limit = reach[row]
    live = np.arange(len(row))
    while len(live):
        width = 1 if step == 0 else 8
        turns = np.arange(step, step + width, dtype=np.uint64) * _FACTORS[11]
        noise = mix((element[live, None] + turns).ravel()).reshape(len(live), width)
        gap = -np.log1p(-(noise >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        at = rank[live, None] + np.cumsum(gap, 1)
        hit = at < limit[live, None]
        which, turn = np.nonzero(hit)
        own, draw = live[which], mix(noise[which, turn] + _FACTORS[13])
        inside = (draw >> np.uint64(32)).astype(np.float64) * 2.0**-32 < room[own]
        own, draw = own[inside], draw[inside]
        ranks = at[which, turn][inside].view(np.uint64) >> np.uint64(24)
        slot = place[own].astype(np.uint64) * np.uint64(k) + (draw & np.uint64(0xFFFFFFFF)) % np.uint64(k)
        found.append((slot << np.uint64(40)) | (ranks & np.uint64((1 << 40) - 1)))
        rank[live] = at[:, -1]
        live = live[hit[:, -1]]
        step += width
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates."""
    bands = signature.reshape(len(signature), -1, rows)
    key = np.zeros(bands.shape[:2], np.uint64)
    for r in range(rows):
        key = mix(key + bands[:, :, r] * _FACTORS[20 + r])
    return mix(key + np.arange(bands.shape[1], dtype=np.uint64) * _FACTORS[30])


def _sets(row: np.ndarray, element: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each row's set of elements."""
    total = np.zeros(n + 1, np.uint64)
    spread = np.concatenate([[np.uint64(0)], np.cumsum(mix(element + _FACTORS[40]))])
    edge = np.searchsorted(row, np.arange(n + 1))
    total = spread[edge[1:]] - spread[edge[:-1]]
    return mix(total + (edge[1:] - edge[:-1]).astype(np.uint64) * _FACTORS[41])


def sketch(docs: DataFrame, weights: str = "set", size: int = SIZE) -> DataFrame:
    """row, doc_id, set (NULL without words), n and bands; a set seen before in the same batch has no bands."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("set", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column(2))
            for lo, hi, part, own in pieces(data, at, PIECE):
                rows = hi - lo
                row, element, count = shingles(part, own, size)
                n = np.bincount(row, minlength=rows)
                name = _sets(row, element, rows).view(np.int64)
                new = np.zeros(rows, bool)
                new[np.unique(name, return_index=True)[1]] = True
                new &= n > 0
                pick = new[row]
                weight = count[pick].astype(float) if weights == "count" else np.ones(int(pick.sum()))
                keys = band_keys(signatures(row[pick], element[pick], weight, rows)[new]).view(np.int64)
                sizes = np.where(new, keys.shape[1] if len(keys) else 0, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), pa.array(name, mask=n == 0), pa.array(n), bands],
                    schema=schema)

    return docs.select(F.col("row").cast("bigint"), F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        work, "row bigint, doc_id bigint, set bigint, n bigint, bands array<bigint>")


def _shingle_sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(set, shingles) of the sets in ``needed``; a fixed-size filter keeps most other texts from being sent on."""
    shared = bloom.build(needed)

    def work(batches):
        for batch in batches:
            data, at = column_bytes(batch.column(0))
            for lo, hi, part, own in pieces(data, at, PIECE):
                row, element, _ = shingles(part, own, size)
                n = np.bincount(row, minlength=hi - lo)
                name = _sets(row, element, hi - lo).view(np.int64)
                new = np.zeros(hi - lo, bool)
                new[np.unique(name, return_index=True)[1]] = True
                new &= (n > 0) & bloom.hits(shared, name)
                pick = new[row]
                ends = np.concatenate([[0], np.cumsum(n[new])])
                sets = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(element[pick].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(name[new]), sets.cast(pa.list_(pa.int64()))], ["set", "shingles"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(work, "set bigint, shingles array<bigint>")
    return found.join(needed, "set", "left_semi").dropDuplicates(["set"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sets have a Jaccard similarity of 0.8 or more."""
    left = pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _across(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    known = members.join(labels.withColumnsRenamed({"node": "set"}), "set", "left").select(
        "k", "set", "n", F.coalesce("label", "set").alias("label"))
    mixed = known.groupBy("k").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count(F.lit(1)).alias("c")).where("p <> q and c > 2")
    return known.join(mixed.select("k"), "k", "left_semi")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _rarity(sets: DataFrame) -> np.ndarray:
    """Occurrences of shingles per bucket of hashes, a table of fixed size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << LOG_BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_buckets(_elements(batch.column(0))), minlength=len(total))
        spot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(total[spot])], ["spot", "c"])

    found = sets.select("shingles").mapInArrow(work, "spot bigint, c bigint").groupBy("spot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(1 << LOG_BUCKETS, np.int64)
    out[found.column("spot").to_numpy()] = found.column("c").to_numpy()
    return out


def _elements(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _buckets(element: np.ndarray) -> np.ndarray:
    return (element & np.uint64((1 << LOG_BUCKETS) - 1)).astype(np.int64)


def _rare_first(sets: DataFrame) -> DataFrame:
    """The n // 5 + 1 rarest shingles of each set, without those no other set has: set, label, n, shingle, place and two bitmap words."""
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            element = _elements(batch.column(2))
            n = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(element):
                continue
            row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            bit = mix(element + _FACTORS[42]) & np.uint64(127)
            flag = np.uint64(1) << (bit & np.uint64(63))
            low = np.bitwise_xor.reduceat(np.where(bit < 64, flag, np.uint64(0)), start).view(np.int64)
            high = np.bitwise_xor.reduceat(np.where(bit < 64, np.uint64(0), flag), start).view(np.int64)
            often = counts[_buckets(element)]
            order = np.lexsort((element, often, row))
            place = np.arange(len(row)) - start[row]
            use = np.flatnonzero((place <= n[row] // 5) & (often[order] > 1))
            own = row[use]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(n[own]),
                 pa.array(element[order[use]].view(np.int64)), pa.array(place[use]), pa.array(low[own]), pa.array(high[own])],
                ["set", "label", "n", "shingle", "place", "low", "high"])

    return sets.select("set", "label", "shingles").mapInArrow(
        work, "set bigint, label bigint, n bigint, shingle bigint, place bigint, low bigint, high bigint")


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) of the sets (set, label, shingles) of unlike labels that may be similar; no similar pair is missing."""
    return _meeting(stored(_rare_first(sets), "rare"), 0, 1, 1)


def _meeting(x: DataFrame, lo: int, hi: int, parts: int) -> DataFrame:
    """(a, b) of unlike labels that may be similar, of the pairs whose hash falls into the parts from ``lo`` to ``hi``.

    The filter of places holds at the first shingle that a pair shares, the bitmaps differ in at most as many bits as the
    sets do in shingles.
    """
    y = x.where("place <= n div 9").select(
        "shingle", F.col("set").alias("b"), F.col("label").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"),
        F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    share = f"pmod(xxhash64(a, b), {parts}) between {lo} and {hi - 1} and " if hi - lo < parts else ""
    return _ordered(x.withColumnRenamed("set", "a").join(y, "shingle").where(
        "label <> other and (n > m or n = m and a > b) and 5 * m >= 4 * n and " + share +
        "9 * (1 + least(n - place - 1, m - at - 1)) >= 4 * (n + m) "
        "and 9 * (bit_count(low ^ low_b) + bit_count(high ^ high_b)) <= n + m").select("a", "b"))


def _rounds(x: DataFrame) -> list[int]:
    """Where the rounds of a join end, 1, 8, 64 and so on: the first has a few meetings per row, the last all that are left."""
    met = x.groupBy("shingle").agg(F.count(F.lit(1)).alias("x"), F.count_if(F.expr("place <= n div 9")).alias("y"))
    meetings, rows = met.agg(F.sum(F.col("x").cast("double") * F.col("y")), F.sum("x")).first()
    ends = [1]
    while rows and meetings > MEETINGS * rows * ends[-1]:
        ends.append(ends[-1] * 8)
    return ends


def _joined(labels: DataFrame, open_: DataFrame, sets: DataFrame, tried: DataFrame) -> DataFrame:
    """``labels`` after an exact join of the sets in open buckets.

    Sets that share a label need no pair, so the pairs are dealt into rounds by a hash, and what one round links is not paired
    in the next. If a round and those before it have the share p of all pairs, some n / p links of n sets are left between
    unlike labels (Karger, Klein and Tarjan, 1995); the next round has eight times as many pairs, and thus finds eight links
    or so a set, however many a large group holds. Each pair is in one round, the last takes all that are still unlike.
    """
    named = open_.select("set", "label").distinct()
    rare = stored(_rare_first(stored(named.join(sets, "set"), "open-sets")), "rare")
    ends = _rounds(rare)
    now = rare
    for lo, hi in zip([0, *ends], ends):
        more = stored(_meeting(now, lo, hi, ends[-1]).join(tried, ["a", "b"], "left_anti"), f"met-{hi}")
        edges = more if more.isEmpty() else stored(_verified(more, sets), f"links-{hi}")
        if not edges.isEmpty():
            labels = stored(_merged(labels, edges), f"labels-{hi}")
            now = rare.drop("label").join(labels.withColumnsRenamed({"node": "set"}), "set", "left").withColumn(
                "label", F.coalesce("label", "set"))
    return labels


def link(docs: DataFrame, sketches: DataFrame, size: int = SIZE, pivots: int = 3) -> DataFrame:
    """(node, label) of every set that has a near copy."""
    bands = sketches.where("set is not null").select("set", "n", F.explode("bands").alias("k"))
    shared = bands.groupBy("k").agg(F.min("set").alias("p"), F.max("set").alias("q")).where("p <> q")
    members = stored(bands.join(shared.select("k"), "k", "left_semi").distinct(), "buckets")
    sets = stored(_shingle_sets(docs, members.select("set").distinct(), size), "shingles")

    def star(rows: DataFrame, turn: int) -> DataFrame:
        pick = F.xxhash64(F.lit(turn), "set")
        pivot = rows.groupBy("k").agg(F.min_by("set", pick).alias("b"), F.min_by("n", pick).alias("m"), F.min_by("label", pick).alias("other"))
        return _ordered(_near_sizes(rows.join(pivot, "k").where("label <> other")).select(F.col("set").alias("a"), "b"))

    tried = stored(star(members.withColumn("label", F.col("set")), 0), "pairs-0")
    labels = components(stored(_verified(tried, sets), "edges-0"))
    left = members.count()
    for turn in range(1, pivots + 1):
        open_ = stored(_across(members, labels), f"open-{turn}")
        before, left = left, open_.count()
        if not left:
            return labels
        # Where the last pivots closed less than half of the rows, more of them would leave the join much the same work.
        if turn == pivots or 2 * left > before:
            return _joined(labels, open_, sets, tried)
        more = stored(star(open_, turn).join(tried, ["a", "b"], "left_anti"), f"pairs-{turn}")
        edges = more if more.isEmpty() else stored(_verified(more, sets), f"edges-{turn}")
        if not edges.isEmpty():
            labels = stored(_merged(labels, edges), f"labels-{turn}")
        tried = tried.unionByName(more)
    return labels


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after more edges: only the labels that these join are linked, not the nodes below them again."""
    def named(side: str) -> DataFrame:
        return labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))

    known = edges.join(named("a"), "a", "left").join(named("b"), "b", "left")
    joined = components(known.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    joined = stored(joined.withColumnsRenamed({"label": "least", "node": "label"}), "joined-labels")
    # A node without label so far is its own label.
    every = labels.unionByName(joined.select(F.col("label").alias("node"), "label")).distinct()
    return every.join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label"))


def _near_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.where("5 * n >= 4 * m and 5 * m >= 4 * n")


def classes(docs: DataFrame, weights: str = "set", size: int = SIZE) -> DataFrame:
    """One row per input row: row, doc_id, class_id (the class's smallest doc_id), class_size and whether the row stays.

    ``docs`` has row, doc_id and text. Of every class the row with the smallest (doc_id, row) stays.
    """
    sketches = stored(sketch(docs, weights, size), "sketches")
    labels = link(docs, sketches, size).select(F.col("node").alias("set"), "label")
    rows = sketches.select("row", "doc_id", "set")
    known = rows.where("set is not null").join(labels, "set", "left").select("row", "doc_id", F.coalesce("label", "set").alias("label"))
    known = stored(known, "labelled")
    heads = known.groupBy("label").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head"))
    out = known.join(heads, "label").select("row", "doc_id", "class_id", "class_size", (F.col("head.row") == F.col("row")).alias("keep"))
    alone = rows.where("set is null").select(
        "row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("keep"))
    return out.unionByName(alone)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows of a stored table with their place in it."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def near_classes(docs: DataFrame, weights: str = "set") -> DataFrame:
    return classes(numbered(docs.select("doc_id", "text")), weights).drop("row")


def keep_one(docs: DataFrame, weights: str = "set") -> DataFrame:
    """One document of each class stays; columns unchanged."""
    place = free_name(docs.columns, "_row")
    gone = classes(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), weights).where("not keep")
    kept = docs.withColumn(place, F.monotonically_increasing_id()).join(gone.select(F.col("row").alias(place)), place, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
