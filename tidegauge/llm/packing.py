"""Best-fit packing of tokenised documents into sequences of a fixed size.

Every document is turned into token ids, closed with the id ``separator``, and cut only where it is longer than a sequence.
Each task packs its own stream of pieces with a fixed number of open bins; a bitset over free space finds the tightest bin
that fits, and when too many bins are open the fullest closes. Bins still open at the end of a task are packed again with
those of other tasks, level by level, so no task ever holds more than a bounded number of them.

NULL and empty texts give the separator alone; repeated rows are packed one by one; an empty table gives an empty result.
Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.arrow_text import PIECE as RUN
from tidegauge.llm.arrow_text import column_bytes
from tidegauge.llm.arrow_text import pieces as runs
from tidegauge.session import stored

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECE + ", sequence_id bigint, offset bigint"

# Classes of characters from U+0020 to U+017F, on which every Unicode library agrees: 0 white space, 1 letter, 2 number,
# 3 other, 9 left to the tokenizer itself.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _character_tables():
    import unicodedata

    import numpy as np

    kind, lower = np.full(384, 9, np.uint8), np.arange(384)
    for c in [9, 10, 13, *range(32, 127), *range(161, 384)]:
        if c == 0x130:
            continue
        group = unicodedata.category(chr(c))[0]
        kind[c] = 0 if c in (9, 10, 13, 32) else {"L": 1, "N": 2}.get(group, 3)
        lower[c] = ord(chr(c).lower())
    return kind, lower


class WordTokenizer:
    """Ids of whole texts; the ids of a word are worked out once and kept.

    The vocabulary's rules split text into contractions, runs of letters, single numbers and runs of the rest, whatever
    stands beside them, so a word's ids do not depend on its neighbours. Splitting and lookup work on whole batches of
    bytes. Texts with special tokens or characters beyond U+017F are given to the tokenizer whole.
    """

    SLOTS = 1 << 21
    MOST = 2_000_000  # words kept

    def __init__(self, content: str):
        import json

        import numpy as np
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(content)
        self._special = [t["content"] for t in json.loads(content)["added_tokens"]]
        self._kind, self._lower = _character_tables()
        self._letters = _byte_letters()
        self._np = np
        self._forget()

    def _forget(self) -> None:
        np = self._np
        self._slot_hash, self._slot_word = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int64)
        self._overflow: dict[int, int] = {}
        self._at, self._ids, self._used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0
        self._words = 0

    def whole(self, text: str) -> bytes:
        return self._np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _add(self, h: int, word: bytes) -> int:
        """Number of a new word."""
        np = self._np
        letters = self._letters
        ids = [t.id for t in self._tokenizer.model.tokenize("".join([letters[b] for b in word]))]
        if self._words + 2 > len(self._at):
            self._at = np.concatenate([self._at, np.zeros_like(self._at)])
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + len(ids)] = ids
        self._used += len(ids)
        n, self._words = self._words, self._words + 1
        self._at[n + 1] = self._used
        slot = h & (self.SLOTS - 1)
        if self._slot_word[slot] < 0:
            self._slot_hash[slot], self._slot_word[slot] = h, n
        else:
            self._overflow[h] = n
        return n

    def _units(self, data, at):
        """Lower-cased bytes; spans of the units of all texts; the first unit of each text; texts to be left alone."""
        np = self._np
        n = len(data)
        point = data.astype(np.int32)
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
        follows = lead + 1
        point[lead] = ((point[lead] & 31) << 6) | (data[follows] & 63)
        odd = (data > 0xC5) | ((data < 32) & (data != 9) & (data != 10) & (data != 13)) | (data == 127)
        kind = np.full(n, 9, np.uint8)
        safe = ~odd
        safe[follows] = False
        kind[safe] = self._kind[np.minimum(point[safe], 383)]
        odd |= (kind == 9) & safe
        low = data.copy()
        upper = (data >= 65) & (data <= 90)
        low[upper] += 32
        lp = self._lower[np.minimum(point[lead], 383)]
        low[lead], low[follows] = 0xC0 | (lp >> 6), 0x80 | (lp & 63)
        first = np.ones(n, bool)  # bytes that begin a character
        first[follows] = False
        kind[follows] = kind[lead]
        starts_text = np.zeros(n + 1, bool)
        starts_text[at] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        begin = (change | starts_text[:n] | ((kind == 2) & first)) & (kind != 0)
        start = np.flatnonzero(begin)
        edge = np.flatnonzero(change | starts_text[:n] | ((kind == 2) & first))
        end = np.append(edge[1:], n)[np.searchsorted(edge, start)]
        return low, *self._contract(low, kind, start, end, starts_text), odd

    def _contract(self, low, kind, start, end, starts_text):
        """Give an apostrophe that stands alone the letters of a contraction in the same text."""
        np = self._np
        lone = np.flatnonzero((low[start] == 39) & (end - start == 1))
        lone = lone[lone + 1 < len(start)]
        after = start[lone + 1]
        lone = lone[(after == end[lone]) & (kind[after] == 1) & ~starts_text[after]]
        if not len(lone):
            return start, end
        taken = np.zeros(len(lone), np.int64)
        room = end[lone + 1] - end[lone]
        for c in _CONTRACTIONS[::-1]:
            same = room >= len(c)
            for k, b in enumerate(c.encode()):
                same &= low[np.minimum(end[lone] + k, len(low) - 1)] == b
            taken[same] = len(c)
        start, end = start.copy(), end.copy()
        end[lone] += taken
        start[lone + 1] += taken
        keep = start < end
        return start[keep], end[keep]

    def batch(self, data, at) -> list[bytes]:
        """Ids of every text as little-endian bytes."""
        from tidegauge.llm.arrow_text import hash_spans

        np = self._np
        if self._words > self.MOST:
            self._forget()
        low, start, end, odd = self._units(data, at)
        own = np.concatenate([[0], np.cumsum(odd)])
        alone = set(np.flatnonzero(own[at[1:]] > own[at[:-1]]).tolist())
        raw = data.tobytes()
        for s in self._special:
            p = raw.find(s.encode())
            while p >= 0:
                alone.add(int(np.searchsorted(at, p, "right")) - 1)
                p = raw.find(s.encode(), p + 1)
        row_at = np.searchsorted(start, at)
        h = hash_spans(low, start, end)
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        word = np.where(self._slot_hash[slot] == h, self._slot_word[slot], -1)
        missing = np.flatnonzero(word < 0)
        if len(missing):
            new, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
            text = low.tobytes()
            found = np.empty(len(new), np.int64)
            for k, (x, i) in enumerate(zip(new.tolist(), missing[where].tolist(), strict=True)):
                w = self._overflow.get(x)
                found[k] = self._add(x, text[start[i] : end[i]]) if w is None else w
            word[missing] = found[back]
        size = self._at[word + 1] - self._at[word]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self._ids[np.repeat(self._at[word] - total[:-1], size) + np.arange(total[-1])].astype("<u4").tobytes()
        edges = (4 * total[row_at]).tolist()
        return [self.whole(raw[at[i] : at[i + 1]].decode()) if i in alone else flat[edges[i] : edges[i + 1]] for i in range(len(at) - 1)]


def _byte_letters() -> list[str]:
    """Printable Latin-1 bytes stand for themselves; the others, in order, for the characters from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    rest = [b for b in range(256) if b not in plain]
    own = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [own[b] for b in range(256)]


_tokenizers: dict[int, WordTokenizer] = {}


def _tokenizer(shared) -> WordTokenizer:
    content = shared.value
    key = hash(content)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(content)
    return _tokenizers[key]


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, checksum and, if asked for, the ids.

    ``tokenizer_path`` is read once on the driver; its content, fixed in size, is broadcast.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end, width = separator.to_bytes(4, "little"), 4 * capacity

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = _tokenizer(shared)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, offsets = column_bytes(batch.column(1))
            for lo, hi, part, at_ in runs(data, offsets, RUN):
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for key, whole in zip(keys[lo:hi], tokenizer.batch(part, at_), strict=True):
                    whole += end
                    for k, at in enumerate(range(0, len(whole), width)):
                        own = whole[at : at + width]
                        doc.append(key)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        encode, PIECE + (", ids array<int>" if with_ids else ""))


class OpenBins:
    """At most ``bound`` open bins, found by free space through the bits of one integer."""

    def __init__(self, capacity: int, bound: int):
        self.capacity, self.bound = capacity, bound
        self.free = 0  # bit f is set while a bin with f free places is open
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.made = 0
        self.closed: set[int] = set()

    def _take(self, f: int) -> int:
        bins = self.by_free[f]
        b = bins.pop()
        if not bins:
            self.free &= ~(1 << f)
        self.open -= 1
        return b

    def put(self, length: int) -> tuple[int, int]:
        """Number of the bin and the place in it."""
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            b = self._take(f)
        else:
            f, b = self.capacity, self.made
            self.made += 1
            if self.open >= self.bound and length < self.capacity:
                fullest = (self.free & -self.free).bit_length() - 1
                self.closed.add(self._take(fullest))
        left = f - length
        if left:
            self.by_free[left].append(b)
            self.free |= 1 << left
            self.open += 1
        else:
            self.closed.add(b)
        return b, self.capacity - f


def _pack_once(rows: DataFrame, capacity: int, bound: int, level: int) -> DataFrame:
    def pack(batches):
        import numpy as np
        from pyspark import TaskContext

        bins, kept, numbers, places = OpenBins(capacity, bound), [], [], []
        base = (level << 56) | (TaskContext.get().partitionId() << 32)

        def ready():
            """Rows whose bins are settled leave at once; the others wait for the end of the task."""
            n = np.array(numbers, np.int64)
            return n, np.fromiter((b in bins.closed for b in numbers), bool, len(numbers))

        def out(table, n, place, shut):
            names = [*table.schema.names, "sequence_id", "offset", "shut"]
            cols = [*table.columns, pa.array(base + n), pa.array(place), pa.array(shut)]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names)

        for batch in batches:
            for length in batch.column(3).to_pylist():
                b, at = bins.put(length)
                numbers.append(b)
                places.append(at)
            kept.append(batch)
            table = pa.Table.from_batches(kept)
            n, shut = ready()
            place = np.array(places, np.int64)
            if shut.any():
                yield out(table.filter(pa.array(shut)).combine_chunks(), n[shut], place[shut], shut[shut])
                table = table.filter(pa.array(~shut)).combine_chunks()
                numbers, places = n[~shut].tolist(), place[~shut].tolist()
                bins.closed.clear()
            kept = table.to_batches()
        if kept:
            table = pa.Table.from_batches(kept)
            yield out(table, np.array(numbers, np.int64), np.array(places, np.int64), np.zeros(len(numbers), bool))

    return rows.mapInArrow(pack, PACKED + ", shut boolean")


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 256, fan_in: int = 8) -> DataFrame:
    """Pieces with the sequence they go to and their place in it.

    ``fan_in`` tasks' unfinished bins meet in one task of the next level, until one task is left.
    """
    columns = pieces.columns
    rest, done, level = pieces, [], 0
    while True:
        tasks = rest.rdd.getNumPartitions()
        packed = stored(_pack_once(rest, capacity, open_bins, level), f"packed-{level}")
        if tasks <= 1:
            done.append(packed)
            break
        done.append(packed.filter("shut"))
        rest = packed.filter("not shut").select(*columns).coalesce(-(-tasks // fan_in))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("shut")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, open_bins: int = 256) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text); one row per piece."""
    return pack(stored(cut(docs, tokenizer_path, capacity), "pieces"), capacity, open_bins)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """The packed token ids: one row per sequence. Needs unique doc_id."""
    ids = cut(docs, tokenizer_path, capacity, with_ids=True).select("doc_id", "piece", "ids")
    placed = packed.join(ids, ["doc_id", "piece"])
    return placed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
