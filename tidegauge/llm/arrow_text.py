"""Whole Arrow batches of text as flat arrays of bytes, words and lines.

Everything here works on one batch inside a task. A word is a maximal run of bytes that are ASCII letters, digits or part
of a non-ASCII character; A-Z fold to a-z. NULL text is empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21  # bytes of text worked on at once
PIECE = 1 << 19  # the same where many operators follow one another in one worker
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.arange(256, dtype=np.uint64)
_FOLDED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + np.uint64(32), _BYTES)
_VALUE = mix(_FOLDED + np.uint64(0x1234567))
IS_WORD = ((_FOLDED >= 97) & (_FOLDED <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES >= 128)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other, and where each begins (with the end)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = pc.cast(col, pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, row after the last, bytes, offsets."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n, i + (1 << 20))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; ASCII letters are folded."""
    n = len(data)
    up, down = _power_table(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


class Words:
    """The words of a run of texts: byte spans, 64-bit hashes and the text each belongs to."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(data)
        inside = IS_WORD[data] if n else np.zeros(0, bool)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[at[:-1][at[:-1] < n]] = False
            after[at[1:][at[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row_at = np.searchsorted(self.start, at)  # words of row i: row_at[i]:row_at[i + 1]
        self._data = data
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self._data, self.start, self.end)
        return self._hash

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_at) - 1), np.diff(self.row_at))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
