"""Vectorised text helpers: byte-level tokenisation and rolling hashes.

A batch of texts is one UTF-8 buffer plus offsets (Arrow's own layout), so
word boundaries, word hashes and n-gram hashes are whole-array numpy passes
with no per-word Python. Word classes are byte classes: every separator the
operators use is ASCII, hence a byte test equals a code-point test.

Hashes are polynomial prefix sums modulo 2**64 over a random byte table,
finished with a 64-bit mixer; ``lane`` picks one of two independent tables, so
a pair of lanes is a 128-bit key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of text handled at once; bounds the arrays a Python worker holds.
SLICE_BYTES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_class(kind: str) -> np.ndarray:
    mask = np.ones(256, dtype=bool)
    if kind == "space":  # [^\x20\x09-\x0D]+
        mask[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
        mask[:128] = False
        mask[48:58] = mask[65:91] = mask[97:123] = True
    else:
        raise ValueError(kind)
    return mask


CLASSES = {k: _word_class(k) for k in ("space", "alnum")}


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n at least (one table a lane is
    kept, regrown when a longer buffer comes)."""
    if lane not in _POWERS or len(_POWERS[lane][0]) < n:
        size = max(1 << 12, n + n // 8)
        up = np.full(size, _BASE[lane], dtype=np.uint64)
        down = np.full(size, pow(_BASE[lane], -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[lane] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[lane]


@lru_cache(maxsize=4)
def byte_table(lane: int, lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019 + 2 * lane + 2))
    return table[_LOWER] if lower else table


class Slice:
    """Some consecutive rows of a text column as one byte buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and row offsets of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, raw = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Rows in order, in runs of about ``max_bytes`` (a longer text is alone)."""
    if len(col) == 0:
        return
    data, offsets = buffers(col)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        lo, hi = offsets[i], offsets[j]
        yield Slice(data[lo:hi], offsets[i:j + 1] - lo, i)
        i = j


class Words:
    """The words of a slice: byte spans, and where each row's words begin."""

    def __init__(self, part: Slice, kind: str):
        self.part = part
        data, offsets = part.data, part.offsets
        inside = CLASSES[kind][data]
        # a row's first byte never continues the previous row's word
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | first[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        #: row i owns words off[i] .. off[i+1]
        self.off = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.off)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.part)), self.counts)

    def hashes(self, lane: int = 0, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word (A-Z as a-z if ``lower``)."""
        data = self.part.data
        up, down = powers(lane, len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(byte_table(lane, lower)[data] * up[:len(data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))

    def room(self) -> np.ndarray:
        """Words from each word to the end of its row, itself included."""
        return np.repeat(self.off[1:], self.counts) - np.arange(len(self))


def prefix(h: np.ndarray, lane: int = 0) -> np.ndarray:
    """Prefix sums over word hashes for ``ranges``."""
    up, _ = powers(lane, len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[:len(h)], out=sums[1:])
    return sums


def ranges(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of the word sequence lo .. hi (exclusive), wherever it stands."""
    _, down = powers(lane, len(sums))
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def grams(sums: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hashes of all k-word sequences of the buffer (also those that cross a
    row's end: mask them with ``room() >= k``)."""
    n = len(sums) - 1 - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    _, down = powers(lane, len(sums))
    return mix((sums[k:k + n] - sums[:n]) * down[:n] + np.uint64(k))


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of the positions below n inside any of the ranges lo .. hi."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def output_schema(fields: list[tuple[str, DataType | str]]) -> StructType:
    """Schema from (name, type or simple type name)."""
    return StructType([StructField(n, k if isinstance(k, DataType) else DataType.fromDDL(k)) for n, k in fields])
