"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are split by the tokenizer's pattern. The distinct pieces a worker has
not met yet are put into length buckets, one padded matrix row a piece; each
round every row merges its leftmost pair of least rank (pair ranks come from an
open-addressed hash table) and finished rows leave the matrix. Ids of a text
are then a gather over its pieces. Decoding is a gather of token bytes by id.

Ranks reach the executors as one broadcast of the rank file, whose size is
checked (a vocabulary does not grow with the data).

Defined results: a null text is the empty text (no ids, no bytes); rows keep
their multiplicity; a null id stays null; other input columns are ignored; an
empty table gives an empty table. Texts and pieces of any length are encoded
whole: pieces longer than ``MATRIX_BYTES`` would need as many rounds as bytes
and use the same merge rule on a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textops as T

MATRIX_BYTES = 256
MATRIX_CELLS = 1 << 20
#: Pieces a worker remembers before it starts anew.
CACHE_PIECES = 1 << 18
MAX_RANK_FILE = 64 << 20
NONE = np.int64(1) << 40


class PairTable:
    """Hash table (left id, right id) -> rank with linear probing."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int64)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            # of several keys that want one free slot the last written stays
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.ranks[slot[won]] = ranks[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (T.mix(keys.astype(np.uint64)) & self.mask).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is none or an id is -1."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(keys.shape, NONE, dtype=np.int64)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (held >= 0)
            todo, slot = todo[on], (slot[on] + 1) & int(self.mask)
        return out.reshape(shape)


class Codec:
    """Encoder and decoder for one rank table and one split pattern."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left = ranks.get(token[:k])
                right = ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64))
        self.token_of = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.single < 0).any():
            raise ValueError("the rank table lacks single bytes")
        size = max(ranks.values()) + 1
        self.token_len = np.zeros(size, dtype=np.int64)
        by_id: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
            self.token_len[rank] = len(token)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self._forget()

    # -- pieces ---------------------------------------------------------
    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int64)
        self.at = np.zeros(0, dtype=np.int64)
        self.n = np.zeros(0, dtype=np.int64)

    def _matrix(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes."""
        lens = np.array([len(x) for x in rows])
        data = np.frombuffer(b"".join(rows), dtype=np.uint8)
        ids = np.full((len(rows), width + 1), -1, dtype=np.int64)
        ids[np.arange(width + 1) < lens[:, None]] = self.single[data]
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        alive = np.arange(len(rows))
        out: list[np.ndarray] = [None] * len(rows)  # type: ignore[list-item]
        while len(alive):
            j = rank.argmin(axis=1)  # the leftmost of the least
            best = rank[np.arange(len(alive)), j]
            done = best >= NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[alive[r]] = ids[r, :lens[alive[r]]].copy()
                keep = ~done
                alive, ids, rank, j, best = alive[keep], ids[keep], rank[keep], j[keep], best[keep]
                if not len(alive):
                    break
                used = int(lens[alive].max())  # narrower once the long rows are shorter
                ids, rank = ids[:, :used + 1], rank[:, :used]
            at = np.arange(len(alive))
            cols = np.arange(ids.shape[1])
            # drop the right half of the merged pair and close the gap
            move = np.minimum(cols + (cols > j[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, move, axis=1)
            ids[:, -1] = -1
            ids[at, j] = best
            lens[alive] -= 1
            rank = np.take_along_axis(rank, np.minimum(move[:, :-1], rank.shape[1] - 1), axis=1)
            rank[:, -1] = NONE
            rank[at, j] = self.pairs.get(best, ids[at, j + 1])
            left = np.flatnonzero(j > 0)
            rank[left, j[left] - 1] = self.pairs.get(ids[left, j[left] - 1], best[left])
        return out

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, in O(n log n)."""
        ids = [int(x) for x in self.single[np.frombuffer(piece, dtype=np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        def offer(i: int) -> None:
            k = after[i]
            if k < n:
                r = self.ranks.get(self.token_of[ids[i]] + self.token_of[ids[k]])
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = after[i] if ids[i] == a else n
            if k >= n or ids[k] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[k] = r, -1
            after[i] = after[k]
            if after[k] < n:
                before[after[k]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], dtype=np.int64)

    def pieces(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [None] * len(rows)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, x in enumerate(rows):
            if len(x) > MATRIX_BYTES:
                out[i] = self._heap(x)
            else:
                buckets.setdefault(max(4, 1 << (len(x) - 1).bit_length() if len(x) > 1 else 1), []).append(i)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for k in range(0, len(members), step):
                part = members[k:k + step]
                for i, ids in zip(part, self._matrix([rows[i] for i in part], width)):
                    out[i] = ids
        return out

    # -- texts ----------------------------------------------------------
    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's ids."""
        split = [self.pattern.findall(t) for t in texts]
        if len(self.known) > CACHE_PIECES:
            self._forget()
        known = self.known
        new = list(set().union(*split).difference(known))
        if new:
            ids = self.pieces([p.encode() for p in new])
            lens = np.array([len(x) for x in ids], dtype=np.int64)
            at = len(self.flat) + np.concatenate([[0], np.cumsum(lens)[:-1]])
            for k, p in enumerate(new, len(self.n)):
                known[p] = k
            self.flat = np.concatenate([self.flat, *ids])
            self.at, self.n = np.concatenate([self.at, at]), np.concatenate([self.n, lens])
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        n = self.n[which]
        flat = self.flat[_spread(self.at[which], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat, ends[np.concatenate([[0], np.cumsum([len(ps) for ps in split], dtype=np.int64)])]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the offset of each id's bytes."""
        n = self.token_len[ids]
        return self.token_bytes[_spread(self.token_at[ids], n)], np.concatenate([[0], np.cumsum(n)])


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions at[i] .. at[i]+n[i] for all i, in order."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(n) - n
    out = np.repeat(at - before, n)
    out += np.arange(total)
    return out


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec a worker process."""
    key = (hash(raw), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
        keep_ids: bool = True) -> DataFrame:
    """Encode and decode every text. Returns ``id_col``, n_tokens,
    ids_sha256, decoded_sha256 and, if ``keep_ids``, the ids themselves."""
    spark = docs.sparkSession
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_FILE + 1)
    if len(raw) > MAX_RANK_FILE:
        raise ValueError(f"{path}: rank file over {MAX_RANK_FILE} bytes")
    shared = spark.sparkContext.broadcast(raw)
    id_type = docs.schema[id_col].dataType
    schema = f"{id_col} {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if keep_ids else ""

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            ids_in, texts = batch.column(0), batch.column(1)
            for part in T.slices(texts):
                rows = [part.text(i).decode("utf-8", "replace") for i in range(len(part))]
                flat, off = c.encode(rows)
                raw_bytes, at = c.decode(flat)
                packed = flat.astype("<u4")
                enc = [hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:])]
                dec = [hashlib.sha256(raw_bytes[at[a]:at[b]]).hexdigest() for a, b in zip(off[:-1], off[1:])]
                cols = [ids_in.slice(part.first, len(part)), pa.array(np.diff(off)), pa.array(enc), pa.array(dec)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(off.astype(np.int32), flat.astype(np.int32)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
