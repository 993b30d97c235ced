"""Benchmark decontamination: hashed test n-grams against document windows.

The benchmark's windows (``n`` consecutive words, or the whole of a shorter
item) form a hash set that is broadcast; tasks roll the same hash over every
token window of their documents, look it up (bit table first, then the sorted
hashes) and verify each hit word by word.

The benchmark's size is checked before it is collected. A larger one is cut
into blocks of items under the same bound; each block is broadcast on its own
and the marks of all blocks are put together per document.

Defined results: documents with null or empty text have no words; items with a
null id or no words are ignored; repeated items count once (by id), repeated
documents keep their multiplicity; other columns are ignored; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textops as T
from vigil.session import materialize

#: Bytes of benchmark text broadcast at once.
MAX_BLOCK_BYTES = 32 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class WindowSet:
    """Windows of benchmark items by word hash, grouped by their length."""

    def __init__(self, ids: list[str], texts: list[str], n: int):
        self.words = [_WORD.findall(t.encode().lower()) for t in texts]
        self.ids = ids
        col = pa.array(texts, pa.string())
        found: dict[int, list[np.ndarray]] = {}
        for part in T.slices(col):
            w = T.Words(part, "alnum")
            sums = T.prefix(w.hashes(lower=True))
            for i in range(len(part)):
                lo, hi = int(w.off[i]), int(w.off[i + 1])
                m = min(n, hi - lo)
                if not m:
                    continue
                at = np.arange(lo, hi - m + 1)
                h = T.ranges(sums, at, at + m)
                item = np.full(len(at), part.first + i)
                found.setdefault(m, []).append(np.stack([h.view(np.int64), item, at - lo]))
        self.by_len = {}
        for m, parts in sorted(found.items()):
            h, item, at = np.concatenate(parts, axis=1)
            order = np.argsort(h, kind="stable")
            h, item, at = h[order], item[order], at[order]
            bits = max(16, int(len(h) * 16).bit_length())
            seen = np.zeros(1 << bits, dtype=bool)
            seen[h & ((1 << bits) - 1)] = True
            # distinct windows: their words, and the items that have each
            keys, first = np.unique(h, return_index=True)
            windows: list[dict[bytes, np.ndarray]] = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(h)]):
                own: dict[bytes, list[int]] = {}
                for k in range(a, b):
                    own.setdefault(b" ".join(self.words[item[k]][at[k]:at[k] + m]), []).append(int(item[k]))
                windows.append({x: np.unique(y) for x, y in own.items()})
            self.by_len[m] = (keys, windows, seen, (1 << bits) - 1)

    def scan(self, w: T.Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Mask of the words inside any occurring window, and the items that
        occur in each row."""
        hit = np.zeros(len(w), dtype=bool)
        items: dict[int, set[int]] = {}
        if not len(w) or not self.by_len:
            return hit, items
        sums = T.prefix(w.hashes(lower=True))
        room = w.room()
        los, his = [], []
        data = None
        for m, (keys, windows, seen, mask) in self.by_len.items():
            g = T.grams(sums, m).view(np.int64)
            p = np.flatnonzero(seen[g & mask] & (room[:len(g)] >= m))
            which = np.minimum(np.searchsorted(keys, g[p]), len(keys) - 1)
            ok = keys[which] == g[p]
            p, which = p[ok], which[ok]
            if len(p) and data is None:
                data = w.part.data.tobytes().lower()
            rows = np.searchsorted(w.off, p, side="right") - 1
            found: dict[tuple[int, int, bytes], None] = {}  # a window is looked up once a hit, its items once a row
            for i, k, r in zip(p.tolist(), which.tolist(), rows.tolist()):
                own = b" ".join(data[s:e] for s, e in zip(w.starts[i:i + m], w.ends[i:i + m]))
                if own in windows[k]:
                    found[r, k, own] = None
                    los.append(i)
                    his.append(i + m)
            for r, k, own in found:
                items.setdefault(r, set()).update(windows[k][own].tolist())
        if los:
            hit = T.covered(len(w), np.array(los), np.array(his))
        return hit, items


_SETS: list[tuple] = []


def _window_set(shared, n: int) -> WindowSet:
    """One set a worker process, of the broadcast it has seen last."""
    if not _SETS or _SETS[0][0] is not shared or _SETS[0][1] != n:
        _SETS[:] = [(shared, n, WindowSet(*shared.value, n))]
    return _SETS[0][2]


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Lists (ids, texts) of at most about ``MAX_BLOCK_BYTES`` each."""
    own = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).distinct()
    total = own.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    count = max(1, -(-2 * total // MAX_BLOCK_BYTES)) if total > MAX_BLOCK_BYTES else 1
    for k in range(count):
        part = own if count == 1 else own.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k)
        rows = part.orderBy("id", "text").collect()
        yield [r["id"] for r in rows], [r["text"] for r in rows]


def _summary(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", whole_rows: bool = False) -> DataFrame:
    """Per document: ``id_col`` (or, with ``whole_rows``, the input row as a
    struct ``row``), n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    head = "row" if whole_rows else id_col
    own = docs.select((every if whole_rows else F.col(id_col)).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(items, item_id, item_text)
    first, rest = next(blocks), list(_shared(spark, blocks))
    out_schema = T.output_schema([
        (head, docs.schema if whole_rows else docs.schema[id_col].dataType), ("n_words", "long"), ("n_hit", "long"),
        ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")])
    names = out_schema.names
    shared = spark.sparkContext.broadcast(first)
    if not rest:
        def run(batches):
            known = _window_set(shared, n)
            for batch in batches:
                texts = batch.column(0).field(text_col).cast(pa.string()) if whole_rows else batch.column(1)
                for part in T.slices(texts):
                    w = T.Words(part, "alnum")
                    hit, items_of = known.scan(w)
                    edge = np.concatenate([[0], np.cumsum(hit)])
                    n_hit = edge[w.off[1:]] - edge[w.off[:-1]]
                    ids = [sorted({known.ids[k] for k in items_of.get(i, ())}) for i in range(len(part))]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(part.first, len(part)), pa.array(w.counts.astype(np.int64)),
                        pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([_summary(x) for x in ids]), pa.array(n_hit > 0)], names=names)
        return (own.select("id") if whole_rows else own).mapInArrow(run, out_schema)

    # several blocks: runs of hit words and items per row and block, put together by row
    keyed = materialize(own.withColumn("at", F.monotonically_increasing_id()), "decontaminate")

    def marks(block):
        def run(batches):
            known = _window_set(block, n)
            for batch in batches:
                for part in T.slices(batch.column(1)):
                    w = T.Words(part, "alnum")
                    hit, items_of = known.scan(w)
                    runs = [np.flatnonzero(hit[a:b]).tolist() for a, b in zip(w.off[:-1], w.off[1:])]
                    ids = [sorted({known.ids[k] for k in items_of.get(i, ())}) for i in range(len(part))]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(2).slice(part.first, len(part)), pa.array(w.counts.astype(np.int64)),
                        pa.array(runs, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))],
                        names=["at", "n_words", "hits", "ids"])
        return keyed.mapInArrow(run, "at long, n_words long, hits array<long>, ids array<string>")

    merged = marks(shared)
    for block in rest:
        merged = merged.unionByName(marks(block))
    merged = merged.groupBy("at").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return keyed.select("at", "id").join(merged, "at").select(
        F.col("id").alias(head), "n_words", F.size("hits").cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def _shared(spark, blocks):
    for block in blocks:
        yield spark.sparkContext.broadcast(block)
