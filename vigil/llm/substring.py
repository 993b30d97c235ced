"""Substring dedup: winnowed anchors as seeds, extension of the matches.

A word is removed if a run of ``length`` words over it also starts in a
document with a smaller id.

1. Seeds. Of every ``length`` consecutive words the ``K``-word sequence of
   least hash is an anchor (winnowing): two documents that share such a run
   share an anchor in it. Documents meet on their anchors.
2. Extension. Every anchor carries a hash of its whole surroundings, as far as
   any run over it reaches to both sides. Where a smaller document has the
   same surroundings, all runs over the anchor repeat. Of documents with equal
   surroundings only the smallest goes on.
3. Ends of matches. What is left are shared anchors whose surroundings differ:
   there the match ends on one side. The runs they are the anchor of are
   compared by a 128-bit hash of the run itself.
4. The union of the repeated runs of a document, its maximal repeats, is cut.

No pair of documents is ever formed: work is linear in the anchors. A task
settles repeats within its own batch before the shuffle, so a passage with
very many copies reaches the shuffle once a batch. Anchors that very many rows
have are counted first; they are dealt by anchor and surroundings, and where no
smaller document has these, the runs over them are compared (3), so a common
phrase is spread over as many groups as it has surroundings. All other anchors
have less than ``OFTEN`` rows, or a few thousandths of all.

Defined results: null and empty texts have no words; a document without id is
never cut and cuts nothing; rows that repeat an id are no source for each
other and are each judged on their own text; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import textops as T
from vigil.session import materialize

#: Words in an anchor.
K = 6
FULL, FRINGE, RUN = 0, 1, 2
#: Rows from which an anchor is frequent, and the least share of all rows (1 in
#: so many), which bounds the list of frequent anchors.
OFTEN, OFTEN_SHARE = 1 << 16, 1 << 16
#: Anchors counted at once, and the share of them (1 in so many) from which one
#: is reported.
COUNTED, REPORTED = 1 << 21, 1 << 12
_KIND = 32  # a mark is kind << 32 | word position


def _least(v: np.ndarray, span: int) -> np.ndarray:
    """Position of the first least value of every ``span`` neighbours."""
    p = np.arange(len(v))
    have = 1
    while have < span and len(v) > 0:
        step = min(have, span - have)
        if len(v) <= step:
            return np.zeros(0, dtype=np.int64)
        less = v[step:] < v[:-step]
        v, p = np.where(less, v[step:], v[:-step]), np.where(less, p[step:], p[:-step])
        have += step
    return p


def anchors(sums: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Word positions of the anchors of all rows of a slice, in order."""
    p = _least(T.grams(sums, K), length - K + 1)
    p = p[room[:len(p)] >= length]
    return p[np.concatenate([[True], p[1:] != p[:-1]])] if len(p) else p


def _settle(key1: np.ndarray, key2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of the rows whose two keys occur with a smaller document here."""
    out = np.zeros(len(doc), dtype=bool)
    if len(doc):
        order = np.lexsort((doc, key2, key1))
        a, b, d = key1[order], key2[order], doc[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        out[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _unique_keys(n: int, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys that meet nothing: settled rows travel evenly spread."""
    return T.mix(T.mix(doc.view(np.uint64)) + at.astype(np.uint64)).view(np.int64)


def _reported(length: int):
    """Counts of the anchors that are common in a part of the texts; a null
    anchor has the number of all."""
    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            a, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(2, size // REPORTED)
            return pa.RecordBatch.from_arrays([pa.array([None, *a[keep].tolist()], pa.int64()),
                                               pa.array([size, *n[keep].tolist()], pa.int64())], names=["a", "n"])

        for batch in batches:
            for part in T.slices(batch.column(0)):
                w = T.Words(part, "space")
                sums = T.prefix(w.hashes())
                at = anchors(sums, w.room(), length)
                held.append(T.ranges(sums, at, at + K).view(np.int64))
                size += len(at)
                if size >= COUNTED:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
    return run


def frequent(base: DataFrame, length: int) -> np.ndarray:
    """Anchors of very many rows of ``base`` (text), sorted: OFTEN_SHARE at
    most. A row's anchor is missed only where less than one in REPORTED of the
    anchors counted with it are the same."""
    counts = materialize(base.select("text").mapInArrow(_reported(length), "a long, n long").groupBy("a").agg(
        F.sum("n").alias("n")), "substring-common")
    total = counts.where("a is null").agg(F.max("n")).first()[0] or 0
    least = max(OFTEN, total // OFTEN_SHARE + 1)
    rows = counts.where((F.col("n") >= least) & F.col("a").isNotNull()).select("a").collect()
    return np.array(sorted(r["a"] for r in rows), dtype=np.int64)


def _seeds(length: int, common):
    reach = length - K

    def run(batches):
        often = common.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            tags = np.asarray(batch.column(1))
            for part in T.slices(batch.column(2)):
                w = T.Words(part, "space")
                h = w.hashes()
                s0, s1 = T.prefix(h), T.prefix(h, 1)
                at = anchors(s0, w.room(), length)
                row = np.searchsorted(w.off, at, side="right") - 1
                lo = np.maximum(at - reach, w.off[row])
                hi = np.minimum(at + length, w.off[row + 1])
                a = T.ranges(s0, at, at + K).view(np.int64)
                c = (T.ranges(s1, lo, hi, 1) + (at - lo).astype(np.uint64)).view(np.int64)
                doc, tag = ids[part.first + row], tags[part.first + row]
                pos = at - w.off[row]
                done = _settle(a, c, doc)
                known = np.zeros(len(a), dtype=bool)
                if len(often):
                    known = often[np.minimum(np.searchsorted(often, a), len(often) - 1)] == a
                    a = np.where(known, T.mix(a.view(np.uint64) + T.mix(c.view(np.uint64))).view(np.int64), a)
                a = np.where(done, _unique_keys(len(a), doc, pos), a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(c), pa.array(doc), pa.array(tag << 32 | pos), pa.array(done), pa.array(known)],
                    names=["a", "c", "doc", "at", "done", "often"])
    return run


def _marks_of(col: pa.Array, part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Marks of a slice's rows and the row of each."""
    own = col.slice(part.first, len(part))
    off = np.asarray(own.offsets).astype(np.int64)
    if own.null_count:
        lens = np.where(np.asarray(own.is_null()), 0, np.diff(off))
    else:
        lens = np.diff(off)
    return np.asarray(own.flatten()).astype(np.int64), np.repeat(np.arange(len(part)), lens)


def _ends(length: int):
    def run(batches):
        for batch in batches:
            ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for part in T.slices(batch.column(2)):
                marks, row = _marks_of(batch.column(3), part)
                w = T.Words(part, "space")
                h = w.hashes()
                s0, s1 = T.prefix(h), T.prefix(h, 1)
                room = w.room()
                at = w.off[row] + marks
                open_ = np.zeros(len(w) + 1, dtype=bool)
                open_[at] = True
                own = _least(T.grams(s0, K), length - K + 1)  # the anchor of each run
                s = np.flatnonzero(open_[own] & (room[:len(own)] >= length))
                r = np.searchsorted(w.off, s, side="right") - 1
                h1, h2 = (T.ranges(x, s, s + length, k).view(np.int64) for k, x in enumerate((s0, s1)))
                doc, tag = ids[part.first + r], tags[part.first + r]
                pos = s - w.off[r]
                done = _settle(h1, h2, doc)
                h1 = np.where(done, _unique_keys(len(h1), doc, pos), h1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), pa.array(doc), pa.array(tag << 32 | pos), pa.array(done)],
                    names=["h1", "h2", "doc", "at", "done"])
    return run


def _cut(length: int, names: list[str], keep_text: bool):
    reach = length - K

    def run(batches):
        for batch in batches:
            for part in T.slices(batch.column(1)):
                w = T.Words(part, "space")
                gone = np.zeros(len(w), dtype=bool)
                if batch.num_columns > 2 and len(w):
                    marks, row = _marks_of(batch.column(2), part)
                    kind, at = marks >> _KIND, w.off[row] + (marks & 0xFFFFFFFF)
                    last = w.off[row + 1] - length  # the last run of the row
                    lo = np.where(kind == RUN, at, np.maximum(at - reach, w.off[row]))
                    hi = np.where(kind == RUN, at, np.minimum(at, last)) + length
                    gone = T.covered(len(w), lo, hi)
                edge = np.concatenate([[0], np.cumsum(gone)])
                removed = edge[w.off[1:]] - edge[w.off[:-1]]
                data = part.data.tobytes()
                keep = np.flatnonzero(~gone)
                starts, ends = w.starts[keep].tolist(), w.ends[keep].tolist()
                kept_off = (w.off - edge[w.off]).tolist()
                texts = [b" ".join([data[a:b] for a, b in zip(starts[i:j], ends[i:j])])
                         for i, j in zip(kept_off[:-1], kept_off[1:])]
                cols = [batch.column(0).slice(part.first, len(part)), pa.array(w.counts.astype(np.int64)),
                        pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                if keep_text:
                    cols.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def dedup(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text",
          keep_text: bool = False) -> DataFrame:
    """Per document: ``id_col`` (an integer), n_words, n_removed, kept_sha256
    and, if ``keep_text``, the text of the kept words."""
    if length <= K:
        raise ValueError(f"length must be over {K}")
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("own"), F.col(id_col).cast("long").alias("doc"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = own.where("doc is not null").select(
        "own", "doc", F.expr("xxhash64(text) & 2147483647").alias("tag"), "text")

    common = docs.sparkSession.sparkContext.broadcast(frequent(base, length))  # 512 KB at most
    seeds = base.select("doc", "tag", "text").mapInArrow(
        _seeds(length, common), "a long, c long, doc long, at long, done boolean, often boolean")
    same_anchor, same_place = Window.partitionBy("a"), Window.partitionBy("a", "c")
    met = seeds.select(
        "doc", "at", "often", (F.col("done") | (F.min("doc").over(same_place) < F.col("doc"))).alias("full"),
        (F.min("doc").over(same_anchor) < F.max("doc").over(same_anchor)).alias("shared"),
        (F.min("c").over(same_anchor) < F.max("c").over(same_anchor)).alias("differ"))
    kind = F.when(F.col("full"), FULL).otherwise(FRINGE)
    split_at = [F.col("doc"), F.expr("shiftright(at, 32)").alias("tag")]
    marks = materialize(met.where("full or often or (shared and differ)").select(
        *split_at, F.expr("at & 4294967295").alias("pos"), kind.cast("long").alias("kind")), "substring-marks")
    code = F.expr(f"shiftleft(kind, {_KIND}) | pos")

    fringe = marks.where(f"kind = {FRINGE}").groupBy("doc", "tag").agg(F.collect_list("pos").alias("marks"))
    ends = base.join(fringe, ["doc", "tag"]).select("doc", "tag", "text", "marks").mapInArrow(
        _ends(length), "h1 long, h2 long, doc long, at long, done boolean")
    repeated = ends.select(
        "doc", "at", (F.col("done") | (F.min("doc").over(Window.partitionBy("h1", "h2")) < F.col("doc"))).alias("cut"))
    runs = repeated.where("cut").select(
        *split_at, F.expr(f"shiftleft(cast({RUN} as bigint), {_KIND}) | (at & 4294967295)").alias("mark"))
    cuts = marks.where(f"kind = {FULL}").select("doc", "tag", code.alias("mark")).unionByName(runs)
    cuts = cuts.groupBy("doc", "tag").agg(F.collect_list("mark").alias("marks"))

    schema = f"{id_col} {id_type}, n_words long, n_removed long, kept_sha256 string"
    schema += ", kept string" if keep_text else ""
    names = [x.split()[0] for x in schema.split(", ")]
    done = base.join(cuts, ["doc", "tag"], "left").select("own", "text", "marks").mapInArrow(
        _cut(length, names, keep_text), schema)
    return done.unionByName(own.where("doc is null").select("own", "text").mapInArrow(
        _cut(length, names, keep_text), schema))
