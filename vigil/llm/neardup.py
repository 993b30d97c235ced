"""Embedding near-duplicates by NN-descent.

Vectors are only compared under equal labels. Equal vectors are one class with
a multiplicity.

1. Start: several tables of sign projections, more of them with more bits. Sorted by label, sign pattern
   and one more projection, every vector meets its next neighbours; the sort is
   by range, so a crowded pattern is spread over tasks. Vectors go there in
   16-bit steps, which only rank neighbours; links come from the descent.
2. Descent: every vector keeps its ``K`` best neighbours. In a round each
   vector brings its neighbours together (neighbours of neighbours), their
   cosines are taken, and lists keep the best. ``ROUNDS`` rounds are followed
   by the audit, and by as many again while it is below ``RECALL``.
3. Audit: of every label about ``AUDIT`` vectors, and about as many of those
   that have a link, are compared with all vectors of the label; the share of
   their links whose ends are in one component is the label's recall. It only
   says when the descent may end.
4. Check: lists are short and miss links, so all pairs of a label whose ends are
   in different components are compared, in blocks. A pair is first bounded by
   some rotated coordinates and the lengths of the rests (Cauchy-Schwarz); where
   the bound reaches the threshold, the cosine is taken. Of the components that
   the links of a block join, a block gives one pair a join. The check is
   quadratic in the vectors of a label; the memory of a task is not.
5. Saturated lists: where a component has more members than a list holds, the
   lists of its members are enlarged to the component, which is compared with
   itself in blocks. Counts leave a block, never pairs.

Only links of ``threshold`` and more are kept; all cosines are of doubles.

Defined results: a vector that is null, empty, zero or holds null or
non-finite components, or whose label is null, links with nothing; vectors of
different lengths do not link; every row is a vector, also if it repeats an
id; component_id is the smallest non-null vec_id of the component; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.components import components
from vigil.llm.grouping import whole_groups
from vigil.session import materialize

K = 8
#: Tables, at least and at most, and the share of pairs at the threshold that may have no pattern in common.
TABLES, MOST_TABLES, APART = 16, 1 << 10, 3e-4
#: Vectors per sign pattern aimed at, and neighbours met in the sorted order.
PER_PATTERN, AHEAD = 4, 4
ROUNDS, MAX_ROUNDS = 2, 6
#: Steps of a component between 0 and 1 where neighbours are only ranked.
STEP = 32767.0
#: Vectors met with a smaller cosine are no neighbours: they lead to no link.
LEAST = 0.7
#: Vectors of a label that are audited: so many on average, and as many of those with a link.
AUDIT = 256
RECALL = 0.999
BLOCK = 1024
#: Numbers in a block of the check, its cosines at a time, and the error allowed to single precision.
CHECK, AT_ONCE, ERR = 1 << 21, 1 << 22, 1e-4


def _matrix(col: pa.Array) -> list[np.ndarray] | np.ndarray:
    """Rows of a list<double> column of one length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros((0, 0))
    return np.asarray(col.flatten()).reshape(len(col), -1)


def _clean(batches):
    """(vec_id, label, embedding) -> unit vectors of doubles, null if the
    vector cannot link."""
    for batch in batches:
        col = batch.column(2)
        lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
        off = np.append(0, np.cumsum(lens))
        ok = np.zeros(len(lens), dtype=bool)
        for dim in np.unique(lens[lens > 0]).tolist():
            at = np.flatnonzero(lens == dim)
            place = off[at][:, None] + np.arange(dim)
            x = flat[place]
            ok[at] = np.isfinite(x).all(axis=1) & x.any(axis=1)
            at, place, x = at[ok[at]], place[ok[at]], x[ok[at]]
            x = x / np.abs(x).max(axis=1, initial=0.0)[:, None]  # no overflow of the squares
            flat[place] = x / np.sqrt((x * x).sum(axis=1))[:, None]
        ok &= batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        kept = np.append(0, np.cumsum(np.where(ok, lens, 0)))
        units = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(flat[np.repeat(ok, lens)]),
                                         mask=pa.array(~ok))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), units], names=["vec_id", "label", "unit"])


def tables(bits: int, threshold: float) -> int:
    """Tables of so many bits after which a pair at the threshold has had no
    pattern in common with a probability of APART."""
    met = (1.0 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return TABLES if met >= 1.0 else max(TABLES, min(MOST_TABLES, math.ceil(math.log(APART) / math.log1p(-met))))


def _planes(dim: int, bits: int, n: int) -> np.ndarray:
    return np.random.default_rng(dim * 1000 + bits).standard_normal((n, bits + 1, dim))


def _patterns(batches, threshold: float):
    """(cid, space, unit, bits) -> one row a table: (space, pattern, place, cid,
    the vector in 16-bit steps)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            dims = np.diff(np.asarray(part.column(2).offsets))
            bits = part.column(3).to_numpy()
            for dim, b in sorted(set(zip(dims.tolist(), bits.tolist()))):
                own = part.filter(pa.array((dims == dim) & (bits == b)))
                x = _matrix(own.column(2))
                coarse = np.rint(x * STEP).astype("<i2")
                coarse = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * dim), len(x), [None, pa.py_buffer(coarse.tobytes())])
                coarse = coarse.cast(pa.binary())
                for t, plane in enumerate(_planes(dim, b, tables(b, threshold))):
                    p = x @ plane.T
                    pattern = ((p[:, :b] > 0) @ (1 << np.arange(b, dtype=np.int64))) if b else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [own.column(1), pa.array(pattern * MOST_TABLES + t), pa.array(p[:, b]), own.column(0), coarse],
                        names=["space", "pattern", "place", "cid", "coarse"])


def _meet(batches):
    """Sorted rows -> (u, v, cos) of rows next to each other in a pattern; the
    cosine is that of the 16-bit steps and only ranks neighbours."""
    tail: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        table = new if tail is None else pa.concat_tables([tail, new])
        old = 0 if tail is None else tail.num_rows
        space, pattern = table.column("space").to_numpy(), table.column("pattern").to_numpy()
        cid = table.column("cid").to_numpy()
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        us, vs, cs = [], [], []
        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(space)]):
            raw = b"".join(table.column("coarse").slice(a, b - a).to_pylist())
            x = np.frombuffer(raw, "<i2").reshape(b - a, -1).astype(np.float32) / np.float32(STEP)
            for d in range(1, AHEAD + 1):
                if b - a <= d:
                    break
                i = np.arange(max(0, old - a - d), b - a - d)
                i = i[(pattern[a + i] == pattern[a + i + d]) & (cid[a + i] != cid[a + i + d])]
                cos = np.einsum("ij,ij->i", x[i], x[i + d]).astype(np.float64)
                i, cos = i[cos >= LEAST], cos[cos >= LEAST]
                us.append(cid[a + i])
                vs.append(cid[a + i + d])
                cs.append(cos)
        if us:
            yield _pairs(np.concatenate(us), np.concatenate(vs), np.concatenate(cs))
        tail = table.slice(max(0, table.num_rows - AHEAD))


def _pairs(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(c)], names=["u", "v", "cos"])


def _local_join(threshold: float):
    """Neighbours (mid, cid, unit) sorted by mid -> their links, and the best
    partner of each."""
    def run(batches):
        for rows, groups in whole_groups(batches, "mid"):
            cid, units = rows.column("cid").to_numpy(), rows.column("unit").combine_chunks()
            us, vs, cs = [], [], []
            for a, b in groups:
                if b - a < 2:
                    continue
                x = _matrix(units.slice(a, b - a))
                s = x @ x.T
                np.fill_diagonal(s, -2)
                best = s.argmax(axis=1)
                keep = np.triu(s >= threshold)
                keep[np.arange(b - a), best] = True
                i, j = np.nonzero(keep)
                us.append(cid[a + i])
                vs.append(cid[a + j])
                cs.append(s[i, j])
            if us:
                yield _pairs(np.concatenate(us), np.concatenate(vs), np.concatenate(cs))
    return run


def _best(pairs: DataFrame) -> DataFrame:
    """The K best neighbours of every vector, both directions."""
    both = pairs.select("u", "v", "cos").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos"))
    both = both.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), "v"))
    return both.withColumn("r", rank).where(F.col("r") <= K).drop("r")


def _check(threshold: float):
    """Blocks (tile, space, cid, comp, side, unit) sorted by tile -> the links
    of side 0 with side 1 and those within components (space, n, k)."""
    def run(batches):
        for rows, groups in whole_groups(batches, "tile"):
            space, cid, comp, side = (rows.column(k).to_numpy() for k in ("space", "cid", "comp", "side"))
            units = rows.column("unit").combine_chunks()
            for a, b in groups:
                x = _matrix(units.slice(a, b - a))
                l, r = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
                i, j = np.nonzero(x[l] @ x[r].T >= threshold)
                i, j = a + l[i], a + r[j]
                i, j = i[cid[i] != cid[j]], j[cid[i] != cid[j]]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()) for k in (
                    space[a], len(i), int((comp[i] == comp[j]).sum()))], names=["space", "n", "k"])
    return run


def _compare(queries: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """All ``queries`` against the ``vectors`` of their space, both (cid,
    space, unit, comp), in blocks: see ``_check``."""
    blocks = lambda t, name: t.groupBy("space").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cut = blocks(queries, "ql").join(blocks(vectors, "vl"), "space")

    def dealt(t: DataFrame, own: str, other: str, side: int) -> DataFrame:
        at = {own: F.expr(f"cast(pmod(xxhash64(cid), {own}) as int)"), other: F.explode(F.expr(f"sequence(0, {other} - 1)"))}
        return t.join(cut, "space").select("space", "cid", "comp", "unit", F.lit(side).alias("side"),
                                           *[at[k].alias(f"at_{k}") for k in (own, other)])
    rows = dealt(queries, "ql", "vl", 0).unionByName(dealt(vectors, "vl", "ql", 1)).select(
        F.xxhash64("space", "at_ql", "at_vl").alias("tile"), "space", "cid", "comp", "side", "unit")
    return materialize(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(
        _check(threshold), "space long, n long, k long"), "neardup-audit")


def _bound(x: np.ndarray) -> np.ndarray:
    """A quarter of the rotated coordinates and the length of the rest: the
    products of two rows are no less than the cosine."""
    dim = x.shape[1]
    turn = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, min(dim, max(15, dim // 4)))))[0]
    p = x @ turn
    rest = np.sqrt(np.maximum((x * x).sum(axis=1) - (p * p).sum(axis=1), 0.0))
    return np.concatenate([p, rest[:, None]], axis=1).astype(np.float32)


def _joins(x: np.ndarray, y: np.ndarray, xc: np.ndarray, yc: np.ndarray, threshold: float):
    """Pairs of components, ``xc`` of the vectors ``x`` and ``yc`` of ``y``,
    that links join; one pair a join."""
    names, at = np.unique(np.concatenate([xc, yc]), return_inverse=True)
    xc, yc = at[:len(xc)].copy(), at[len(xc):].copy()
    bx, by, some = _bound(x), _bound(y), max(1, AT_ONCE // x.shape[1])
    for a in range(0, len(x), max(1, AT_ONCE // len(y))):
        own = xc[a:a + max(1, AT_ONCE // len(y))]
        i, j = np.nonzero((bx[a:a + len(own)] @ by.T >= threshold - ERR) & (own[:, None] != yc))
        for k in range(0, len(i), some):
            u, v = a + i[k:k + some], j[k:k + some]
            open_ = xc[u] != yc[v]
            u, v = u[open_], v[open_]
            link = np.einsum("ij,ij->i", x[u], y[v]) >= threshold
            for p, q in zip(u[link].tolist(), v[link].tolist()):
                c, d = xc[p], yc[q]
                if c != d:
                    yield names[c], names[d]
                    xc[xc == d], yc[yc == d] = c, c


def _across(threshold: float):
    """Blocks (tile, cid, comp, side, unit) sorted by tile -> the pairs of
    components that their links join (u, v)."""
    def run(batches):
        for rows, groups in whole_groups(batches, "tile"):
            comp, side = rows.column("comp").to_numpy(), rows.column("side").to_numpy()
            units = rows.column("unit").combine_chunks()
            for a, b in groups:
                x, c, s = _matrix(units.slice(a, b - a)), comp[a:b], side[a:b]
                ends = [(x, c)] * 2 if (s < 0).all() else [(x[s == k], c[s == k]) for k in (0, 1)]
                if not all(len(e[0]) for e in ends):
                    continue
                pairs = list(_joins(ends[0][0], ends[1][0], ends[0][1], ends[1][1], threshold))
                if pairs:
                    u, v = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    return run


def _tiles(vectors: DataFrame, group: str, blocks: Column) -> DataFrame:
    """The vectors of every ``group`` in ``blocks`` blocks (an aggregate), a
    copy a pair of blocks: ``tile``, and ``side`` -1 (a block with itself), 0 or 1."""
    cut = vectors.groupBy(group).agg(blocks.cast("int").alias("blocks"))
    spread = vectors.join(cut, group).withColumn("mine", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
    spread = spread.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return spread.withColumn("tile", F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other"))).withColumn(
        "side", F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1))


def _audited(placed: DataFrame, met: DataFrame) -> DataFrame:
    """Of every space about AUDIT vectors, and about AUDIT of those that have
    a link (``met``), by hash."""
    found = placed.join(met.withColumn("met", F.lit(1)), "cid", "left").withColumn("met", F.coalesce("met", F.lit(0)))
    share = found.groupBy("space").agg((AUDIT / F.count("*")).alias("all"), (AUDIT / F.greatest(F.sum("met"), F.lit(1))).alias("some"))
    draw = F.pmod(F.xxhash64("cid", F.lit("audit")), F.lit(1 << 30)) / float(1 << 30)
    return found.join(share, "space").where((draw < F.col("all")) | ((F.col("met") == 1) & (draw < F.col("some")))).select(*placed.columns)


def _count(threshold: float):
    """Blocks of components (tile, cid, mult, side, unit) sorted by tile ->
    (cid, linked vectors in the block)."""
    def run(batches):
        for rows, groups in whole_groups(batches, "tile"):
            cid, mult, side = (rows.column(k).to_numpy() for k in ("cid", "mult", "side"))
            units = rows.column("unit").combine_chunks()
            ids, ns = [], []
            for a, b in groups:
                x, m, s = _matrix(units.slice(a, b - a)), mult[a:b], side[a:b]
                if (s < 0).all():
                    link = x @ x.T >= threshold
                    np.fill_diagonal(link, False)
                    ids.append(cid[a:b])
                    ns.append(link @ m)
                else:
                    l, r = np.flatnonzero(s == 0), np.flatnonzero(s == 1)
                    link = x[l] @ x[r].T >= threshold
                    ids += [cid[a:b][l], cid[a:b][r]]
                    ns += [link @ m[r], m[l] @ link]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(ns).astype(np.int64))],
                                             names=["cid", "n"])
    return run


def near_duplicates(table: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """Per vector: ``id_col`` (an integer), n_links, component_id, kept."""
    spark = table.sparkSession
    id_type = table.schema[id_col].dataType.simpleString()
    label_type = table.schema[label_col].dataType.simpleString()
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                        F.col(vec_col).cast("array<double>").alias("embedding")).mapInArrow(
        _clean, f"vec_id long, label {label_type}, unit array<double>")
    rows = materialize(rows.withColumn("space", F.when(F.col("unit").isNotNull(), F.xxhash64("label", F.size("unit")))
                                       ).withColumn("cid", F.when(F.col("unit").isNotNull(), F.xxhash64("space", "unit"))),
                       "neardup-rows").drop("label")
    nodes = materialize(rows.where("cid is not null").groupBy("cid").agg(
        F.first("space").alias("space"), F.first("unit").alias("unit"), F.count("*").alias("mult")), "neardup-nodes")

    # one row a label: patterns get as many bits as the label's vectors call for
    sizes = nodes.groupBy("space").agg(F.greatest(F.lit(0), F.least(F.lit(40), F.floor(
        F.log2(F.count("*") / PER_PATTERN)))).cast("int").alias("bits"))
    met = nodes.join(sizes, "space").select("cid", "space", "unit", "bits").mapInArrow(
        lambda batches: _patterns(batches, threshold), "space long, pattern long, place double, cid long, coarse binary")
    met = met.repartitionByRange("space", "pattern", "place").sortWithinPartitions("space", "pattern", "place").mapInArrow(
        _meet, "u long, v long, cos double")
    graph = materialize(_best(met), "neardup-graph")

    units = nodes.select(F.col("cid"), "unit")
    linked = lambda g: g.where(F.col("cos") >= threshold).select("u", "v")
    links = spark.createDataFrame([], "u long, v long")  # cosines of the start are coarse
    for done in range(0, MAX_ROUNDS, ROUNDS):
        for _ in range(ROUNDS):
            lists = graph.select(F.col("u").alias("mid"), F.col("v").alias("cid")).unionByName(
                graph.select(F.col("u").alias("mid"), F.col("u").alias("cid")).distinct())
            pairs = materialize(lists.join(units, "cid").repartition("mid").sortWithinPartitions("mid").select(
                "mid", "cid", "unit").mapInArrow(_local_join(threshold), "u long, v long, cos double"), "neardup-pairs")
            links = links.unionByName(linked(pairs))
            graph = materialize(_best(graph.unionByName(pairs)), "neardup-graph")
        comps = components(links)
        placed = materialize(nodes.join(comps.toDF("cid", "comp"), "cid", "left").select(
            "cid", "space", "unit", F.coalesce("comp", "cid").alias("comp")), "neardup-placed")
        audit = _compare(_audited(placed, comps.select(F.col(comps.columns[0]).alias("cid"))), placed, threshold)
        below = materialize(audit.groupBy("space").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(
            F.col("k") < RECALL * F.col("n")).select("space"), "neardup-below")
        if below.limit(1).count() == 0:
            break
    tiles = _tiles(placed, "space", F.ceil(F.count("*") * F.max(F.size("unit")) / CHECK)).select("tile", "comp", "side", "unit")
    lost = materialize(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(
        _across(threshold), "u long, v long"), "neardup-lost")
    if lost.limit(1).count():
        comps = components(links.unionByName(lost))
    comps = materialize(comps.toDF("cid", "comp").join(nodes, "cid"), "neardup-members")

    spread = _tiles(comps, "comp", F.ceil(F.count("*") / BLOCK)).select("tile", "cid", "mult", "side", "unit")
    counts = spread.repartition("tile").sortWithinPartitions("tile").mapInArrow(
        _count(threshold), "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))

    label = rows.select("vec_id", "cid").join(nodes.select("cid", "mult"), "cid", "left").join(
        comps.select("cid", "comp"), "cid", "left").join(counts, "cid", "left")
    label = label.withColumn("comp", F.coalesce("comp", "cid"))
    least = label.where("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("least"))
    out = label.join(least, "comp", "left").withColumn(
        "c", F.when(F.col("comp").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return out.select(F.col("vec_id").cast(id_type).alias(id_col),
                      F.coalesce(F.col("n") + F.col("mult") - 1, F.col("mult") - 1, F.lit(0)).cast("long").alias("n_links"),
                      F.col("c").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("c")).alias("kept"))
