"""Hard negatives from cover trees over norm-augmented candidates.

Candidates are dealt to blocks of equal label (and, in large tables, of equal
nearest pivot); crowded blocks are salted into parts of about ``BLOCK``. In a
block every vector x gets the further component sqrt(M^2 - |x|^2), M being the
block's largest norm, so that all lie on one sphere and inner products with an
anchor depend on angles only. A cover tree over them halves its covering
radius from level to level; a node's angle and radius bound the inner products
of everything below it from both sides.

Anchors come in batches. A batch descends a tree best first (the node of the
largest upper bound among the anchors still interested comes next). A node is
left out for an anchor when its bounds lie outside every window of scores that
the anchor still looks for, the lower end of a window rising to the worst hit
kept. Buckets that are reached are verified by exact integer products, so the
result is exact.

1. Positives: trees of the anchor's label, one window without ends, 5 hits.
2. Negatives: trees of other labels, a window for each positive, 3 hits each.

Trees are grouped to tasks of bounded size; every batch of anchors is sent to
each task and streams past its trees. Nothing is collected or broadcast except
a bounded set of pivots.

Defined results: rows of null label, null vector or with null or non-finite
components take no part; vectors of different lengths do not meet; a null id
takes part and comes after all others among equal scores, then the order of
rows in one scan decides; every row is a row of its own, also if it repeats an
id (as an anchor it is answered once for each time it stands there); scores
beyond 63 bits raise an error; other columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.grouping import whole_groups
from vigil.session import materialize

#: Candidates of a tree; of a bucket; least members of an own child.
BLOCK, LEAF, CHILD = 1024, 64, 8
#: One pivot for this many rows, MAX_PIVOTS at most.
PIVOT_ROWS, MAX_PIVOTS = 1 << 15, 256
#: Anchors of a batch.
BATCH = 1024
#: Bytes of trees a task holds, and least number of tasks (if there are trees).
TASK_BYTES, TASKS = 16 << 20, 64
#: Group counts that are broadcast; more are joined by shuffle.
MAX_BROADCAST_ROWS = 1 << 20
EXACT = float(1 << 53)
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

ROWS = ("tg long, kind int, dim int, keys binary, labels binary, ids array<long>, code string, data binary, extra binary")
_FIELDS = pa.schema([("tg", pa.int64()), ("kind", pa.int32()), ("dim", pa.int32()), ("keys", pa.binary()),
                     ("labels", pa.binary()), ("ids", pa.list_(pa.int64())), ("code", pa.string()),
                     ("data", pa.binary()), ("extra", pa.binary())])


# -- vectors --------------------------------------------------------------
def matrices(col: pa.Array):
    """(row numbers, integer-valued matrix) for each length of vector."""
    lens = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    flat = np.floor(256.0 * np.asarray(col.flatten().cast(pa.float64())))
    off = np.append(0, np.cumsum(lens))
    for dim in np.unique(lens).tolist():
        rows = np.flatnonzero(lens == dim)
        yield rows, flat[(off[rows][:, None] + np.arange(dim)).reshape(-1)].reshape(len(rows), dim)


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """Smallest type that holds the components, and their bytes."""
    top = np.abs(x).max(initial=0.0)
    code = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return code, x.astype(code).tobytes()


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers. Doubles are exact while the norms
    bound every partial sum by 2**53; beyond that Python integers are used."""
    if np.linalg.norm(q, axis=1).max(initial=0.0) * np.linalg.norm(x, axis=1).max(initial=0.0) < EXACT:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q], dtype=object)
    if any(not LOWEST < s <= HIGHEST for s in exact.flat):
        raise OverflowError("an inner product does not fit in 64 bits")
    return exact.astype(np.int64)


class Tree:
    """Cover tree of one block. Node k covers its own bucket of points and its
    children, all within the angle ``rho[k]`` of its centre."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, rho: np.ndarray, lo: np.ndarray, hi: np.ndarray, parent: np.ndarray):
        self.x, self.centre, self.rho, self.lo, self.hi = x, centre, rho, lo, hi
        self.radius = float(np.linalg.norm(x, axis=1).max(initial=0.0))
        self.children: list[list[int]] = [[] for _ in centre]
        for k, p in enumerate(parent.tolist()):
            if p >= 0:
                self.children[p].append(k)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each anchor with each node's
        points, widened by more than the rounding of angles."""
        reach = np.linalg.norm(q, axis=1) * self.radius
        cos = q @ self.x[self.centre].T / np.maximum(reach, 1e-300)[:, None]
        theta = np.arccos(np.clip(cos, -1.0, 1.0))
        slack = reach[:, None] * 1e-7 + 0.5
        return (reach[:, None] * np.cos(np.minimum(np.pi, theta + self.rho)) - slack,
                reach[:, None] * np.cos(np.maximum(0.0, theta - self.rho)) + slack)


def cover(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cover tree of the rows of ``x``: order of the points, and a row (centre
    in that order, angle, first and last point of the bucket, parent) a node."""
    sq = (x * x).sum(axis=1)
    top = max(float(sq.max()), 1e-300)
    aug = np.hstack([x, np.sqrt(np.maximum(0.0, top - sq))[:, None]])
    dist = np.sqrt(np.maximum(0.0, 2.0 * top - 2.0 * (aug @ aug.T)))
    order: list[int] = []
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, -1)]
    while todo:
        idx, centre, parent = todo.pop()
        near = dist[centre, idx]
        radius = float(near.max())
        own, node = idx, len(nodes)
        if len(idx) > LEAF and radius > 1e-6 * np.sqrt(top):
            # a net of half the radius: its points are the centres of the next level
            near, owner, net = near.copy(), np.zeros(len(idx), dtype=np.int64), [centre]
            while near[far := int(near.argmax())] > radius / 2:
                closer = dist[idx[far], idx] < near
                owner[closer], near[closer] = len(net), dist[idx[far], idx[closer]]
                net.append(int(idx[far]))
            large = np.bincount(owner, minlength=len(net)) >= CHILD
            own = idx[~large[owner]]
            todo += [(idx[owner == k], net[k], node) for k in np.flatnonzero(large).tolist()]
        nodes.append((centre, radius, len(order), len(order) + len(own), parent))
        order += own.tolist()
    at = np.empty(len(x))
    at[order] = np.arange(len(x))
    table = np.array(nodes, dtype=np.float64)
    table[:, 0] = at[table[:, 0].astype(np.int64)]
    # chord to angle; wide enough for the rounding of the distances
    table[:, 1] = 2.0 * np.arcsin(np.minimum(1.0, table[:, 1] / (2.0 * np.sqrt(top)))) + 1e-6
    return np.array(order), table


# -- search ---------------------------------------------------------------
class Best:
    """The ``k`` best hits of each slot (anchor, window): larger score first,
    then smaller id (null last), then earlier row."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, LOWEST)
        self.hits = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool), np.zeros(0, np.int64)]

    def add(self, slot, score, ids, null, key) -> None:
        slot, score, ids, null, key = (np.concatenate(x) for x in zip(self.hits, (slot, score, ids, null, key)))
        order = np.lexsort((key, ids, null, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[slot[full]] = score[order][full]
        self.hits = [slot[keep], *(x[order][keep] for x in (score, ids, null, key))]


def descend(tree: Tree, ids: np.ndarray, null: np.ndarray, keys: np.ndarray, q: np.ndarray, own: np.ndarray,
            who: np.ndarray, lo: np.ndarray, hi: np.ndarray, best: Best) -> None:
    """Best-first descent of the anchors ``who`` (rows of ``q``, ``own`` being
    their keys) with windows ``lo`` .. ``hi`` (anchors x windows)."""
    windows = lo.shape[1]
    least, most = tree.bounds(q[who])

    def open_(node: int, at: np.ndarray) -> np.ndarray:
        """Of the positions ``at`` in ``who``, those with an open window."""
        a = who[at]
        floor = np.maximum(lo[a], best.floor.reshape(-1, windows)[a])
        ok = ((most[at, node][:, None] >= floor) | (floor == LOWEST)) & (lo[a] <= hi[a])
        ok &= (least[at, node][:, None] <= hi[a]) | (hi[a] == HIGHEST)
        return at[ok.any(axis=1)]

    heap = [(0.0, 0, np.arange(len(who)))]
    while heap:
        _, node, at = heapq.heappop(heap)
        at = open_(node, at)
        if not len(at):
            continue
        a, b = int(tree.lo[node]), int(tree.hi[node])
        if b > a:
            anchors = who[at]
            score = products(q[anchors], tree.x[a:b])
            found: list[list[np.ndarray]] = [[], [], []]
            for w in range(windows):
                floor = np.maximum(lo[anchors, w], best.floor.reshape(-1, windows)[anchors, w])
                ok = (score >= floor[:, None]) & (score <= hi[anchors, w][:, None])
                ok &= own[anchors][:, None] != keys[a:b][None]
                if ok.sum() > 2 * best.k * len(at) and b - a > best.k:  # no more than the best of this bucket
                    cut = np.where(ok, score, LOWEST)
                    ok &= score >= np.partition(cut, b - a - best.k, axis=1)[:, b - a - best.k][:, None]
                i, j = np.nonzero(ok)
                for x, y in zip(found, (anchors[i] * windows + w, score[i, j], a + j)):
                    x.append(y)
            slot, value, point = (np.concatenate(x) for x in found)
            if len(slot):
                best.add(slot, value, ids[point], null[point], keys[point])
        for child in tree.children[node]:
            alive = open_(child, at)
            if len(alive):
                heapq.heappush(heap, (-float(most[alive, child].max()), child, alive))


def _search(same: bool, k: int):
    """Rows of ``ROWS`` sorted by (tg, kind), trees before anchors -> hits."""
    def matrix(row: dict) -> np.ndarray:
        return np.frombuffer(row["data"], dtype=row["code"]).astype(np.float64).reshape(len(row["keys"]) // 8, row["dim"])

    def trees(row: dict):
        x = matrix(row)
        nodes = np.frombuffer(row["extra"], dtype="<f8").reshape(-1, 5)
        ids = np.array([0 if i is None else i for i in row["ids"]], dtype=np.int64)
        null = np.array([i is None for i in row["ids"]], dtype=bool)
        whole = [nodes[:, c].astype(np.int64) for c in (0, 2, 3, 4)]
        return (Tree(x, whole[0], nodes[:, 1], *whole[1:]), row["dim"], int(np.frombuffer(row["labels"], "<i8")[0]),
                ids, null, np.frombuffer(row["keys"], "<i8"))

    def run(batches):
        held, group = [], None
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a tree or a batch of anchors
                row = batch.slice(i, 1).to_pylist()[0]
                if row["tg"] != group:
                    held, group = [], row["tg"]
                if row["kind"] == 0:
                    held.append(trees(row))
                    continue
                q = matrix(row)
                keys, labels = (np.frombuffer(row[c], "<i8") for c in ("keys", "labels"))
                ends = np.frombuffer(row["extra"], "<i8").reshape(len(keys), -1, 2)
                best = Best(len(keys) * ends.shape[1], k)
                for tree, dim, label, *points in held:
                    who = np.flatnonzero((labels == label) == same) if dim == row["dim"] else ()
                    if len(who):
                        descend(tree, *points, q, keys, who, ends[:, :, 0], ends[:, :, 1], best)
                slot, score, ids, null, key = best.hits
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[slot // ends.shape[1]]), pa.array((slot % ends.shape[1]).astype(np.int32)),
                    pa.array(ids, mask=null), pa.array(score), pa.array(key)], names=["anchor", "w", "id", "score", "key"])
    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _FIELDS)]
                                      if rows else [pa.array([], f.type) for f in _FIELDS], schema=_FIELDS)


def _build(batches):
    """(grp, key, id, label, vec) sorted by group -> a tree row for each."""
    for table, groups in whole_groups(batches, "grp"):
        for a, b in groups:
            part = table.slice(a, b - a)
            labels = part.column("label").to_numpy()
            for label in np.unique(labels):  # more than one only if hashes of groups collide
                own = part.filter(pa.array(labels == label)).combine_chunks()
                for rows, x in matrices(own.column("vec").combine_chunks()):
                    order, nodes = cover(x)
                    own_rows = own.take(pa.array(rows[order]))
                    yield _rows([(int(part.column("grp")[0].as_py()), 0, x.shape[1],
                                  own_rows.column("key").to_numpy().astype("<i8").tobytes(),
                                  np.array([label], "<i8").tobytes(), own_rows.column("id").to_pylist(),
                                  *packed(x[order]), nodes.astype("<f8").tobytes())])


def _pack(windows: int):
    """(key, label, vec, lo list, hi list) -> batches of anchors."""
    def run(batches):
        for batch in batches:
            keys, labels = (batch.column(c).to_numpy() for c in (0, 1))
            lo, hi = (np.array(batch.column(c).to_pylist(), dtype=np.int64).reshape(-1, windows) for c in (3, 4))
            ends = np.stack([lo, hi], axis=2)
            for rows, x in matrices(batch.column(2)):
                for i in range(0, len(rows), BATCH):
                    r = rows[i:i + BATCH]
                    yield _rows([(0, 1, x.shape[1], keys[r].astype("<i8").tobytes(), labels[r].astype("<i8").tobytes(),
                                  None, *packed(x[i:i + BATCH]), ends[r].astype("<i8").tobytes())])
    return run


def _nearest(pivots: np.ndarray):
    """Number of the nearest pivot; vectors of another length have none."""
    sq = (pivots * pivots).sum(axis=1)

    def run(batches):
        for batch in batches:
            cell = np.full(batch.num_rows, -1, dtype=np.int32)
            for rows, x in matrices(batch.column(3)):
                if x.shape[1] == pivots.shape[1]:
                    cell[rows] = (sq - 2.0 * (x @ pivots.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])
    return run


def place(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (key, id, label, vec) with the block ``grp`` of each."""
    pivots = min(MAX_PIVOTS, n // PIVOT_ROWS)
    if pivots > 1:  # a sample by hash, of MAX_PIVOTS vectors at most
        sample = [r["vec"] for r in rows.orderBy(F.xxhash64("key"), "key").limit(pivots).select("vec").collect()]
        dim = max({len(v) for v in sample}, key=lambda d: sum(len(v) == d for v in sample))
        points = np.floor(256.0 * np.array([v for v in sample if len(v) == dim]))
        rows = rows.mapInArrow(_nearest(points), "key long, id long, label long, vec array<double>, cell int")
    else:
        rows = rows.withColumn("cell", F.lit(0))
    names = ["label", "dim", "cell"]
    rows = rows.withColumn("dim", F.size("vec"))
    counts = rows.groupBy(*names).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    small = counts.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return rows.join(F.broadcast(counts) if small else counts, names).select(
        F.xxhash64(*names, F.pmod(F.xxhash64("key"), "parts")).alias("grp"), "key", "id", "label", "vec")


def search(trees: DataFrame, tasks: int, anchors: DataFrame, windows: int, same: bool, k: int) -> DataFrame:
    """Up to ``k`` hits per anchor and window: (anchor, w, id, score, key,
    rank). ``anchors``: key, label, vec, lo, hi (one element a window)."""
    batches = anchors.mapInArrow(_pack(windows), ROWS)
    names = [f.name for f in _FIELDS]
    sent = batches.withColumn("tg", F.explode(F.expr(f"sequence(0L, {tasks - 1}L)"))).select(*names)
    held = trees.withColumn("tg", F.pmod("tg", F.lit(tasks))).select(*names)
    hits = held.unionByName(sent).repartition(tasks, "tg").sortWithinPartitions("tg", "kind").mapInArrow(
        _search(same, k), "anchor long, w int, id long, score long, key long")
    best = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _divides(n: int, col: str) -> Column:
    return F.coalesce(F.col(col) % n == 0, F.lit(False))


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   anchor_step: int = 50, shift_step: int = 7, labels: int = 10, id_col: str = "vec_id",
                   vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score, for negatives with
    low * positive <= 100 * negative <= high * positive."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                         F.col(vec_col).cast("array<double>").alias("vec"))
    own = own.where("label is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) "
                    "and abs(x) < double('infinity'))")
    own = own.withColumn("label", F.when(_divides(shift_step, "id"), (F.col("label") + 1) % labels).otherwise(F.col("label")))
    # written once: the names of rows follow how the scan is cut
    rows = materialize(own.select(F.monotonically_increasing_id().alias("key"), "id", "label", "vec"), "negatives-rows")
    counts = rows.agg(F.count("*").alias("n"), F.sum(_divides(anchor_step, "id").cast("int")).alias("a")).first()
    trees = materialize(place(rows, counts["n"]).repartition("grp").sortWithinPartitions("grp").mapInArrow(_build, ROWS),
                        "negatives-trees")
    size = trees.agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes")).first()
    tasks = max(1, -(-(size["bytes"] or 0) // TASK_BYTES), min(TASKS, size["n"]))
    parts = max(1, -(-(counts["a"] or 0) // BATCH))

    anchors = rows.where(_divides(anchor_step, "id")).repartition(parts)
    no_end = anchors.select("key", "label", "vec", F.array(F.lit(int(LOWEST))).alias("lo"), F.array(F.lit(int(HIGHEST))).alias("hi"))
    near = materialize(search(trees, tasks, no_end, 1, True, positives).select(
        "anchor", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        "negatives-positives")

    # ends of the windows in whole numbers; a negative positive has none
    p = F.col("positive_score")
    ends = near.where(p >= 0).select("anchor", "w", F.expr(f"cast(ceil(cast({low} as decimal(20, 0)) * positive_score / 100) as long)").alias("lo"),
                                     F.expr(f"cast(floor(cast({high} as decimal(20, 0)) * positive_score / 100) as long)").alias("hi"))
    listed = ends.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("lo", "hi")))).alias("m"))
    each = F.sequence(F.lit(0), F.lit(positives - 1))
    ask = rows.where(_divides(anchor_step, "id")).join(listed.withColumnRenamed("anchor", "key"), "key").repartition(parts)
    ask = ask.select("key", "label", "vec",
                     F.transform(each, lambda i: F.coalesce(F.try_element_at("m", i)["lo"], F.lit(1))).alias("lo"),
                     F.transform(each, lambda i: F.coalesce(F.try_element_at("m", i)["hi"], F.lit(0))).alias("hi"))
    far = search(trees, tasks, ask, positives, False, negatives).select(
        "anchor", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = rows.where(_divides(anchor_step, "id")).select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id"))
    return far.join(near, ["anchor", "w"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
