"""N-gram Jaccard join with count vectors.

Shingles are hashed into groups and a set is the point of its group counts:
the overlap of two sets is at most the sum of their coordinate minima, and of
two tree nodes at most that of their upper corners.

1. Equal sets are one class, identified by a 64-bit sum hash.
2. Tiles. Two linked sets differ in at most T(size) shingles. Hashed into
   m > T groups they agree on whole groups, so sets meet in tiles keyed by
   (size band, group, contents). Groups with few shingles are left out unless a
   set has so many of them that all agreeing groups could be such; the rule is
   the same for both partners, so no linked pair is missed.
3. Each tile has a lead; every class is compared with the lead that it shares
   most tiles with. The first leads are the classes in most tiles (the middle of
   a family of near copies), later rounds draw others at random. Links make
   components, and tiles within one component are closed.
4. In tiles that still hold several components, a packed R-tree over the points
   finds which components have members whose bound allows a link.
5. Those components (large ones in units of bounded size) are verified on the
   whole shingle sets until a link is found. Sets are sent to groups of
   components, not to pairs; a group's shingles are bounded.

A round writes one pair a class. After the rounds most families are one
component each, and within a component no pair is formed, so a group of copies
costs as much as its members. Large tiles are compared in blocks.

Defined results: null, empty and blank texts have an empty set and link with
nothing (each is its own component); rows with equal sets link whatever their
id; a component's id is its smallest non-null doc_id (null if it has none);
repeated rows keep their multiplicity; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textops as T
from vigil.llm.components import components
from vigil.llm.grouping import whole_groups
from vigil.session import materialize

#: Coordinates of the points; counts of FULL and more are written behind them.
GROUPS, FULL = 256, 255
#: Members of a tile compared in one block; of a leaf of the tree.
BLOCK, LEAF = 2048, 16
#: Members of a unit (a component or a part of a large one).
UNIT = 1024
#: Shingles of the units next to one centre that are verified in one group.
GROUP_SHINGLES = 1 << 22
#: Most rounds of comparing every class with one lead; a round in which most
#: of them link is the last.
ROUNDS = 4
#: Unit pairs a task holds to write each of them once.
HELD = 1 << 20
#: Rows (set, group) of sets to fetch that are broadcast; more are joined by shuffle.
MAX_BROADCAST_ROWS = 1 << 20


class Join:
    """The thresholds of one join: overlap * 100 >= percent * union."""

    def __init__(self, width: int, percent: int):
        self.width, self.percent = width, percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(edges[-1] * 100 // percent + 1)
        self.edges = np.array(edges)

    def needed(self, a, b):
        """Least overlap that links sets of the sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    @lru_cache(maxsize=512)
    def tiles(self, band: int) -> tuple[int, int, int]:
        """T, number of groups and least shingles of a full group, for pairs
        whose smaller set is in ``band``."""
        low, high = int(self.edges[band]), int(self.edges[band + 1]) - 1
        most = (100 - self.percent) * (high + high * 100 // self.percent) // (100 + self.percent)
        least = max(1, min(3, low // 15))
        m = most + 1
        while m < 4 * most + 20:
            load = low / m
            p = sum(math.exp(-load) * load ** k / math.factorial(k) for k in range(least))
            if m - most > m * p + 3 * math.sqrt(m * p * (1 - p)):
                break
            m += 1
        else:
            m = most + 1 + max(2, most // 3)
        return most, m, least

    def keys(self, v: np.ndarray) -> np.ndarray:
        """Tile keys of a set of shingle hashes."""
        out = []
        band = int(np.searchsorted(self.edges, len(v), side="right")) - 1
        spread = T.mix(v) >> np.uint64(32)
        salt = T.mix(v + np.uint64(0x2545F491))
        for b in (band, band - 1):  # as the smaller and as the larger set of a pair
            if b < 0:
                continue
            most, m, least = self.tiles(b)
            if most < 1:  # only equal sets link, and those are one class
                continue
            group = (spread * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(group, minlength=m)
            content = np.zeros(m, dtype=np.uint64)
            np.add.at(content, group, salt)
            use = np.flatnonzero(count >= least)
            if m - len(use) >= m - most:
                use = np.arange(m)
            out.append(T.mix(content[use] + T.mix(np.uint64(b << 40) + use.astype(np.uint64))))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_sets(part: T.Slice, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    w = T.Words(part, "space")
    sums = T.prefix(w.hashes(lower=True))
    g = T.grams(sums, width)
    out = []
    for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(g[a:b - width + 1]))
        else:
            out.append(T.ranges(sums, np.array([a]), np.array([b])) if b > a else g[:0])
    return out


def set_id(v: np.ndarray) -> int:
    return int(T.mix(np.array([T.mix(v).sum(dtype=np.uint64) + np.uint64(len(v))])).view(np.int64)[0])


def point(v: np.ndarray) -> bytes:
    """Size and group counts of a set: a byte a group, then 32 bits for each
    group whose byte is FULL."""
    group = (T.mix(v ^ np.uint64(0x5BF03635)) % np.uint64(GROUPS)).astype(np.int64)
    counts = np.bincount(group, minlength=GROUPS)
    low = np.minimum(counts, FULL).astype(np.uint8)
    return len(v).to_bytes(8, "little") + low.tobytes() + counts[low == FULL].astype("<u4").tobytes()


def _points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and group counts."""
    data, width = col.to_pylist(), GROUPS + 8
    raw = np.frombuffer(b"".join(x[:width] for x in data), dtype=np.uint8).reshape(len(data), width)
    size = np.ascontiguousarray(raw[:, :8]).view("<i8")[:, 0]
    more = np.frombuffer(b"".join(x[width:] for x in data), dtype="<u4")
    counts = raw[:, 8:].astype(np.int64 if len(more) else np.int16)
    counts[counts == FULL] = more
    return size, counts


def _describe(width: int):
    def run(batches):
        for batch in batches:
            for part in T.slices(batch.column(1)):
                sets = shingle_sets(part, width)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, len(part)), batch.column(2).slice(part.first, len(part)),
                    batch.column(3).slice(part.first, len(part)), pa.array([len(v) for v in sets], pa.int64()),
                    pa.array([set_id(v) if len(v) else None for v in sets], pa.int64()),
                    pa.array([point(v) for v in sets], pa.binary())], names=["doc", "rid", "row", "n", "sid", "point"])
    return run


def _tile_keys(join: Join):
    def run(batches):
        for batch in batches:
            seen: set[int] = set()
            for part in T.slices(batch.column(0)):
                keys, sids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for v in shingle_sets(part, join.width):
                    if len(v) and (sid := set_id(v)) not in seen:  # copies in a batch go once
                        seen.add(sid)
                        keys.append(join.keys(v))
                        sids.append(np.full(len(keys[-1]), sid))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)),
                                                  pa.array(np.concatenate(sids))], names=["key", "sid"])
    return run


def _crowded(batches):
    """Rows sorted by (key, sid) -> each pair once, of keys with several sets.
    Only one row is held at a time, however many share a key."""
    held = None  # the last row so far: its key, set and whether it was given out
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sid = (batch.column(k).to_numpy() for k in (0, 1))
        if held is not None:
            key, sid = np.append(held[0], key), np.append(held[1], sid)
        new = np.append(True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]))
        key, sid = key[new], sid[new]
        same = key[1:] == key[:-1]
        crowd = np.append(False, same) | np.append(same, False)
        if held is not None:
            crowd[0] &= not held[2]
        last = bool(crowd[-1]) or (held is not None and held[2] and len(key) == 1)
        out = np.flatnonzero(crowd)
        held = (key[-1], sid[-1], last)
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(sid[out])], names=["key", "sid"])


def _bounded(join: Join):
    """Pairs whose summed coordinate minima allow a link."""
    def run(batches):
        for batch in batches:
            (m, a), (n, b) = (_points(batch.column(k)) for k in (2, 3))
            keep = np.minimum(a, b).sum(axis=1, dtype=np.int64) >= join.needed(m, n)
            yield batch.select([0, 1]).filter(pa.array(keep))
    return run


class Tree:
    """Packed R-tree over points: leaves of LEAF points next to each other in
    size and in their leading coordinates, inner nodes of LEAF nodes. Level 0
    are the leaves; a level holds the upper corner, the least and largest size
    of each node and where its children begin."""

    def __init__(self, size: np.ndarray, points: np.ndarray):
        self.order = np.lexsort((*points.T[:4], size))
        self.size, self.points = size[self.order], points[self.order]
        self.levels: list[tuple] = []
        upper, least, most = self.points, self.size, self.size
        while not self.levels or len(upper) > 1:
            at = np.arange(0, len(upper), LEAF)
            upper, least, most = np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((upper, least, most, np.append(at, len(self.levels[-1][0]) if self.levels else len(size))))

    def level(self, k: int) -> tuple:
        """Level ``k``; above the root, the root as its own parent."""
        if k < len(self.levels):
            return self.levels[k]
        upper, least, most, _ = self.levels[-1]
        return upper, least, most, np.array([0, 1])

    def pairs(self, other: Tree, join: Join):
        """(rows of self, rows of other) of leaf pairs that may hold links, by
        descending both trees at once."""
        top = max(len(self.levels), len(other.levels)) - 1
        i = j = np.zeros(1, dtype=np.int64)
        for k in range(top, -1, -1):
            one, two = self.level(k), other.level(k)
            ok = np.zeros(len(i), dtype=bool)
            for a in range(0, len(i), 4096):
                p, q = i[a:a + 4096], j[a:a + 4096]
                bound = np.minimum(one[0][p], two[0][q]).sum(axis=1, dtype=np.int64)
                fits = bound >= join.needed(one[1][p], two[1][q])
                fits &= (one[2][p] * 100 >= join.percent * two[1][q]) & (two[2][q] * 100 >= join.percent * one[1][p])
                ok[a:a + 4096] = fits
            i, j = i[ok], j[ok]
            if k:  # children of both; within one tree each pair of nodes once
                m, n = one[3][i + 1] - one[3][i], two[3][j + 1] - two[3][j]
                at = np.repeat(np.arange(len(i)), m * n)
                place = np.arange(len(at)) - np.repeat(np.cumsum(m * n) - m * n, m * n)
                i, j = one[3][i][at] + place // n[at], two[3][j][at] + place % n[at]
                if other is self:
                    i, j = i[j >= i], j[j >= i]
        for p, q in zip(i.tolist(), j.tolist()):
            yield slice(self.levels[0][3][p], self.levels[0][3][p + 1]), slice(other.levels[0][3][q], other.levels[0][3][q + 1])


def tile_pairs(join: Join, comp: np.ndarray, unit: np.ndarray, size: np.ndarray, points: np.ndarray,
               side: np.ndarray | None) -> set[tuple[int, int]]:
    """Unit pairs of one tile (or of the two blocks of it that ``side`` names)
    in different components with members whose bound allows a link."""
    left = np.arange(len(unit)) if side is None else np.flatnonzero(side == 0)
    right = left if side is None else np.flatnonzero(side == 1)
    out: set[tuple[int, int]] = set()
    if len(left) and len(right):
        one = Tree(size[left], points[left])
        two = one if side is None else Tree(size[right], points[right])
        l, r = left[one.order], right[two.order]
        for a, b in one.pairs(two, join):
            ok = comp[l[a]][:, None] != comp[r[b]][None]
            if not ok.any():
                continue
            over = np.minimum(one.points[a][:, None], two.points[b][None]).sum(axis=2, dtype=np.int64)
            ok &= over >= join.needed(one.size[a][:, None], two.size[b][None])
            i, j = np.nonzero(ok)
            out.update(zip(unit[l[a][i]].tolist(), unit[r[b][j]].tolist()))
    return {(min(x), max(x)) for x in out}


def _tile_join(join: Join):
    """Rows (tile, comp, unit, side, point) sorted by tile -> unit pairs."""
    def batch(pairs):
        rows = sorted(pairs)
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], pa.int64()) for n in (0, 1)], names=["a", "b"])

    def run(batches):
        held: set[tuple[int, int]] = set()
        for rows, groups in whole_groups(batches, "tile"):
            comp, unit = rows.column("comp").to_numpy(), rows.column("unit").to_numpy()
            side = rows.column("side").to_numpy()
            points = rows.column("point").combine_chunks()
            for a, b in groups:
                s = side[a:b]
                held |= tile_pairs(join, comp[a:b], unit[a:b], *_points(points.slice(a, b - a)),
                                   None if (s < 0).all() else s)
            if len(held) > HELD:
                yield batch(held)
                held = set()
        yield batch(held)
    return run


def _verify(join: Join):
    """Sorted by group: rows (grp, a, null, unit, shingles) are sets of a
    unit, rows (grp, a, b, null, null) pairs of units -> one linked pair of
    sets for each pair of units that has any."""
    def linked(u: np.ndarray, v: np.ndarray) -> bool:
        if len(u) > len(v):
            u, v = v, u
        over = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
        return 100 * over >= join.percent * (len(u) + len(v) - over)

    def run(batches):
        for rows, groups in whole_groups(batches, "grp"):
            left, right, units, data = (rows.column(k).to_pylist() for k in ("a", "b", "unit", "shingles"))
            links = []
            for i, j in groups:
                members: dict[int, list[int]] = {}
                sets: dict[int, np.ndarray] = {}
                for k in range(i, j):
                    if right[k] is None and left[k] not in sets:
                        sets[left[k]] = np.frombuffer(data[k], dtype=np.uint64)
                        members.setdefault(units[k], []).append(left[k])
                own = {u: (ids, *_points(pa.array([point(sets[x]) for x in ids]))) for u, ids in members.items()}
                for k in range(i, j):
                    if right[k] is not None:
                        (xs, m, p), (ys, n, q) = own[left[k]], own[right[k]]
                        for x, size, at in zip(xs, m, p):
                            near = np.minimum(at, q).sum(axis=1, dtype=np.int64) >= join.needed(size, n)
                            link = next((ys[t] for t in np.flatnonzero(near) if linked(sets[x], sets[ys[t]])), None)
                            if link is not None:
                                links.append((x, link))
                                break
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in links], pa.int64()) for n in (0, 1)], names=["a", "b"])
    return run


def _fetch(width: int):
    """(wanted set, its unit and groups, text) -> one row a group with the
    set, where the text is that set."""
    def run(batches):
        for batch in batches:
            wanted, units, groups = (batch.column(k).to_pylist() for k in range(3))
            for part in T.slices(batch.column(3)):
                cols: tuple[list, list, list, list] = ([], [], [], [])
                for i, v in enumerate(shingle_sets(part, width)):
                    if len(v) and set_id(v) == wanted[part.first + i]:
                        for g in groups[part.first + i]:
                            for c, x in zip(cols, (g, wanted[part.first + i], units[part.first + i], v.tobytes())):
                                c.append(x)
                yield pa.RecordBatch.from_arrays([
                    pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.nulls(len(cols[0]), pa.int64()),
                    pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())],
                    names=["grp", "a", "b", "unit", "shingles"])
    return run


def join(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
         row_col: str | None = None) -> DataFrame:
    """Per document: ``id_col`` (an integer), n_shingles, component_id and, if
    ``row_col`` is given, this long column (as ``row``) and ``comp``, the
    component itself (ids may repeat; null for an empty set)."""
    rule, spark = Join(width, percent), docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"),
                      F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("rid"),
                      (F.lit(0) if row_col is None else F.col(row_col)).cast("long").alias("row"))
    light = materialize(own.select("doc", "text", "rid", "row").mapInArrow(
        _describe(width), "doc long, rid long, row long, n long, sid long, point binary"), "jaccard-light")
    classes = light.where("sid is not null").groupBy("sid").agg(
        F.min("rid").alias("rid"), F.first("point").alias("point"), F.first("n").alias("n"))
    keyed = own.select("text").mapInArrow(_tile_keys(rule), "key long, sid long")
    tiles = materialize(keyed.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(
        _crowded, "key long, sid long"), "jaccard-tiles")
    points = classes.select("sid", "point")

    def verified(pairs: DataFrame, members: DataFrame, name: str) -> DataFrame:
        """Links between the units of ``pairs`` (a, b); ``members`` are their
        sets (sid, unit). A pair goes to the group of its centre, the smallest
        unit next to either end, so that dense families share a group; a set is
        made from one document's text and sent once to each of its groups.
        Centres with many shingles around them have several groups."""
        ends = pairs.select(F.col("b").alias("x"), F.col("a").alias("y")).unionByName(
            pairs.select(F.col("a").alias("x"), F.col("a").alias("y")))
        centre = ends.groupBy("x").agg(F.min("y").alias("m"))
        homes = pairs.join(centre.toDF("a", "ma"), "a").join(centre.toDF("b", "mb"), "b").select(
            "a", "b", F.least("ma", "mb").alias("m"))
        weight = members.join(classes.select("sid", "n"), "sid").groupBy("unit").agg(F.sum("n").alias("w"))
        near = homes.select("m", F.explode(F.array("a", "b")).alias("unit")).distinct()
        load = near.join(weight, "unit").groupBy("m").agg(F.ceil(F.sum("w") / GROUP_SHINGLES).alias("parts"))
        homes = materialize(homes.join(load, "m").select("a", "b", F.xxhash64(
            "m", F.pmod(F.xxhash64("a"), "parts"), F.pmod(F.xxhash64("b"), "parts")).alias("grp")), f"jaccard-{name}-homes")
        groups = homes.select("grp", F.col("a").alias("unit")).unionByName(homes.select("grp", F.col("b").alias("unit")))
        groups = groups.distinct().groupBy("unit").agg(F.collect_list("grp").alias("groups"))
        want = materialize(members.join(groups, "unit").join(classes.select("sid", "rid"), "sid"), f"jaccard-{name}-want")
        size = want.agg(F.sum(F.size("groups") + 1)).first()[0] or 0
        sets = own.select("rid", "text").join(F.broadcast(want) if size <= MAX_BROADCAST_ROWS else want, "rid").select(
            "sid", "unit", "groups", "text").mapInArrow(
            _fetch(width), "grp long, a long, b long, unit long, shingles binary")
        rows = sets.unionByName(homes.select("grp", "a", "b", F.lit(None).cast("long").alias("unit"),
                                             F.lit(None).cast("binary").alias("shingles")))
        return materialize(rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(
            _verify(rule), "a long, b long").distinct(), f"jaccard-{name}-links")

    # rounds: every class with the lead of another component that it shares most tiles with
    single = classes.select("sid", F.col("sid").alias("unit"))
    links = spark.createDataFrame([], "a long, b long")
    comps = spark.createDataFrame([], "sid long, comp long")
    for r in range(ROUNDS):
        placed = tiles.join(comps, "sid", "left").select("key", "sid", F.coalesce("comp", "sid").alias("comp"))
        if r == 0:  # a class in many tiles is in the middle of its family
            ranked = placed.join(tiles.groupBy("sid").agg(F.count("*").alias("rank")), "sid")
        else:
            ranked = placed.withColumn("rank", F.xxhash64(F.lit(r), "sid"))
        heads = materialize(ranked.groupBy("key").agg(
            F.max_by(F.struct(F.col("sid").alias("lead"), F.col("comp").alias("lead_comp")), F.struct("rank", "sid")).alias("h"),
            F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "h.*"), "jaccard-heads")
        asked = placed.join(heads, "key").where("comp != lead_comp").groupBy("sid", "lead").agg(
            F.count("*").alias("shared")).groupBy("sid").agg(F.max_by("lead", F.struct("shared", "lead")).alias("lead"))
        asked = asked.select(F.least("sid", "lead").alias("a"), F.greatest("sid", "lead").alias("b")).distinct()
        asked = materialize(asked.join(points.toDF("a", "pa"), "a").join(points.toDF("b", "pb"), "b").select(
            "a", "b", "pa", "pb").mapInArrow(_bounded(rule), "a long, b long"), "jaccard-asked")
        found = verified(asked, single, f"round{r}")
        links = links.unionByName(found)
        new = found.count()
        if new:
            comps = materialize(components(links).toDF("sid", "comp"), "jaccard-comps")
        if 2 * new >= asked.count():  # most are linked; or nothing is left to ask
            break

    parts = comps.groupBy("comp").agg(F.ceil(F.count("*") / UNIT).alias("parts"))
    units = materialize(comps.join(parts, "comp").select("sid", "comp", F.when(
        F.col("parts") == 1, F.col("comp")).otherwise(F.xxhash64("comp", F.pmod(F.xxhash64("sid"), "parts"))).alias("unit")),
        "jaccard-units")
    placed = tiles.join(units, "sid", "left").select(
        "key", "sid", F.coalesce("comp", "sid").alias("comp"), F.coalesce("unit", "sid").alias("unit"))
    still = materialize(placed.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where(
        "lo < hi").select("key", "blocks"), "jaccard-open")
    open_tiles = placed.join(still, "key")
    # a tile of several blocks is compared block by block; rows go to the blocks they meet
    mine = F.expr("cast(pmod(xxhash64(sid), blocks) as int)")
    spread = open_tiles.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    spread = spread.select(
        F.when(F.col("blocks") == 1, F.col("key")).otherwise(
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("tile"),
        "sid", "comp", "unit", F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0)
        .otherwise(1).alias("side"))
    spread = spread.join(points, "sid").repartition("tile").sortWithinPartitions("tile")
    rest = materialize(spread.select("tile", "comp", "unit", "side", "point").mapInArrow(
        _tile_join(rule), "a long, b long").distinct(), "jaccard-pairs")
    alone = classes.select("sid").join(comps, "sid", "left_anti").select("sid", F.col("sid").alias("unit"))
    more = verified(rest, alone.unionByName(units.select("sid", "unit")), "rest")
    final = components(links.unionByName(more))

    label = light.join(final.toDF("sid", "comp"), "sid", "left").select(
        "doc", "n", "row", F.coalesce("comp", "sid").alias("comp"))
    least = label.where("comp is not null").groupBy("comp").agg(F.min("doc").alias("least"))
    out = label.join(least, "comp", "left").select(
        F.col("doc").cast(id_type).alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id"), "row", "comp")
    return out if row_col is not None else out.drop("row", "comp")
