"""Prefix trie of conversations from double arrays.

A conversation is rebuilt as a sequence of turns; its first d turns name a
node, by 128 bits: the exclusive or of a hash of (position, role and text) over
the turns. Positions, prefixes and sums along a conversation are taken in
chunks, so that one very long conversation is spread over tasks.

1. Equal sequences are one class: its smallest conversation stands for it, with
   the number of members.
2. Nodes that more than ``CROWD`` classes share (and the root) are the upper
   nodes; their counts come from one aggregate. Below them every first node
   that fewer share is the top of a prefix shard; a shard deeper than ``DEEP``
   turns is cut again at that depth, so a shard is bounded both ways.
3. In a shard the turns get dense ids, and a double array (BASE and CHECK) is
   packed over them level by level. Walking the sequences through it finds the
   nodes; members, children, leaves and savings are summed from the bottom up.
4. Every node belongs to the smallest class that passes through it. The shards
   give what each class owns in them, so that a node above them (an upper node,
   or the end of a cut shard) adds up the classes that pass through it: shared
   nodes are merged globally without walking down again.

Defined results: rows of a null conv_id take no part; a null role or text is
empty; turns are ordered by ``turn`` (null first), then by the MD5 of role and
text; a rebuilt conversation without turns is a member of the root only;
repeated rows are turns of their own; other columns are ignored; an empty table
gives an empty table (no root).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.grouping import whole_groups
from vigil.session import materialize

#: Classes that a shard's top may have; turns of a shard's paths.
CROWD, DEEP = 256, 256
#: Turns of a conversation in one window.
CHUNK = 4096
#: Rows of a task's group of shards.
BUCKET = 1 << 16
#: Ids in one piece of a node's list of conversations.
PIECE = 2048
#: Rows of a side table that is broadcast; more are joined by shuffle.
MAX_BROADCAST_ROWS = 1 << 18
EMPTY = hashlib.sha256(b"").hexdigest()
NONE = np.iinfo(np.int64).max


def _light(df: DataFrame) -> DataFrame:
    """``df`` (written or cheap), broadcast if its rows are few."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


# -- rebuilt sequences ----------------------------------------------------
def _number(batches):
    """Rows sorted by conversation -> with the task and the place among the
    task's rows of that conversation."""
    part, held, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0).to_numpy()
        first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        k = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        if held == conv[0]:
            k[:first[1] if len(first) > 1 else n] += seen
        held, seen = conv[-1], int(k[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part)), pa.array(k.astype(np.int64)),
                                          batch.column(1), batch.column(2)], names=["conv", "part", "k", "digest", "bytes"])


def positions(turns: DataFrame) -> DataFrame:
    """(conv, turn, digest, bytes) -> (conv, pos, digest, bytes), by a range
    sort: only a conversation at the border of tasks goes on in the next one,
    and what it has in earlier tasks is one row a border."""
    order = ["conv", "turn", "digest"]
    t = materialize(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "bytes").mapInArrow(
        _number, "conv long, part long, k long, digest binary, bytes long"), "trie-turns")
    ends = t.groupBy("part").agg(F.array(F.min("conv"), F.max("conv")).alias("e"))  # a row a task
    border = t.join(F.broadcast(ends.select(F.explode("e").alias("conv")).distinct()), "conv").groupBy("conv", "part").count()
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    border = border.select("conv", "part", F.sum("count").over(before).alias("off")).where("off > 0")
    return t.join(F.broadcast(border), ["conv", "part"], "left").select(
        "conv", (F.col("k") + F.coalesce("off", F.lit(0))).alias("pos"), "digest", "bytes")


def mark(lane: int, d: str = "d") -> Column:
    """Hash of a turn at its depth; null at the root."""
    return F.when(F.col("digest").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(lane), F.col(d), F.col("digest")))


def rebuilt(convs: DataFrame, span: int, most: int) -> DataFrame:
    """(conv, pos, digest, bytes) -> (c, d, digest, bytes), d from 1, and a row
    of depth 0 for each conversation. The first h turns are those of the
    conversation at the start of its span."""
    h = F.expr(f"cast(crc32(cast(cast(c as string) as binary)) % {most + 1} as int)")
    heads = convs.where((F.col("conv") % span == 0) & (F.col("pos") < most)).groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))  # at most ``most`` turns
    plan = convs.select(F.col("conv").alias("c")).distinct().withColumn("base", F.col("c") - F.col("c") % span)
    plan = plan.join(heads, "base", "left").select("c", h.alias("h"), F.coalesce(F.slice("head", 1, h), F.array()).alias("head"))
    plan = materialize(plan.withColumn("less", F.col("h") - F.size("head")), "trie-plan")
    own = convs.select(F.col("conv").alias("c"), "pos", "digest", "bytes").where(F.col("pos") >= h)
    own = own.join(_light(plan.where("less > 0").select("c", "less")), "c", "left").select(
        "c", (F.col("pos") + 1 - F.coalesce("less", F.lit(0))).alias("d"), "digest", "bytes")
    first = plan.select("c", F.inline("head")).select("c", (F.col("pos") + 1).alias("d"), "digest", "bytes")
    root = plan.select("c", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("digest"),
                       F.lit(0).cast("long").alias("bytes"))
    return own.unionByName(first).unionByName(root)


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds p1, p2: the 128 bits of each prefix."""
    rows = materialize(rows.withColumn("chunk", F.expr(f"d div {CHUNK}")), "trie-rebuilt")
    sums = rows.join(_light(rows.where("chunk > 0").select("c").distinct()), "c", "left_semi").groupBy("c", "chunk").agg(
        *[F.bit_xor(mark(k)).alias(f"o{k}") for k in (1, 2)])
    ahead = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select("c", "chunk", *[F.bit_xor(f"o{k}").over(ahead).alias(f"o{k}") for k in (1, 2)]).where(
        "chunk > 0"), "trie-chunks")
    so_far = Window.partitionBy("c", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.bit_xor(mark(k)).over(so_far).alias(f"p{k}") for k in (1, 2)])
    return rows.join(_light(sums), ["c", "chunk"], "left").select("c", "d", "digest", "bytes", *[
        F.col(f"p{k}").bitwiseXOR(F.coalesce(f"o{k}", F.lit(0))).alias(f"p{k}") for k in (1, 2)])


# -- double arrays --------------------------------------------------------
class DoubleArray:
    """Trie over dense symbols: the child of state s by symbol a is the cell
    BASE[s] + a, which is it only if CHECK there is s. Cell 0 is the root."""

    def __init__(self, room: int = 1024):
        self.base, self.check = np.zeros(room, dtype=np.int64), np.full(room, -1, dtype=np.int64)
        self.check[0] = 0
        self.free = 1  # no free cell lies before

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, dtype=np.int64))
            self.check = np.append(self.check, np.full(more, -1, dtype=np.int64))

    def _cells(self, n: int) -> np.ndarray:
        """The first ``n`` free cells."""
        while True:
            cells = np.flatnonzero(self.check[self.free:self.free + 8 * n + 1024] < 0)
            if len(cells) >= n:
                return cells[:n] + self.free
            cells = np.flatnonzero(self.check[self.free:] < 0)
            if len(cells) >= n:
                return cells[:n] + self.free
            self._grow(len(self.check) + n)

    def add(self, states: np.ndarray, symbols: np.ndarray) -> None:
        """Children of some childless states, sorted by (state, symbol)."""
        cut = np.flatnonzero(np.append(True, states[1:] != states[:-1]))
        size = np.diff(np.append(cut, len(states)))
        for a, n in zip(cut[size > 1].tolist(), size[size > 1].tolist()):
            own, state = symbols[a:a + n], int(states[a])
            span = int(own[-1] - own[0]) + 1
            for first in self._cells(32).tolist():  # first fit among the first holes
                self._grow(first + span)
                if (self.check[first + own - own[0]] < 0).all():
                    break
            else:
                first = int(np.flatnonzero(self.check >= 0)[-1]) + 1
                self._grow(first + span)
            self.base[state] = first - own[0]
            self.check[first + own - own[0]] = state
        single = cut[size == 1]  # a lone child fits any free cell
        if len(single):
            cells = self._cells(len(single))
            self.base[states[single]] = cells - symbols[single]
            self.check[cells] = states[single]
            self.free = int(cells[-1]) + 1

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Cells reached, -1 where there is no such child."""
        cells = self.base[states] + symbols
        inside = (cells > 0) & (cells < len(self.check))
        return np.where(inside & (self.check[np.where(inside, cells, 0)] == states), cells, -1)


def pack(symbols: np.ndarray, at: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """Double array of the sequences symbols[at[i]:at[i+1]], and the cell of
    every symbol's node."""
    trie, width = DoubleArray(), int(symbols.max(initial=0)) + 1
    cells = np.zeros(len(symbols), dtype=np.int64)
    state, size = np.zeros(len(at) - 1, dtype=np.int64), np.diff(at)
    for level in range(int(size.max(initial=0))):
        alive = np.flatnonzero(size > level)
        rows = at[alive] + level
        edge = np.unique(state[alive] * width + symbols[rows])
        trie.add(edge // width, edge % width)
        state[alive] = cells[rows] = trie.step(state[alive], symbols[rows])
    return trie, cells


OUT = ("kind int, conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, "
       "end long, single boolean, seg long, p1 long, p2 long, digest binary")
_OUT = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in (
    "conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "end")], ("single", pa.bool_()),
    ("seg", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("digest", pa.binary())])
NODE, OWNED, CUT = 0, 1, 2  # a node, what a class owns, a node at the end of a cut shard


def _nodes(table: pa.Table, whole: bool):
    """Nodes of the shards of one bucket, and what each class owns there.
    Unless ``whole`` (the rows know what lies below their ghosts), shards with
    ghosts give no nodes yet."""
    col = {c: table.column(c).to_numpy() for c in ("o1", "o2", "rep", "wt", "d", "bytes", "seg", "p1", "p2", "below_leaves",
                                                   "below_saved")}
    ghost, last = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("ghost", "last"))
    n = table.num_rows
    shard_new = np.append(True, (col["o1"][1:] != col["o1"][:-1]) | (col["o2"][1:] != col["o2"][:-1]))
    new = shard_new.copy()
    new[1:] |= col["rep"][1:] != col["rep"][:-1]
    shard = np.cumsum(shard_new) - 1
    at = np.append(np.flatnonzero(new), n)
    # dense ids of the turns; a shard's first symbol is the shard itself
    turn = table.column("digest").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    symbols = np.where(new, int(turn.max()) + 1 + shard, turn)
    trie, cell = pack(symbols, at)
    room = len(trie.check)

    real = ~ghost
    conv, weight = np.full(room, NONE), np.zeros(room, dtype=np.int64)
    np.minimum.at(conv, cell[real], col["rep"][real])
    np.add.at(weight, cell[real], col["wt"][real])
    node, row = np.unique(cell, return_index=True)  # a row of each node
    up = trie.check[node]
    top = up == 0
    children = np.bincount(up[~top], minlength=room)
    keep = real[row]
    node, row, up, top = node[keep], row[keep], up[keep], top[keep]
    leaf = children[node] == 0
    saving = (weight[node] - 1) * col["bytes"][row]
    leaves, saved = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int64)
    leaves[node], saved[node] = leaf, saving
    tail = np.flatnonzero(ghost)  # the row before a ghost ends its sequence here
    np.add.at(leaves, cell[tail - 1], col["below_leaves"][tail])
    np.add.at(saved, cell[tail - 1], col["below_saved"][tail])
    order = np.argsort(-col["d"][row], kind="stable")
    depth = col["d"][row][order]
    for a, b in _runs(depth):  # from the deepest level up
        level = order[a:b]
        level = level[~top[level]]
        np.add.at(leaves, up[level], leaves[node[level]])
        np.add.at(saved, up[level], saved[node[level]])

    end, single = np.full(room, NONE), np.zeros(room, dtype=bool)
    stop = np.flatnonzero(last & real)
    end[cell[stop]], single[cell[stop]] = col["rep"][stop], col["wt"][stop] == 1
    cut = np.zeros(shard[-1] + 1, dtype=bool)
    cut[shard[tail]] = True
    out = ~cut[shard[row]] | whole
    ends_cut = np.zeros(room, dtype=bool)
    ends_cut[cell[tail - 1]] = True
    r, k = row[out], node[out]
    named = top[out] | ends_cut[k]
    none = ~named
    yield pa.RecordBatch.from_arrays([
        pa.array(np.where(ends_cut[k], CUT, NODE).astype(np.int32)), pa.array(conv[k]), pa.array(col["d"][r]),
        pa.array(conv[up[out]], mask=top[out]), pa.array(weight[k]), pa.array(children[k]), pa.array(leaves[k]),
        pa.array(saved[k]), pa.array(end[k], mask=end[k] == NONE), pa.array(single[k]),
        pa.array(col["seg"][r]), pa.array(col["p1"][r], mask=none), pa.array(col["p2"][r], mask=none),
        pa.array([x if t else None for x, t in zip(table.column("digest").take(pa.array(r)).to_pylist(), top[out].tolist())],
                 pa.binary())], schema=_OUT)
    if not whole:
        # owners have their sequences in this bucket: the key is (class, segment)
        key, which = np.unique(np.stack([conv[node], col["seg"][row]], axis=1), axis=0, return_inverse=True)
        which = which.reshape(-1)
        sums = [np.zeros(len(key), dtype=np.int64) for _ in range(2)]
        np.add.at(sums[0], which, leaf)
        np.add.at(sums[1], which, saving)
        m = len(key)
        null = pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(m, OWNED, dtype=np.int32)), pa.array(key[:, 0]), null, null, null, null, pa.array(sums[0]),
            pa.array(sums[1]), null, pa.nulls(m, pa.bool_()), pa.array(key[:, 1]), null, null, pa.nulls(m, pa.binary())],
            schema=_OUT)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cut = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)).tolist() if len(x) else [0]
    return list(zip(cut[:-1], cut[1:]))


def _shards(whole: bool):
    def run(batches):
        for table, groups in whole_groups(batches, "bucket"):
            for a, b in groups:
                yield from _nodes(table.slice(a, b - a), whole)
    return run


def shards(body: DataFrame, buckets: int, whole: bool) -> DataFrame:
    names = ["o1", "o2", "rep", "wt", "d", "digest", "bytes", "last", "ghost", "seg", "p1", "p2", "below_leaves", "below_saved"]
    order = ["bucket", "o1", "o2", "rep", "d"]
    return body.select(F.pmod(F.xxhash64("o1", "o2"), F.lit(buckets)).alias("bucket"), *names).repartition("bucket") \
        .sortWithinPartitions(*order).mapInArrow(_shards(whole), OUT)


# -- members --------------------------------------------------------------
def _pieces(batches):
    """(rep, c) in order -> (rep, first, piece): decimal ids, comma-joined."""
    for batch in batches:
        rep, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out: list[tuple] = []
        for a, b in _runs(rep):
            for i in range(a, b, PIECE):
                j = min(b, i + PIECE)
                out.append((int(rep[a]), int(c[i]), ",".join(map(str, c[i:j].tolist()))))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(
            (pa.int64(), pa.int64(), pa.string()))], names=["rep", "first", "piece"])


def _digests(batches):
    """Pieces in order -> (rep, digest of the joined pieces)."""
    rep, state = None, None
    for batch in batches:
        done: list[tuple[int, str]] = []
        for r, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
            if r != rep:
                if rep is not None:
                    done.append((rep, state.hexdigest()))
                rep, state = r, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_buffer())
        yield _digest_rows(done)
    if rep is not None:
        yield _digest_rows([(rep, state.hexdigest())])


def _digest_rows(done: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())],
                                      names=["end", "sha"])


def member_digests(members: DataFrame) -> DataFrame:
    """(rep, c) -> (end, sha). A digest is sequential: the ids are joined to
    pieces wherever they lie, and one task reads the pieces of a class."""
    pieces = members.repartitionByRange("rep", "c").sortWithinPartitions("rep", "c").mapInArrow(
        _pieces, "rep long, first long, piece string")
    return pieces.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "piece").mapInArrow(
        _digests, "end long, sha string")


# -- the trie -------------------------------------------------------------
def trie(conversations: DataFrame, span: int = 5, most: int = 8, id_col: str = "conv_id", turn_col: str = "turn",
         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    own = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    own = own.where("conv is not null").select("conv", "turn", F.expr(
        "unhex(md5(concat(octet_length(role), ':', role, text)))").alias("digest"), F.expr(
        "cast(octet_length(text) as long)").alias("bytes"))
    path = materialize(prefixes(rebuilt(positions(own), span, most)), "trie-prefixes")

    whole = path.groupBy("c").agg(F.max("d").alias("len"), F.max_by(F.struct("p1", "p2"), "d").alias("s"))
    whole = materialize(whole.select("c", "len", "s.*"), "trie-sequences")
    classes = whole.groupBy("len", "p1", "p2").agg(F.min("c").alias("rep"), F.count("*").alias("wt"))
    classes = materialize(classes, "trie-classes")
    many = classes.where("wt > 1")
    digests = member_digests(whole.join(_light(many), ["len", "p1", "p2"]).select("rep", "c"))

    rows = path.withColumnRenamed("c", "rep").join(classes.select("rep", "wt", "len"), "rep").withColumn(
        "last", F.expr("d = len")).drop("len")
    key = ["d", "p1", "p2"]
    upper = rows.groupBy(*key).agg(
        F.count("*").alias("crowd"), F.min("rep").alias("conv"), F.sum("wt").alias("n_convs"), F.first("digest").alias("digest"),
        F.first("bytes").alias("bytes"), F.max(F.expr("if(last, rep, null)")).alias("end"),
        F.max(F.expr("if(last, wt = 1, null)")).alias("single"))
    upper = materialize(upper.where((F.col("crowd") > CROWD) | (F.col("d") == 0)), "trie-upper")
    # the classes that pass through upper nodes
    through = materialize(rows.select("rep", *key).join(_light(upper.select(*key, "conv", (
        (F.col("n_convs") - 1) * F.col("bytes")).alias("saving"))), key), "trie-through")
    tops = through.groupBy("rep").agg((F.max("d") + 1).alias("top"))

    body = rows.join(tops, "rep").where("d >= top").withColumn("seg", F.expr(f"(d - top) div {DEEP}"))
    # the top of a deeper shard is also the ghost that ends the one above
    twice = F.expr(f"if((d - top) % {DEEP} = 0 and d > top, array(struct(seg as seg, false as ghost), "
                   f"struct(seg - 1 as seg, true as ghost)), array(struct(seg as seg, false as ghost)))")
    body = body.withColumn("at", F.explode(twice)).drop("seg").select("*", "at.*")
    start = Window.partitionBy("rep", "seg").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    body = materialize(body.select("rep", "wt", "d", "digest", "bytes", "last", "seg", "ghost", "p1", "p2", *[
        F.first(f"p{k}").over(start).alias(f"o{k}") for k in (1, 2)]), "trie-body")
    buckets = max(1, -(-body.count() // BUCKET))
    nothing = {f"below_{c}": F.lit(0).cast("long") for c in ("leaves", "saved")}
    found = materialize(shards(body.withColumns(nothing), buckets, False), "trie-shards")
    owned = found.where(F.col("kind") == OWNED).select(F.col("conv").alias("rep"), "seg", "n_leaves", "saved")
    nodes = found.where(F.col("kind") != OWNED)

    cut = body.where("ghost").select("o1", "o2").distinct()
    if cut.limit(1).count():
        below = Window.partitionBy("rep").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, 0)
        # what a class owns in a segment and all deeper ones; a segment may own nothing
        deep = body.where("not ghost").select("rep", "seg").distinct().join(
            body.where("ghost").select("rep").distinct(), "rep", "left_semi").join(owned, ["rep", "seg"], "left")
        deep = deep.select("rep", (F.col("seg") - 1).alias("seg"), *[F.sum(F.coalesce(c, F.lit(0))).over(below).alias(f"below_{a}")
                                                                    for a, c in (("leaves", "n_leaves"), ("saved", "saved"))])
        again = body.join(_light(cut), ["o1", "o2"], "left_semi").join(deep, ["rep", "seg"], "left")
        again = again.withColumns({c: F.when(F.col("ghost"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)) for c in nothing})
        nodes = nodes.unionByName(materialize(shards(again, buckets, True), "trie-cut"))

    # upper nodes: what the classes through them own from there on
    total = owned.groupBy("rep").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    down = Window.partitionBy("rep").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    sums = through.join(total, "rep", "left").select(*key, F.coalesce("leaves", F.lit(0)).alias("leaves"), (
        F.coalesce("saved", F.lit(0)) + F.sum(F.expr("if(conv = rep, saving, 0L)")).over(down)).alias("saved"))
    sums = sums.groupBy(*key).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = lambda d: [(F.col(d) - 1).alias("d"), *[F.col(f"p{k}").bitwiseXOR(mark(k, d)).alias(f"p{k}") for k in (1, 2)]]
    below_tops = nodes.where("digest is not null")
    kids = below_tops.where("seg = 0").select(*above("depth")).unionByName(
        upper.where("d > 0").select(*above("d"))).groupBy(*key).agg(F.count("*").alias("kids"))
    shared = upper.join(sums, key).join(kids, key, "left").select(
        "conv", F.col("d").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs",
        F.coalesce("kids", F.lit(0)).alias("n_children"),
        F.when(F.col("kids").isNull(), F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), "saved", "end", "single",
        "p1", "p2", "digest")

    # parents of tops and upper nodes lie elsewhere
    parents = upper.select(*key, "conv").unionByName(nodes.where(F.col("kind") == CUT).select(
        F.col("depth").alias("d"), "p1", "p2", "conv"))
    cols = ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "end", "single"]
    shared = materialize(shared, "trie-shared")
    orphans = below_tops.select(*cols, "p1", "p2", "digest").unionByName(shared.where("depth > 0").select(*cols, "p1", "p2", "digest"))
    orphans = orphans.select(*[c for c in cols if c != "parent"], *above("depth")).join(
        _light(parents.withColumnRenamed("conv", "parent")), key).select(*cols)
    every = nodes.where("digest is null").select(*cols).unionByName(shared.where("depth = 0").select(*cols)).unionByName(orphans)
    every = materialize(every, "trie-nodes")

    lone = every.where("end is null or single").withColumn("sha", F.when(F.col("end").isNull(), F.lit(EMPTY)).otherwise(
        F.sha2(F.col("end").cast("string"), 256)))
    out = lone.unionByName(every.where("end is not null and not single").join(digests, "end").select(*cols, "sha"))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                      "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
