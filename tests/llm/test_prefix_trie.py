"""op11 against a plain trie, with shards cut small in both ways."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def tie(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    nodes = {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seq = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], {"members": [], "ends": [], "kids": set()})["members"].append(c)
        nodes[seq]["ends"].append(c)
    for seq in nodes:
        if seq:
            nodes[seq[:-1]]["kids"].add(seq)
    out = []
    for seq in sorted(nodes, key=len, reverse=True):
        n = nodes[seq]
        n["leaves"] = sum(nodes[k]["leaves"] for k in n["kids"]) or 1
        own_saving = (len(n["members"]) - 1) * len(seq[-1][1].encode()) if seq else 0
        n["saved"] = own_saving + sum(nodes[k]["saved"] for k in n["kids"])
        out.append((min(n["members"]), len(seq), min(nodes[seq[:-1]]["members"]) if seq else None, len(n["members"]),
                    len(n["kids"]), n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def run(spark, rows):
    out = P.trie(spark.createDataFrame(rows, SCHEMA))
    assert tuple(out.columns) == COLS
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2])


def talk(rnd, c, n, words=3):
    return [(c, i, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bé", "語 c", ""][:words])) for i in range(n)]


def test_random_conversations(spark):
    rnd = random.Random(1)
    rows = [r for c in range(120) for r in talk(rnd, c, rnd.randrange(1, 12))]
    rnd.shuffle(rows)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("crowd,deep,chunk", [(2, 3, 4), (1, 2, 1000), (5, 1, 3), (1000, 4, 2)])
def test_shards_cut_by_crowd_and_depth(spark, monkeypatch, crowd, deep, chunk):
    monkeypatch.setattr(P, "CROWD", crowd)
    monkeypatch.setattr(P, "DEEP", deep)
    monkeypatch.setattr(P, "CHUNK", chunk)
    monkeypatch.setattr(P, "BUCKET", 40)
    rnd = random.Random(crowd * 10 + deep)
    rows = [r for c in range(60) for r in talk(rnd, c, rnd.randrange(1, 14), 2)]
    rows += [(c, i, "user", "same") for c in range(100, 130) for i in range(c % 4 + 20)]  # long shared prefixes and copies
    assert run(spark, rows) == brute(rows)


def test_hot_conversation_first_turn_and_copies(spark):
    rnd = random.Random(7)
    rows = [(10, i, "user", f"t{i}") for i in range(3000)]  # a third of all rows
    rows += [(11, i, "user", f"t{i}") for i in range(2000)] + [(12, i, "user", f"t{i}") for i in range(900)]
    rows += [r for c in range(100, 500) for r in [(c, 0, "system", "hello"), *[(c, i, "user", rnd.choice("ab")) for i in (1, 2, 3)]]]
    assert run(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_absent_bases(spark):
    rows = [(3, None, "user", "x"), (3, None, None, None), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"),
            (None, 0, "user", "lost"), (8, 0, None, "z"), (8, 0, "", "z"), (-7, 0, "user", "n"), (-5, 5, "user", "m"),
            (-3, 1, "user", "q"), (0, 2, "u", "w"), (4, 0, "ab", "c"), (9, 0, "a", "bc"), (2**62, 1, "user", "big")]
    rows += [(c, 0, "user", "short") for c in range(1000, 1040)]  # many lose all turns
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(None, 1, "a", "b")]) == []


def test_extra_columns_and_long_texts(spark):
    rows = [(c, i, "user", "é" * 400_000 if i == 1 else "t") for c in (5, 6, 7) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as d", "1 as rep", "'y' as digest", "2 as conv", "3 as c")
    got = sorted((tuple(r) for r in P.trie(df).collect()), key=lambda r: r[:2])
    assert got == brute(rows)


def test_double_array_holds_exactly_its_sequences():
    rnd = np.random.default_rng(2)
    for width, longest in ((2, 12), (50, 6), (5000, 3)):
        seqs = [rnd.integers(0, width, size=rnd.integers(1, longest + 1)).tolist() for _ in range(400)]
        at = np.append(0, np.cumsum([len(s) for s in seqs]))
        trie, cells = P.pack(np.concatenate(seqs), at)
        names = {}
        for s, a in zip(seqs, at.tolist()):
            for d in range(len(s)):
                assert names.setdefault(int(cells[a + d]), tuple(s[:d + 1])) == tuple(s[:d + 1])
        known = {(): 0} | {v: k for k, v in names.items()}
        assert len(known) == len(names) + 1
        for prefix, cell in known.items():  # CHECK admits the children there are, and no other
            got = trie.step(np.full(width, cell), np.arange(width))
            assert {a: int(c) for a, c in enumerate(got) if c >= 0} == {
                a: known[prefix + (a,)] for a in range(width) if prefix + (a,) in known}


def test_pieces_join_to_the_same_digest():
    ids = np.arange(10_000) * 3
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(len(x), 1)), pa.array(x)], names=["rep", "c"])
               for x in (ids[:5000], ids[5000:])]
    pieces = [b.select([0, 2]) for b in P._pieces(iter(batches))]
    assert sum(b.num_rows for b in pieces) > 3
    (row,) = [r for b in P._digests(iter(pieces)) for r in b.to_pylist()]
    assert row == {"end": 1, "sha": hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()}
