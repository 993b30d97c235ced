"""Operators on whole tables, and the pipeline, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from vigil.llm import jaccard, ngram_lm, neardup, queries, stages
from vigil.llm.components import components
from vigil.llm.ngram_lm import score

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    edges += [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(120)]
    g = Groups(1300)
    for a, b in edges:
        g.link(a, b)
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.comp for r in rows} == {x: g.find(x) for e in edges if e[0] != e[1] for x in e}
    assert len(rows) == len({r.node for r in rows})
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# -- op8 ----------------------------------------------------------------
def shingles(t):
    w = SPACE.findall(lower(t))
    return set(zip(*[w[k:] for k in range(4)])) if len(w) >= 4 else ({tuple(w)} if w else set())


def brute_jaccard(rows):
    sets, g = [shingles(t) for _, t in rows], Groups(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                g.link(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[g.find(i)] = min(least.get(g.find(i), 1 << 60), d)
    return sorted((str(d), len(s), least.get(g.find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies(seed, count, sizes=(3, 5, 9, 12, 20, 40, 60, 150)):
    rnd = random.Random(seed)
    bases = [[f"w{rnd.randint(0, 400)}" for _ in range(n)] for n in sizes]
    rows = []
    for i in range(count):
        b = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            k, x = rnd.randrange(len(b)), rnd.random()
            if x < .4:
                b[k] = f"w{rnd.randint(0, 400)}"
            elif x < .6 and len(b) > 1:
                del b[k]
            elif x < .8:
                b.insert(k, "New")
            else:
                b = b + b[:k // 8]
        rows.append((i, " ".join(b)))
    return rows


@pytest.mark.parametrize("block", [2048, 8])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(block, 350)
    rows += [(1000, None), (1001, ""), (1002, " "), (None, rows[5][1]), (3, rows[3][1]), (2000, "a b " * 4000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, sid string").repartition(4)
    got = jaccard.join(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_jaccard(rows)
    assert jaccard.join(df.limit(0)).collect() == []


def test_points_of_very_long_sets_bound_no_link_away():
    import pyarrow as pa
    rule, v = jaccard.Join(4, 85), np.arange(4_700_000, dtype=np.uint64)
    sets = [v, v[:-1000], v[:3000], v[:50]]
    size, points = jaccard._points(pa.array([jaccard.point(x) for x in sets], pa.binary()))
    assert size.tolist() == [len(x) for x in sets] and points.sum(axis=1).tolist() == size.tolist()
    assert np.minimum(points[0], points[1]).sum(dtype=np.int64) >= rule.needed(size[0], size[1])
    assert jaccard.tile_pairs(rule, np.array([1, 2]), np.array([1, 2]), size[:2], points[:2], None) == {(1, 2)}


def test_tiles_miss_no_linked_pair():
    rule, rng = jaccard.Join(4, 85), np.random.default_rng(3)
    for n in [6, 7, 10, 15, 33, 80, 200, 900]:
        for _ in range(60):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop, add = rng.integers(0, n // 6 + 1, 2)
            other = np.concatenate([base[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
            a, b = np.unique(base), np.unique(other)
            over = len(np.intersect1d(a, b))
            if 100 * over >= 85 * (len(a) + len(b) - over) and jaccard.set_id(a) != jaccard.set_id(b):
                assert set(rule.keys(a).tolist()) & set(rule.keys(b).tolist())


# -- op4 ----------------------------------------------------------------
def brute_base(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    words = [SPACE.findall(lower(t)) + [None] for _, t in rows]
    c = Counter(w for h, ws in zip(held, words) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(str(i), h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for (i, _), h, ws in zip(rows, held, words)]


@pytest.mark.parametrize("head", [1 << 20, 30])
def test_lm_base_score_equals_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(ngram_lm, "HEAD_WORDS", head)
    rnd = random.Random(2)
    rows = [(i, " ".join(f"W{int(rnd.paretovariate(0.7)) % 500}" for _ in range(rnd.randint(0, 80)))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "w1 w1 zz"), (5, rows[5][1])]
    got = score(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")).collect()
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(have, sorted(brute_base(rows))):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r.score <= 0 for r in got)


def test_lm_base_score_of_a_text_longer_than_a_slice(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{rnd.randrange(40_000)}" for _ in range(n))) for i, n in enumerate((300_000, 50, 0, 2_000))]
    assert len(rows[0][1]) > 1_500_000
    got = score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(have, sorted(brute_base(rows))):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_lm_score_beats_the_base_on_held_out_documents(spark):
    rows = score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out and n_tokens > 20").collect()
    assert np.mean([r.score > r.base_score for r in rows]) > 0.8


def test_bloom_filter_gives_levels_back():
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) << np.uint64(1)
    level = rng.integers(1, 12, len(h))
    import pyarrow as pa
    bits = 18
    batch = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(level.astype(np.int32))], names=["h", "q"])
    data = np.zeros((1 << bits) >> 3, dtype=np.uint8)
    size = (1 << (bits - ngram_lm.SEG_BITS)) >> 3
    for out in ngram_lm._build(bits - ngram_lm.SEG_BITS, 1)([batch]):
        s = out.column(0)[0].as_py()
        data[s * size:(s + 1) * size] = np.frombuffer(out.column(1)[0].as_py(), np.uint8)
    found = ngram_lm.Filter(data, bits, 1).level(h)
    assert (found >= level).all() and (found == level).mean() > 0.8


@pytest.mark.parametrize("head", [1 << 20, 30])
def test_lm_scores_are_equal_beyond_the_broadcast_bound(spark, monkeypatch, head):
    monkeypatch.setattr(ngram_lm, "HEAD_WORDS", head)
    rnd = random.Random(5)
    rows = [(i, " ".join(f"W{int(rnd.paretovariate(0.7)) % 500}" for _ in range(rnd.randint(0, 80)))) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None), (None, "w1 w1 zz")], "doc_id long, text string")
    whole = {str(r.doc_id): r for r in score(df).collect()}
    monkeypatch.setattr(ngram_lm, "MAX_BITS", 10)  # fewer than any filter has
    for r in score(df).collect():
        for a, b in zip(r, whole[str(r.doc_id)]):
            assert a == (pytest.approx(b, rel=1e-9) if isinstance(b, float) else b)


@pytest.mark.parametrize("bits", [ngram_lm.MAX_BITS, 10])
def test_lm_knows_bigrams_seen_once(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_lm, "MAX_BITS", bits)
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    train = [i for i in range(100) if i not in held and zlib.crc32(str(i).encode()) % 7 != 2][:2]
    rows = [*zip(train, ["alpha beta", "gamma delta"]), *zip(held, ["alpha beta", "alpha delta"])]
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]].held_out and got[held[1]].held_out
    assert got[held[0]].base_score == got[held[1]].base_score and got[held[0]].score > got[held[1]].score + 0.1


def test_lm_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert score(df.limit(0)).collect() == []


# -- op1 ----------------------------------------------------------------
def brute_links(vecs, labels, threshold=0.98):
    g, n = Groups(len(vecs)), [0] * len(vecs)
    unit = [None if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v)
            else np.array(v) / max(map(abs, v)) for v in vecs]
    unit = [None if u is None else u / math.sqrt(float(u @ u)) for u in unit]
    for i in range(len(vecs)):
        for j in range(i):
            if labels[i] is None or labels[i] != labels[j] or unit[i] is None or unit[j] is None:
                continue
            if len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold:
                g.link(i, j)
                n[i] += 1
                n[j] += 1
    return n, g


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = []
    for i in range(60):  # groups of copies, one of them large
        base = rng.standard_normal(16)
        for _ in range(120 if i == 0 else rng.integers(1, 5)):
            rows.append((len(rows), (base + rng.standard_normal(16) * rng.choice([0.0, 0.03, 0.08])).tolist(), i % 3))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1),
             (904, rows[0][1], None), (905, rows[0][1][:8], 0), (906, [], 0), (5, rows[5][1], rows[5][2]),
             (None, rows[0][1], 0), (907, [x * 1e200 for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<double>, label int, cid string")
    n, g = brute_links([r[1] for r in rows], [r[2] for r in rows])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[g.find(i)] = min(least.get(g.find(i), 1 << 60), r[0])
    want = sorted((str(r[0]), n[i], least[g.find(i)], r[0] == least[g.find(i)]) for i, r in enumerate(rows))
    got = neardup.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == want
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_embedding_labels_below_the_recall_are_compared_whole(spark, monkeypatch):
    for name, value in (("AHEAD", 0), ("ROUNDS", 1), ("MAX_ROUNDS", 1), ("AUDIT", 40), ("BLOCK", 128)):
        monkeypatch.setattr(neardup, name, value)  # a start that meets nothing
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 16))
    rows = [(i, (base[i // 2] + rng.standard_normal(16) * 0.03).tolist(), i // 2 % 2) for i in range(600)]
    n, g = brute_links([r[1] for r in rows], [r[2] for r in rows])
    assert sum(n) > 500
    least = {}
    for i in reversed(range(600)):
        least[g.find(i)] = i
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, n[i], least[g.find(i)]) for i in range(600)]


def test_embedding_links_that_no_list_holds_are_found(spark):
    """Groups larger than a list, two of them with a single link: its ends
    have nearer partners than the lists hold, and no audit sees them all."""
    rng, far, step = np.random.default_rng(12), math.acos(0.98), 0.004
    rows = []
    for _ in range(12):
        a, b = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
        for at in [0.0] * 59 + [2 * step, far + step] + [far + 3 * step] * 59:
            rows.append((len(rows), (math.cos(at) * a + math.sin(at) * b + rng.standard_normal(24) * 1e-6).tolist(), 0))
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (60 if i % 120 in (59, 60) else 59, i - i % 120) for i in range(len(rows))}


def test_tables_follow_the_bits():
    assert neardup.tables(0, 0.98) == neardup.tables(8, 0.98) == neardup.TABLES
    met = (1 - math.acos(0.98) / math.pi) ** 21
    assert (1 - met) ** neardup.tables(21, 0.98) <= neardup.APART


# -- pipeline -----------------------------------------------------------
def test_stages_act_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    top = docs.agg({"doc_id": "max"}).first()[0]
    clean = docs.where("length(text) > 500").first().text
    extra = [(top + 1, None, None, "s", 0), (top + 2, "12 34", "en", "s", 5), (top + 3, f"the story of it: {bench} and that is all of the story", "en", "s", 0),
             (top + 4, clean, "en", "s", len(clean)), (top + 4, clean, "en", "s", len(clean)),
             (top + 5, "the quick write to jo@example.com about that thing with the other one", "en", "s", 70), (None, "", None, None, None)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in step.select("doc_id").collect()}
        assert step.count() == len(seen[name]) + (name == "language_id")  # one id twice, until one of its group stays
    assert not {top + 1, top + 2, None} & seen["language_id"] and top + 3 in seen["language_id"]
    assert top + 4 not in seen["ngram_jaccard_join"] and top + 3 in seen["ngram_jaccard_join"]
    assert top + 3 not in seen["benchmark_decontamination"]
    masked = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/pii").where(f"doc_id > {top}").collect()}
    assert "[EMAIL]" in masked[top + 5].text and masked[top + 5].n_chars == len(masked[top + 5].text)
    assert len(seen["byte_level_bpe"]) == len(seen["pii"]) == len(seen["benchmark_decontamination"])
    # each stage against brute force: what the join and the scan decide about the documents they were given
    lang = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/language_id").collect()]
    ids = {d for d, _, c in {(r[0], r[1], r[2]) for r in brute_jaccard_fast(lang)} if str(c) == d}
    assert {str(x) for x in seen["ngram_jaccard_join"]} == ids


def brute_jaccard_fast(rows):
    """As brute_jaccard, over the pairs that share a shingle."""
    sets, g, by = [shingles(t) for _, t in rows], Groups(len(rows)), {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for a, b in {(i, j) for m in by.values() for i in m for j in m if i < j}:
        k = len(sets[a] & sets[b])
        if 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
            g.link(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[g.find(i)] = min(least.get(g.find(i), 1 << 60), d)
    return [(str(d), len(s), least[g.find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_jaccard_stage_keeps_its_rows_when_the_scan_is_cut_anew(spark, tmp_path, monkeypatch):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, text(i)) for i in range(40)] + [(100 + i, text(i)) for i in range(0, 40, 4)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id").write.parquet(f"{tmp_path}/d")
    real = jaccard.join

    def join(*args, **kwargs):  # later scans pack all files into one partition
        out = real(*args, **kwargs)
        out = out.sparkSession.createDataFrame(out.collect(), out.schema)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return out

    monkeypatch.setattr(jaccard, "join", join)
    spark.conf.set("spark.sql.files.minPartitionNum", "64")
    try:
        kept = stages.ngram_jaccard_join(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(r.doc_id for r in kept) == list(range(40))


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/d")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/d"), SF).collect() == []


# -- registered queries -------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_registered_names():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_lm_score_equals_a_plain_bloom_model(spark):
    """Counts, bits, levels and mixture restated one n-gram at a time."""
    import pyarrow as pa
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.8)) % 300}" for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    def grams(text):
        (part,) = ngram_lm.T.slices(pa.array([text]))
        one, two, _ = ngram_lm.tokens(part)
        return [int(x) for x in one], [int(x) for x in two]
    each = [grams(t) for _, t in rows]
    counts = Counter(g for x, h in zip(each, held) if not h for g in (*x[0], *x[1]))
    words = {g: n for g, n in counts.items() if g % 2 == 0}
    members = sum(n.bit_length() for n in counts.values())  # 1 + floor(log2 n) levels
    bits = max(ngram_lm.MIN_BITS, (8 * members).bit_length())
    inner = bits - ngram_lm.SEG_BITS

    def place(g, level, j):
        at = mix((g + ((level * ngram_lm.HASHES + j + 1) * 0x9E3779B97F4A7C15 & mask)) & mask) & ((1 << inner) - 1)
        return (g >> 64 - ngram_lm.SEG_BITS, at)
    stored = {place(g, q, j) for g, n in counts.items() for q in range(1, n.bit_length() + 1) for j in range(ngram_lm.HASHES)}

    def seen(g):
        q = 0
        while q < 63 and all(place(g, q + 1, j) in stored for j in range(ngram_lm.HASHES)):
            q += 1
        return q if q <= 1 else 2 ** (q - 0.5)
    total, kinds = sum(words.values()), len(words)
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), (one, two) in zip(rows, each):
        want, before = 0.0, one[-1]  # a text begins as often as it ends
        for w, g in zip(one, two):
            c2, p1 = seen(g), (seen(w) + 1) / (total + kinds + 1)
            want += math.log10(ngram_lm.MIX * c2 / max(1, seen(before), c2) + (1 - ngram_lm.MIX) * p1)
            before = w
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_tree_descent_keeps_every_pair_that_the_bound_allows():
    rule, rng = jaccard.Join(4, 85), np.random.default_rng(11)
    size = rng.integers(1, 400, 700)
    points = np.stack([np.bincount(rng.integers(0, jaccard.GROUPS, n), minlength=jaccard.GROUPS) for n in size]).astype(np.int16)
    points[350:] = points[:350]  # copies, so that pairs remain
    size = points.sum(axis=1, dtype=np.int64)

    def allowed(a, b):
        over = np.minimum(points[a][:, None], points[b][None]).sum(axis=2, dtype=np.int64)
        return over >= rule.needed(size[a][:, None], size[b][None])
    one, two = jaccard.Tree(size, points), jaccard.Tree(size[:90], points[:90])
    assert len(one.levels) == 3 and len(two.levels) == 2 and len(one.levels[-1][0]) == 1
    for a, b in ((one, one), (one, two), (two, one)):
        seen = np.zeros((len(a.order), len(b.order)), bool)
        leaves = list(a.pairs(b, rule))
        for p, q in leaves:
            seen[np.ix_(a.order[p], b.order[q])] = True
        if a is b:
            seen |= seen.T
        assert not (allowed(a.order, b.order)[np.ix_(np.argsort(a.order), np.argsort(b.order))] & ~seen).any()
        assert 0 < len(leaves) < (len(a.levels[0][0]) * len(b.levels[0][0])) * 0.7


def test_stage_keeps_texts_that_share_an_id_with_others(spark):
    words = [f"w{i}" for i in range(80)]
    text, other = " ".join(words), " ".join(reversed(words))
    rows = [(1, text), (1, other), (2, text + " end"), (3, other + " end"), (None, "x " + text), (None, "lone text of five words")]
    kept = stages.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), SF).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[1], rows[5]], key=str)


def test_clashing_columns_pass_through_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    extra = docs.selectExpr("*", "doc_id as row", "'h' as held", "'a' as at", "1 as id", "'c' as comp", "2 as sid", "'k' as key",
                            "3 as n", "'x' as lang_pred", "'y' as _spans")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, SF), stage(spark, extra, SF)
        assert out.columns == extra.columns, name
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, out.select(*docs.columns).collect()), key=str)
        assert out.where("row <=> doc_id and held = 'h' and comp = 'c'").count() == out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, extra, SF).count() == docs.count()


def test_keys_of_several_sets_are_kept_once_whatever_the_batches():
    import pyarrow as pa
    rnd = random.Random(3)
    for _ in range(200):
        rows = sorted((rnd.randrange(6), rnd.randrange(4)) for _ in range(rnd.randrange(1, 30)))
        want = sorted({r for r in rows if len({s for k, s in rows if k == r[0]}) > 1})
        cuts = [0, *sorted(rnd.randrange(len(rows) + 1) for _ in range(4)), len(rows)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a:b]], pa.int64()) for c in (0, 1)], names=["key", "sid"])
                   for a, b in zip(cuts, cuts[1:])]
        got = [tuple(r.values()) for b in jaccard._crowded(batches) for r in b.to_pylist()]
        assert got == want


def test_windows_shared_by_many_items(spark):
    from vigil.llm.decontaminate import decontaminate
    window = " ".join(f"w{i}" for i in range(10))
    items = [(f"i{k}", window + f" own{k}") for k in range(500)]
    docs = [(1, ("x " + window + " ") * 300), (2, "nothing of it"), (3, "y " * 200_000 + window)]
    out = {r.doc_id: r for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"),
                                              spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert (out[1].n_hit, out[1].n_items, out[2].n_hit, out[3].n_hit, out[3].n_items) == (3000, 500, 0, 10, 500)
