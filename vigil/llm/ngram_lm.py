"""Language-model scores from a log-frequency Bloom filter.

Counts of all words and bigrams of the training documents are gathered with
one shuffle. A count n is quantised to its level 1 + floor(log2 n), so that
n-grams seen once are members too; an n-gram of level q is
put into the filter as the members (n-gram, 1) .. (n-gram, q), and probing
level after level until the first miss gives the level back. Scores are bigram
probabilities mixed with add-one word probabilities, all from such probes.

The filter is built in segments on the executors; its size follows the number
of members and all levels are kept at every size. Up to ``MAX_BITS`` (128 MB)
it is broadcast. Past that it stays where it is built: the distinct n-grams of
the documents are sent to their segments, and the logarithms of the
probabilities of their bigrams come back by a join (those of the most frequent
bigrams, at most ``HEAD_WORDS``, by broadcast). Both ways probe the same bits;
the second one's work and disk grow in proportion to the corpus, too.

The base score needs exact word counts. Frequent words (the largest count
threshold under which at most ``HEAD_WORDS`` qualify) are broadcast; all other
words of the documents are joined with the counts. Words are identified by a
64-bit hash.

Defined results: a null text is empty and consists of the end token; a null
id counts as a training document; repeated rows keep their multiplicity and
all count; other columns are ignored; an empty table gives an empty table, and
without training documents every base probability is 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textops as T
from vigil.llm.grouping import whole_groups
from vigil.session import materialize

SEG_BITS = 10  # a broadcast filter has 2**SEG_BITS segments, by the top bits of the hash
MAX_BITS = 30  # of a broadcast filter
SEG_MOST = 20  # log2 of the bits of a segment that is not broadcast; larger filters have more segments
MIN_BITS = 17
HASHES = 2
HEAD_WORDS = 1 << 20
#: Weight of the bigram probability against the word probability.
MIX = 0.2
END = np.uint64(0x51AFD7ED558CCD00)
BEGIN = np.uint64(0x2545F4914F6CDD1D)
_ONE = np.uint64(1)


def pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return T.mix(before * np.uint64(0x9FB21C651E98DF25) + word) | _ONE


def tokens(part: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then the end of each row), of the bigrams
    they close, and each row's first token. Word hashes are even, bigram
    hashes odd."""
    w = T.Words(part, "space")
    n_rows = len(part)
    out = np.empty(len(w) + n_rows, dtype=np.uint64)
    out[np.arange(len(w)) + w.rows()] = w.hashes(lower=True)
    off = w.off + np.arange(n_rows + 1)
    out[off[1:] - 1] = END
    out &= ~_ONE
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[off[:-1]] = BEGIN
    return out, pair(before, out), off


def _count(batches):
    held: list[np.ndarray] = []
    size = 0

    def flush():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    for batch in batches:
        for part in T.slices(batch.column(0)):
            one, two, _ = tokens(part)
            held += [one, two]
            size += 2 * len(one)
            if size > 1 << 21:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _asked(batches):
    """Bigrams of the texts: (the word they close, the word before it, or
    BEGIN). Their hash follows from both and is not sent."""
    for batch in batches:
        for part in T.slices(batch.column(0)):
            one, two, off = tokens(part)
            before = np.empty_like(one)
            before[1:] = one[:-1]
            before[off[:-1]] = BEGIN
            _, at = np.unique(two, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (one[at], before[at])],
                                             names=["word", "before"])


def _named(batches):
    """(word, before) with the hash of the bigram; a text begins as often as it
    ends, so the count of BEGIN is that of END."""
    for batch in batches:
        word, before = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        h = pair(before, word)
        before = np.where(before == BEGIN, END & ~_ONE, before)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h, word, before)], names=["h", "word", "before"])


def _inner(h: np.ndarray, level: int, j: int, seg_bits: int) -> np.ndarray:
    """Bit position in its segment of the member (h, level), hash j."""
    inner = T.mix(h + np.uint64((level * HASHES + j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return (inner & np.uint64((1 << seg_bits) - 1)).astype(np.int64)


def _bits(h: np.ndarray, level: int, j: int, seg_bits: int) -> np.ndarray:
    """Bit position in the filter of the member (h, level), hash j."""
    seg = (h >> np.uint64(64 - SEG_BITS)).astype(np.int64)
    return (seg << seg_bits) | _inner(h, level, j, seg_bits)


class Filter:
    """Log-frequency Bloom filter: levels ``low`` and up of hashed n-grams."""

    def __init__(self, data: np.ndarray, bits: int, low: int = 1):
        self.data, self.seg_bits, self.low = data, bits - SEG_BITS, low

    def _has(self, h: np.ndarray, level: int) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for j in range(HASHES):
            at = _bits(h, level, j, self.seg_bits)
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out

    def level(self, h: np.ndarray) -> np.ndarray:
        """Levels of n-grams, 0 where the first probe misses."""
        found = np.zeros(len(h), dtype=np.int64)
        alive, level = np.arange(len(h)), self.low
        while len(alive) and level < 64:
            alive = alive[self._has(h[alive], level)]
            found[alive] = level
            level += 1
        return found

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Counts of n-grams: the middle of their level."""
        q = self.level(h)
        return np.where(q <= 1, q, 2.0 ** (q - 0.5))


def _build(seg_bits: int, low: int):
    def run(batches):
        segs: dict[int, np.ndarray] = {}
        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64)
            level = np.asarray(batch.column(1))
            for q in range(low, int(level.max(initial=0)) + 1):
                own = h[level >= q]
                seg = (own >> np.uint64(64 - SEG_BITS)).astype(np.int64)
                order = np.argsort(seg, kind="stable")
                own, seg = own[order], seg[order]
                cut = np.flatnonzero(np.diff(seg)) + 1
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(seg)]):
                    if a == b:
                        continue
                    if int(seg[a]) not in segs:
                        segs[int(seg[a])] = np.zeros(1 << seg_bits, dtype=bool)
                    for j in range(HASHES):
                        segs[int(seg[a])][_inner(own[a:b], q, j, seg_bits)] = True
        for s, data in segs.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([s], pa.int32()), pa.array([np.packbits(data, bitorder="little").tobytes()], pa.binary())],
                names=["seg", "data"])
    return run


def _plan(levels: dict[int, int]) -> int:
    """Filter size (log2 of bits) for a count of n-grams per level: 8 bits a
    member; 6 are enough where that lets the filter be broadcast."""
    members = sum(n * q for q, n in levels.items())
    bits = max(MIN_BITS, int(8 * members).bit_length())
    return MAX_BITS if bits > MAX_BITS >= MIN_BITS and members * 6 <= 1 << MAX_BITS else bits


def _probe(seg_bits: int):
    """Rows (seg, h, q) sorted by segment, q = 0 being questions -> (h, level)
    of the questions from the segment's members."""
    def run(batches):
        for rows, groups in whole_groups(batches, "seg"):
            h, level = rows.column("h").to_numpy().view(np.uint64), rows.column("q").to_numpy()
            for a, b in groups:
                own, q = h[a:b], level[a:b]
                data = np.zeros(1 << seg_bits, dtype=bool)
                for k in range(1, int(q.max()) + 1):
                    for j in range(HASHES):
                        data[_inner(own[q >= k], k, j, seg_bits)] = True
                asked = own[q == 0]
                found, alive, k = np.zeros(len(asked), dtype=np.int32), np.arange(len(asked)), 1
                while len(alive) and k < 64:
                    for j in range(HASHES):
                        alive = alive[data[_inner(asked[alive], k, j, seg_bits)]]
                    found[alive] = k
                    k += 1
                yield pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)), pa.array(found)], names=["h", "q"])
    return run


def _pair_scores(docs: DataFrame, members: DataFrame, bits: int, total: int, words: int) -> DataFrame:
    """All bigrams of ``docs`` (text): h, level, logarithm of the probability,
    from a filter of ``members`` (h, q) that is probed segment by segment."""
    seg_bits = min(bits - SEG_BITS, SEG_MOST)
    seg = F.expr(f"shiftrightunsigned(h, {64 - (bits - seg_bits)})").alias("seg")
    asked = materialize(docs.select("text").mapInArrow(_asked, "word long, before long").distinct().mapInArrow(
        _named, "h long, word long, before long"), "ngram-asked")
    single = asked.select(F.explode(F.array("word", "before")).alias("h")).distinct()
    rows = members.select(seg, "h", "q").unionByName(
        asked.select("h").unionByName(single).select(seg, "h", F.lit(0).alias("q")))
    found = materialize(rows.repartition("seg").sortWithinPartitions("seg").mapInArrow(
        _probe(seg_bits), "h long, q int"), "ngram-levels")
    word = found.where("h % 2 = 0")
    seen = lambda q: F.when(F.col(q) <= 1, F.col(q)).otherwise(F.pow(F.lit(2.0), F.col(q) - 0.5))
    c2 = seen("q").cast("double")
    p = MIX * c2 / F.greatest(F.lit(1.0), seen("qb").cast("double"), c2) + (1.0 - MIX) * (seen("qw") + 1.0) / (
        total + words + 1.0)
    return materialize(asked.join(found, "h").join(word.toDF("word", "qw"), "word").join(
        word.toDF("before", "qb"), "before").select("h", "q", F.log10(p).alias("logp")), "ngram-pairs")


def _head(levels: dict[int, int]) -> int:
    """Least level from which on at most HEAD_WORDS n-grams are."""
    size, head = 0, 64
    for q, k in sorted(levels.items(), reverse=True):
        if size + k > HEAD_WORDS:
            break
        size, head = size + k, q
    return head


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and the second column, of HEAD_WORDS rows at most."""
    top = table.toArrow()
    h, x = (top.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], x[order]


def _find(h: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``h`` is a key, and its value or 0."""
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    known = keys[at] == h
    return known, np.where(known, values[at], 0)


class Model:
    """``bloom`` is a broadcast filter, or the most frequent bigrams (sorted
    hashes) and the logarithms of their probabilities."""

    def __init__(self, head_h: np.ndarray, head_n: np.ndarray, total: int, words: int,
                 bloom: Filter | tuple[np.ndarray, np.ndarray]):
        self.head_h, self.head_n, self.total, self.words, self.bloom = head_h, head_n, total, words, bloom
        self.floor = np.log10(total + words + 1)

    def score(self, part: T.Slice):
        """Per row: tokens, tokens known by the head, their base score, model
        score; and the tokens and bigrams the heads lack as (row, hash, times)."""
        one, two, off = tokens(part)
        lens = np.diff(off)
        row = np.repeat(np.arange(len(part)), lens)
        vocab, which = np.unique(one, return_inverse=True)
        in_head, exact = _find(vocab, self.head_h, self.head_n)
        base = np.where(in_head, np.log10(exact + 1.0) - self.floor, 0.0)
        known = in_head & (exact > 0)
        pairs, pair_of = np.unique(two, return_inverse=True)
        if isinstance(self.bloom, Filter):
            seen = self.bloom.counts(vocab)
            p1 = (seen + 1.0) / (self.total + self.words + 1.0)
            c2 = self.bloom.counts(pairs)[pair_of]
            c1 = np.empty(len(one))
            c1[1:] = seen[which[:-1]]
            c1[off[:-1]] = self.bloom.counts(np.array([END & ~_ONE]))[0]  # a text begins as often as it ends
            logp = np.log10(MIX * c2 / np.maximum(1.0, np.maximum(c1, c2)) + (1.0 - MIX) * p1[which])
            has_pair = np.ones(len(pairs), bool)
        else:
            has_pair, logp = _find(pairs, *self.bloom)
            logp = logp[pair_of]
        sums = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  no row is without tokens

        def lacking(names, of, found):
            rest = np.flatnonzero(~found[of])
            key, times = np.unique(row[rest] * len(names) + of[rest], return_counts=True)
            return key // max(1, len(names)), names[key % max(1, len(names))], times

        tail = [np.concatenate(x) for x in zip(lacking(vocab, which, in_head), lacking(pairs, pair_of, has_pair))]
        return lens, sums(known[which].astype(np.int64)), sums(base[which]), sums(logp), tail


_MODELS: list[tuple] = []


def _model(shared) -> Model:
    if not _MODELS or _MODELS[0][0] is not shared:
        head_h, head_n, total, words, bloom = shared.value
        if isinstance(bloom[0], bytes):
            bloom = Filter(np.frombuffer(bloom[0], np.uint8), bloom[1])
        _MODELS[:] = [(shared, Model(head_h, head_n, total, words, bloom))]
    return _MODELS[0][1]


def fit(train: DataFrame, docs: DataFrame):
    """Counts of all training texts (``text``): a broadcast model, the table
    (h, c, logp) of the words and bigrams of ``docs`` that it lacks, and the
    tokens and words counted."""
    spark = train.sparkSession
    found = train.select("text").mapInArrow(_count, "h long, n long")
    counts = materialize(found.groupBy("h").agg(F.sum("n").alias("n")), "ngram-counts")
    level = F.floor(F.log2("n")).cast("int") + 1
    table = counts.groupBy((F.col("h") % 2 == 0).alias("word"), level.alias("q")).agg(
        F.count("*").alias("k"), F.sum("n").alias("n")).collect()  # one row a level: at most 126
    total = sum(r["n"] for r in table if r["word"])
    words = sum(r["k"] for r in table if r["word"])
    levels: dict[int, int] = {}
    for r in table:
        levels[r["q"]] = levels.get(r["q"], 0) + r["k"]
    bits = _plan(levels)
    least = 1 << (min(63, _head({r["q"]: r["k"] for r in table if r["word"]})) - 1)  # of level q: 2**(q-1) at least
    rest = counts.where(f"h % 2 = 0 and n < {least}L").select(
        "h", F.col("n").alias("c"), F.lit(None).cast("double").alias("logp"))
    members = counts.select("h", level.alias("q"))
    if bits <= MAX_BITS:
        segments = materialize(members.repartition(F.expr(f"shiftrightunsigned(h, {64 - SEG_BITS})")).mapInArrow(
            _build(bits - SEG_BITS, 1), "seg int, data binary"), "ngram-filter")
        data = np.zeros((1 << bits) >> 3, dtype=np.uint8)
        size = (1 << (bits - SEG_BITS)) >> 3
        for r in segments.toLocalIterator():  # 2**MAX_BITS bits at most, some files at a time
            data[r["seg"] * size:(r["seg"] + 1) * size] |= np.frombuffer(r["data"], np.uint8)
        bloom: tuple = (data.tobytes(), bits)
        del data
    else:
        pairs = _pair_scores(docs, members, bits, total, words)
        head = _head({r["q"]: r["count"] for r in pairs.groupBy("q").count().collect()})  # one row a level
        bloom = _sorted(pairs.where(F.col("q") >= head).select("h", "logp"))
        rest = rest.unionByName(pairs.where(F.col("q") < head).select("h", F.lit(None).cast("long").alias("c"), "logp"))
    top = _sorted(counts.where(f"h % 2 = 0 and n >= {least}L"))
    shared = spark.sparkContext.broadcast((*top, total, words, bloom))
    return shared, rest, (total, words)


def held_out(id_col: str):
    return F.coalesce(F.expr(f"crc32(cast(cast(`{id_col}` as string) as binary)) % 7 = 2"), F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("held", held_out("id"))
    shared, rare, (total, words) = fit(own.where("not held"), own)
    floor = float(np.log10(total + words + 1))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = _model(shared)
        for batch in batches:
            for part in T.slices(batch.column(3), T.SLICE_BYTES // 2):
                lens, known, base, logp, (row, h, times) = model.score(part)
                at = pa.array(row)
                rows = batch.column(0).slice(part.first, len(part))
                none = lambda kind: pa.nulls(len(row), kind)
                # a document's own row has a key as well, an odd one that is spread: no key is shared by all
                own_key = T.mix(np.asarray(rows).view(np.uint64)) | _ONE
                both = lambda a, b: pa.concat_arrays([a, b])
                ids, held = (batch.column(k).slice(part.first, len(part)) for k in (1, 2))
                n = len(part)
                yield pa.RecordBatch.from_arrays([
                    both(rows, rows.take(at)), both(ids, none(ids.type)), both(held, none(pa.bool_())),
                    both(pa.array(own_key.view(np.int64)), pa.array(h.view(np.int64))),
                    both(pa.nulls(n, pa.int64()), pa.array(times.astype(np.int64))),
                    both(pa.array(lens.astype(np.int64)), none(pa.int64())),
                    both(pa.array(known), none(pa.int64())), both(pa.array(base), none(pa.float64())),
                    both(pa.array(logp), none(pa.float64()))],
                    names=["row", "id", "held", "h", "times", "n_tokens", "known", "base", "logp_row"])

    found = own.select(F.monotonically_increasing_id().alias("row"), "id", "held", "text").mapInArrow(
        run, f"row long, id {id_type}, held boolean, h long, times long, n_tokens long, known long, base double, logp_row double")
    joined = found.join(rare, "h", "left")
    # a token without count adds log10(1) - floor; bigrams (odd) have no part in the base score
    rest = F.expr(f"if(h % 2 = 0, times * (log10(coalesce(c, 0) + 1D) - {floor!r}D), 0D)")
    logp = F.coalesce("logp_row", F.expr("times * logp"), F.lit(0.0))  # a document's own row has logp_row
    return joined.groupBy("row").agg(
        F.max("id").alias(id_col), F.max("held").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(F.col("c") > 0, F.col("times")), F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.sum(F.coalesce("base", rest)).alias("base_score"), F.sum(logp).alias("score")).drop("row")
