"""Language identification by a bidirectional GRU over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled documents and labels every byte position; a document's
probabilities are the mean over the positions of its letters. It is broadcast
(some 100 KB) and runs on whole texts: a text is cut into windows that overlap
by a warm-up margin, and windows of many texts go through the network together.

Sample: about ``SAMPLE_DOCS`` documents per language, chosen by hash, of which
``SAMPLE_WINDOWS`` windows each are trained on. Only the fit is bounded; every
document is labelled from its whole text.

Defined results: ``und`` with score 0 for a text that is null or has no
letter, and for all texts when nothing can be learned; of equally probable
languages the first in alphabetical order; more than ``MAX_LANGS`` languages to
learn raise an error; repeated rows keep their multiplicity and are learned from
once; a document without id is not held out; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textops as T

HIDDEN = 8
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 4
TRAIN_BYTES = 64
STEPS = 300
BATCH = 128
RATE = 0.02
MAX_LANGS = 256
#: Bytes of a window whose labels count, and the warm-up at either side.
CORE, MARGIN = 224, 16
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_LETTER_BYTE = T.CLASSES["alnum"].copy()
_LETTER_BYTE[48:58] = False


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign x / (1 + abs x), in place: the network's bounded activation."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    """The same, moved to 0 .. 1, in place."""
    _squash(x)
    x *= 0.5
    x += 0.5
    return x


class BiGRU:
    """Weights per direction: byte table E, recurrence U; output V, c."""

    def __init__(self, n_out: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["E" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.p["V" + d] = rng.normal(0, 0.5, (hidden, n_out)).astype(np.float32)
        self.p["c"] = np.zeros(n_out, dtype=np.float32)

    # -- training -------------------------------------------------------
    def _run(self, x: np.ndarray, d: str):
        """All states of one direction over (time, rows) bytes."""
        H, E, U = self.hidden, self.p["E" + d], self.p["U" + d]
        h = np.zeros((x.shape[1], H), dtype=np.float32)
        kept = []
        for t in range(len(x)):
            a, u = E[x[t]], h @ U
            zr = _gate(a[:, :2 * H] + u[:, :2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = _squash(a[:, 2 * H:] + r * u[:, 2 * H:])
            new = n + z * (h - n)
            kept.append((h, z, r, n, u[:, 2 * H:]))
            h = new
        states = np.stack([k[0] for k in kept[1:]] + [h])
        return states, kept

    def _back(self, x: np.ndarray, d: str, kept, dstates: np.ndarray, grad: dict) -> None:
        """Backpropagation through time of one direction."""
        H, U = self.hidden, self.p["U" + d]
        dh = np.zeros_like(dstates[0])
        da_all = np.empty((*x.shape, 3 * H), dtype=np.float32)
        dU = np.zeros_like(U)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, un = kept[t]
            dh = dh + dstates[t]
            dan = dh * (1 - z) * (1 - np.abs(n)) ** 2
            daz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dar = dan * un * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            da_all[t] = np.concatenate([daz, dar, dan], axis=1)
            du = np.concatenate([daz, dar, dan * r], axis=1)
            dU += h.T @ du
            dh = dh * z + du @ U.T
        flat = x.ravel()
        hot = np.zeros((256, len(flat)), dtype=np.float32)
        hot[flat, np.arange(len(flat))] = 1
        grad["E" + d] = hot @ da_all.reshape(-1, 3 * H)
        grad["U" + d] = dU

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss of the labels ``y`` of rows at all positions of ``x`` (time,
        rows) with weights, and its gradients."""
        sf, kf = self._run(x, "f")
        sb, kb = self._run(x[::-1], "b")
        sb = sb[::-1]
        logits = sf @ self.p["Vf"] + sb @ self.p["Vb"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        rows = np.arange(x.shape[1])
        total = weight.sum()
        loss = float(-(np.log(prob[:, rows, y] + 1e-9) * weight).sum() / total)
        dl = prob.copy()
        dl[:, rows, y] -= 1
        dl *= (weight / total)[:, :, None]
        grad = {"c": dl.sum(axis=(0, 1))}
        H, K = self.hidden, dl.shape[2]
        grad["Vf"] = sf.reshape(-1, H).T @ dl.reshape(-1, K)
        grad["Vb"] = np.ascontiguousarray(sb).reshape(-1, H).T @ dl.reshape(-1, K)
        self._back(x, "f", kf, dl @ self.p["Vf"].T, grad)
        self._back(x[::-1], "b", kb, (dl @ self.p["Vb"].T)[::-1], grad)
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = 11) -> list[float]:
        """Adam over batches that hold the languages in equal parts."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(y == k) for k in range(len(self.p["c"]))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            which = rng.integers(0, len(by_class), BATCH)
            rows = np.array([rng.choice(by_class[k]) for k in which])
            loss, grad = self.gradients(x[:, rows], y[rows], weight[:, rows])
            losses.append(loss)
            rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                np.clip(g, -1, 1, out=g)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) /
                              (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return losses

    # -- labelling ------------------------------------------------------
    def logits(self, x: np.ndarray, active: np.ndarray, out: np.ndarray, d: str) -> None:
        """Add one direction's output to ``out`` (language, time, row). Rows
        are sorted by falling length: the first ``active[t]`` reach time t."""
        H = self.hidden
        parts = [np.ascontiguousarray(self.p[k + d][:, c]) for k in "EU" for c in (slice(0, 2 * H), slice(2 * H, None))]
        Eg, En, Ug, Un = parts
        V = np.ascontiguousarray(self.p["V" + d].T)
        h = np.zeros((x.shape[1], H), dtype=np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            k = active[t]
            own, byte = h[:k], x[t, :k]
            g = own @ Ug
            g += np.take(Eg, byte, axis=0)
            _gate(g)
            n = own @ Un
            n *= g[:, H:]
            n += np.take(En, byte, axis=0)
            _squash(n)
            own -= n
            own *= g[:, :H]
            own += n
            out[:, t, :k] += V @ own.T

    def label(self, part: T.Slice) -> np.ndarray:
        """Mean probabilities (row, language) over the letter positions of
        each row; zero rows where there is none."""
        K = len(self.p["c"])
        size = np.diff(part.offsets)
        per = -(-size // CORE)  # windows of each row
        row = np.repeat(np.arange(len(part)), per)
        sums = np.zeros((len(part), K))
        if not len(row):
            return sums
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        lo = part.offsets[row] + np.maximum(nth * CORE - MARGIN, 0)
        lens = part.offsets[row] + np.minimum((nth + 1) * CORE + MARGIN, size[row]) - lo
        core = part.offsets[row] + nth * CORE - lo
        stop = core + np.minimum(CORE, size[row] - nth * CORE)
        order = np.argsort(-lens, kind="stable")
        row, lo, lens, core, stop = (v[order] for v in (row, lo, lens, core, stop))
        time = np.arange(int(lens[0]))[:, None]
        active = np.searchsorted(-lens, -time[:, 0], side="left")  # rows longer than t
        x = part.data[np.minimum(lo + time, len(part.data) - 1)]
        z = np.zeros((K, *x.shape), dtype=np.float32)
        self.logits(x, active, z, "f")
        self.logits(x, active, z, "b")
        z += self.p["c"][:, None, None]
        np.clip(z, -30, 30, out=z)
        np.exp(z, out=z)
        valid = (time >= core) & (time < stop) & _LETTER_BYTE[x]
        z *= valid / z.sum(axis=0)
        counts = np.bincount(row, weights=valid.sum(axis=0), minlength=len(part))
        for k in range(K):
            sums[:, k] = np.bincount(row, weights=z[k].sum(axis=0, dtype=np.float64), minlength=len(part))
        return sums / np.maximum(counts, 1)[:, None]


def held_out(id_col: str):
    return F.coalesce(F.expr(f"crc32(cast(cast(`{id_col}` as string) as binary)) % 5 = 0"), F.lit(False))


def _windows(batches):
    """Up to SAMPLE_WINDOWS windows of each sampled text, evenly spread."""
    for batch in batches:
        langs, out = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode()
            room = max(0, len(data) - TRAIN_BYTES)
            for at in sorted({room * k // max(1, SAMPLE_WINDOWS - 1) for k in range(SAMPLE_WINDOWS)}):
                langs.append(lang)
                out.append(data[at:at + TRAIN_BYTES])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "data"])


def train(docs: DataFrame) -> tuple[list[str], BiGRU | None]:
    """Fit on ``docs`` (id, text, lang): the learned languages, the network."""
    known = docs.where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return [], None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_DOCS / n))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # equal rows are drawn together: one stands for them
    rows = known.where(draw < share[F.col("lang")]).dropDuplicates(["id", "text", "lang"]).select("lang", "text").mapInArrow(
        _windows, "lang string, data binary").collect()  # about SAMPLE_DOCS * SAMPLE_WINDOWS a language
    langs = sorted(counts)
    rows = sorted((langs.index(r["lang"]), bytes(r["data"])) for r in rows if _LETTER_BYTE[np.frombuffer(r["data"], np.uint8)].any())
    langs = [x for k, x in enumerate(langs) if any(r[0] == k for r in rows)]
    if not rows:
        return [], None
    order = sorted({r[0] for r in rows})
    y = np.array([order.index(r[0]) for r in rows])
    x = np.zeros((len(rows), TRAIN_BYTES), dtype=np.uint8)
    weight = np.zeros((len(rows), TRAIN_BYTES), dtype=np.float32)
    for i, (_, data) in enumerate(rows):
        own = np.frombuffer(data, np.uint8)
        x[i, :len(own)] = own
        weight[i, :len(own)] = _LETTER_BYTE[own]
    net = BiGRU(len(langs))
    net.fit(np.ascontiguousarray(x.T), y, np.ascontiguousarray(weight.T))
    return langs, net


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             whole_rows: bool = False) -> DataFrame:
    """Per document: ``id_col`` (or, with ``whole_rows``, the input row as a
    struct ``row``), held_out, lang_pred, score."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                      F.col(text_col).cast("string").alias("text"),
                      F.col(lang_col).cast("string").alias("lang")).withColumn("held", held_out("id"))
    langs, net = train(own.where("not held"))
    shared = docs.sparkSession.sparkContext.broadcast((langs, net))
    first = "row" if whole_rows else id_col
    kind = (docs.schema if whole_rows else docs.schema[id_col].dataType)
    schema = T.output_schema([(first, kind), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")])
    names = schema.names

    def run(batches):
        langs, net = shared.value
        for batch in batches:
            texts = batch.column(0).field(text_col).cast(pa.string()) if whole_rows else batch.column(2)
            for part in T.slices(texts, 1 << 20):
                lettered = np.array([bool(_LETTER.search(part.text(i).decode("utf-8", "replace")))
                                     for i in range(len(part))], dtype=bool)
                if net is None:
                    best, score = np.zeros(len(part), int), np.zeros(len(part))
                    lettered[:] = False
                else:
                    prob = net.label(part)
                    best = prob.argmax(axis=1)
                    score = np.clip(prob[np.arange(len(part)), best], 0.0, 1.0)
                pred = [langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)), batch.column(1).slice(part.first, len(part)),
                     pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=names)

    return own.select(*(("row", "held") if whole_rows else ("id", "held", "text"))).mapInArrow(run, schema)
