"""Vectorised row-frame statistics for one chunk of one series.

Spark partitions the work (``series.frame_series``: bounded chunks plus halo
rows, one shuffle) and ``applyInPandas`` hands each chunk to ``run_kernel``,
which evaluates ROWS-frame statistics with numpy: every frame statistic is
``w`` vector passes (one per frame offset) instead of Spark's per-row
re-aggregation of sliding frames. The sorted chunk is passed in slices of
``SLICE_ROWS`` rows with the rows their frames reach, so a worker holds the
input columns of a chunk but the statistics of one slice only.

Frame sums are accumulated oldest row first and moments use the same online
update as Spark's ``avg`` / ``stddev_samp`` / ``covar_samp``, so results
agree with the window-expression engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

SLICE_ROWS = 16_384  # rows whose statistics a worker holds at a time


@dataclass(frozen=True)
class Stat:
    """One output column: ``kind`` over the ROWS frame [lo, hi] of ``col``."""
    name: str
    kind: str          # mean | std | max | min | count | covar | lag | first | idx | len
    col: str = ""
    lo: int = 0
    hi: int = 0
    col2: str = ""


def _shift(x: np.ndarray, k: int) -> np.ndarray:
    """Value k rows earlier (k > 0) or later (k < 0); NaN outside."""
    out = np.full(len(x), np.nan)
    if k == 0:
        out[:] = x
    elif k > 0:
        if k < len(x):
            out[k:] = x[:-k]
    else:
        k = -k
        if k < len(x):
            out[:-k] = x[k:]
    return out


def _frame_offsets(lo: int, hi: int) -> range:
    """Offsets of the frame [lo, hi] from the oldest row to the newest."""
    return range(-lo, -hi - 1, -1)


def _offsets(lo: int, hi: int, n: int):
    """(k, rows) pairs for the frame [lo, hi], oldest offset first: at offset
    k row i reads row i − k, so the update touches rows max(k,0)..n+min(k,0)."""
    for k in _frame_offsets(lo, hi):
        if k >= 0:
            if k < n:
                yield k, slice(k, n), slice(0, n - k)
        elif -k < n:
            yield k, slice(0, n + k), slice(-k, n)


def _welford(x: np.ndarray, lo: int, hi: int):
    m = len(x)
    n = np.zeros(m)
    avg = np.zeros(m)
    m2 = np.zeros(m)
    nan = np.isnan(x)
    has_nan = bool(nan.any())
    for _k, dst, src in _offsets(lo, hi, m):
        v = x[src]
        if has_nan:
            ok = ~nan[src]
            new_n = n[dst] + ok
            delta = np.where(ok, v - avg[dst], 0.0)
            delta_n = delta / np.maximum(new_n, 1.0)
        else:
            new_n = n[dst] + 1.0
            delta = v - avg[dst]
            delta_n = delta / new_n
        avg[dst] += delta_n
        m2[dst] += delta * (delta - delta_n)
        n[dst] = new_n
    return n, avg, m2


def frame_mean(x, lo, hi):
    m = len(x)
    s = np.zeros(m)
    n = np.zeros(m)
    nan = np.isnan(x)
    x0 = np.where(nan, 0.0, x)
    ok = (~nan).astype(float)
    for _k, dst, src in _offsets(lo, hi, m):
        s[dst] += x0[src]
        n[dst] += ok[src]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, s / np.where(n > 0, n, 1.0), np.nan)


def frame_std(x, lo, hi):
    n, _, m2 = _welford(x, lo, hi)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 1, np.sqrt(m2 / np.where(n > 1, n - 1.0, 1.0)), np.nan)


def frame_extreme(x, lo, hi, fn):
    m = len(x)
    out = np.full(m, np.nan)
    for _k, dst, src in _offsets(lo, hi, m):
        cur, v = out[dst], x[src]
        out[dst] = np.where(np.isnan(cur), v, np.where(np.isnan(v), cur, fn(cur, v)))
    return out


def frame_count(x, lo, hi):
    m = len(x)
    n = np.zeros(m)
    ok = (~np.isnan(x)).astype(float)
    for _k, dst, src in _offsets(lo, hi, m):
        n[dst] += ok[src]
    return n


def frame_covar(x, y, lo, hi):
    m = len(x)
    n = np.zeros(m)
    xa = np.zeros(m)
    ya = np.zeros(m)
    ck = np.zeros(m)
    bad = np.isnan(x) | np.isnan(y)
    for _k, dst, src in _offsets(lo, hi, m):
        ok = ~bad[src]
        vx, vy = np.where(ok, x[src], 0.0), np.where(ok, y[src], 0.0)
        new_n = n[dst] + ok
        div = np.maximum(new_n, 1.0)
        dx = np.where(ok, vx - xa[dst], 0.0)
        dy = np.where(ok, vy - ya[dst], 0.0)
        xa[dst] += dx / div
        ya[dst] += dy / div
        ck[dst] += np.where(ok, dx * (vy - ya[dst]), 0.0)
        n[dst] = new_n
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 1, ck / np.where(n > 1, n - 1.0, 1.0), np.nan)


def _reach(stats: list[Stat]) -> tuple[int, int]:
    """Rows before and after a row that its statistics read."""
    frames = [s for s in stats if s.kind in ("mean", "std", "max", "min", "count", "covar")]
    lags = [s.lo for s in stats if s.kind == "lag"]
    back = max([0, *(-s.lo for s in frames), *lags])
    return back, max([0, *(s.hi for s in frames), *(-k for k in lags)])


def run_kernel(pdf: pd.DataFrame, order: list[str], stats: list[Stat]) -> Iterator[pd.DataFrame]:
    """Sort one chunk by the series order and append the requested columns;
    the rows come in slices, in order."""
    pdf = pdf.sort_values(order, kind="mergesort", ignore_index=True)
    m = len(pdf)
    if not m:
        return
    base = int(pdf["_bstart"].min())
    kn = pdf["_kn"].iloc[0]
    length = int(kn) if pd.notna(kn) else m
    back, ahead = _reach(stats)
    step = max(SLICE_ROWS, 4 * (back + ahead))
    whole: dict[str, np.ndarray] = {}

    def col(c: str) -> np.ndarray:
        if c not in whole:
            whole[c] = pdf[c].to_numpy(dtype=float, na_value=np.nan)
        return whole[c]

    def part(a: int, b: int) -> pd.DataFrame:
        lo, hi = max(a - back, 0), min(b + ahead, m)
        out = {}
        for s in stats:
            if s.kind == "idx":
                out[s.name] = np.arange(a, b, dtype=np.int64) + base
            elif s.kind == "len":
                out[s.name] = np.full(b - a, length, dtype=np.int64)
            elif s.kind == "first":
                out[s.name] = np.full(b - a, col(s.col)[0])
            else:
                out[s.name] = _statistic(s, col(s.col)[lo:hi], col(s.col2)[lo:hi] if s.col2 else None)[a - lo:b - lo]
        rows = pdf.iloc[a:b].reset_index(drop=True)
        return pd.concat([rows, pd.DataFrame(out, index=rows.index)], axis=1)

    for a in range(0, m, step):
        yield part(a, min(a + step, m))


def _statistic(s: Stat, x: np.ndarray, y: np.ndarray | None) -> np.ndarray:
    if s.kind == "mean":
        return frame_mean(x, s.lo, s.hi)
    if s.kind == "std":
        return frame_std(x, s.lo, s.hi)
    if s.kind == "max":
        return frame_extreme(x, s.lo, s.hi, np.maximum)
    if s.kind == "min":
        return frame_extreme(x, s.lo, s.hi, np.minimum)
    if s.kind == "count":
        return frame_count(x, s.lo, s.hi)
    if s.kind == "covar":
        return frame_covar(x, y, s.lo, s.hi)
    if s.kind == "lag":
        return _shift(x, s.lo)
    raise ValueError(s.kind)


def run_stats(df, spec, stats: list[Stat]):
    """Frame the series into bounded chunks (one shuffle) and evaluate
    ``stats`` per chunk with ``run_kernel``; halo copies are dropped."""
    from pyspark.sql import types as T

    from vigil.operators.series import frame_series
    fr = frame_series(df, spec)
    fields = list(fr.df.schema.fields)
    for s in stats:
        dt = T.LongType() if s.kind in ("idx", "len") else T.DoubleType()
        fields.append(T.StructField(s.name, dt, True))
    schema = T.StructType(fields)
    order = spec.order_cols

    def per_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return run_kernel(pd.concat(batches, ignore_index=True), order, stats)

    res = fr.df.groupBy(*fr.keys, "_chunk").applyInPandas(per_chunk, schema)
    return fr.finish(res)
