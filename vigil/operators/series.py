"""Ordered series that stay parallel.

The reference addresses a series by row position: ``rolling(w)``, ``shift(L)``,
``bfill`` and the 80/20 split all count rows of the time-sorted table. The
obvious Spark translation, ``Window.partitionBy(key).orderBy(ts)``, sends a
whole series to one task, and one hot key (or an unkeyed table) then decides
the runtime and the memory of the job.

Here a series longer than ``chunk_rows / 2`` is cut into chunks of about
``chunk_rows`` rows. Every chunk also receives, as *halo* rows, the ``back``
rows that precede it and the ``forward`` rows that follow it, so any ROWS
frame, lag or lead whose reach is within those bounds sees exactly the rows it
would see in one big partition. Windows then run on
``partitionBy(keys, _chunk)`` and the halo copies are dropped afterwards.

The cut points come from a small table: rows are counted per
(key, order-bucket), and cumulative counts over that table give each bucket
its first row position. Buckets are sized from per-key statistics to hold
about ``chunk_rows / 8`` rows and are split again when one is too dense. All
of it is aggregation and broadcast-or-shuffle joins of tables whose size is
counted before it is broadcast; nothing is collected except scalars and the
ids of over-dense keys.

Short series (the common case of many keys) skip the machinery: they form a
single chunk with no halo, which is exactly ``partitionBy(keys)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import materialize

UNB = Window.unboundedPreceding
UNF = Window.unboundedFollowing
_K0 = "_k0"
_K1 = "_k1"
COARSE = 1024
INTERNAL = ("_chunk", "_halo", "_bstart", "_kn", _K0, _K1)


@dataclass(frozen=True)
class SeriesSpec:
    """How rows form series: grouping keys, a total order and window reach."""
    keys: tuple[str, ...] = ()
    order: str = "timestamp"
    tiebreak: str | None = "event_id"
    back: int = 240
    forward: int = 0
    chunk_rows: int = 50_000
    bucket_rows: int | None = None
    max_broadcast_rows: int = 2_000_000

    @property
    def order_cols(self) -> list[str]:
        return [self.order] + ([self.tiebreak] if self.tiebreak else [])

    def with_reach(self, back: int | None = None, forward: int | None = None) -> "SeriesSpec":
        return replace(self, back=self.back if back is None else back,
                       forward=self.forward if forward is None else forward)


def order_value(df: DataFrame, col: str) -> Column:
    """A numeric expression that is monotone in ``col``'s sort order."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)").cast("double")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(col)).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(col)).cast("double")
    if isinstance(dt, T.NumericType):
        return F.col(col).cast("double")
    raise TypeError(f"cannot order series by {col}: {dt}")


def _maybe_broadcast(df: DataFrame, n_rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= limit else df


@dataclass
class Framed:
    """Rows of the input plus halo copies, ready for chunk-local windows."""
    df: DataFrame
    spec: SeriesSpec
    keys: list[str] = field(default_factory=list)

    @property
    def window(self) -> Window:
        return Window.partitionBy(*self.keys, "_chunk").orderBy(*self.spec.order_cols)

    def idx(self) -> Column:
        """0-based row position of the row in its whole series."""
        whole = self.window.rowsBetween(UNB, UNF)
        return (F.row_number().over(self.window) - 1 + F.min("_bstart").over(whole)).cast("long")

    def length(self) -> Column:
        """Number of rows of the row's whole series."""
        whole = self.window.rowsBetween(UNB, UNF)
        return F.coalesce(F.col("_kn"), F.count(F.lit(1)).over(whole)).cast("long")

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop halo copies and the helper columns."""
        out = df.filter(F.col("_halo") == 0)
        return out.drop(*[c for c in INTERNAL if c in out.columns])


def _with_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, keys
    return df.withColumn(_K0, F.lit(0)), [_K0]


def _null_safe(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Keys that equi-joins can match: a null key becomes a helper column."""
    if not any(df.schema[k].nullable for k in keys):
        return df, keys
    return df.withColumn(_K1, F.to_json(F.struct(*keys))), [_K1]


def frame_series(df: DataFrame, spec: SeriesSpec) -> Framed:
    """Assign each row (and its halo copies) to a bounded chunk of its series."""
    C = spec.chunk_rows
    reach = max(spec.back, spec.forward)
    if C < 2 * reach + 2:
        raise ValueError(f"chunk_rows={C} must be at least 2*reach+2 ({2 * reach + 2})")
    half = C // 2
    bucket_rows = spec.bucket_rows or max(1, C // 8)
    df, keys = _with_key(df, list(spec.keys))
    df, keys = _null_safe(df, keys)
    ov = order_value(df, spec.order)

    # Per-key statistics; only keys longer than half a chunk are cut.
    odt = df.schema[spec.order].dataType
    integral = isinstance(odt, (T.TimestampNTZType, T.TimestampType, T.DateType, T.IntegralType))
    tb_numeric = bool(spec.tiebreak) and isinstance(df.schema[spec.tiebreak].dataType, T.NumericType)
    tv = F.col(spec.tiebreak).cast("double") if tb_numeric else F.lit(0.0)
    heavy = (df.groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("_kn"), F.min(ov).alias("_lo"), F.max(ov).alias("_hi"),
                  F.min(tv).alias("_tlo"), F.max(tv).alias("_thi"))
             .filter(F.col("_kn") > half)
             # one step below the least value is the place of rows without one (nulls sort first)
             .withColumn("_hi", F.coalesce("_hi", F.lit(0.0))).withColumn("_lo", F.coalesce("_lo", F.lit(0.0)) - 1.0)
             .withColumn("_thi", F.coalesce("_thi", F.lit(0.0))).withColumn("_tlo", F.coalesce("_tlo", F.lit(0.0)) - 1.0)
             .withColumn("_w", (F.col("_hi") - F.col("_lo") + 1.0) * F.lit(float(bucket_rows)) / F.col("_kn"))
             .withColumn("_tw", F.lit(None).cast("double"))
             .select(*keys, "_kn", "_lo", "_w", "_tlo", "_thi", "_tw")
             .persist())
    n_heavy = heavy.count()
    if n_heavy == 0:
        heavy.unpersist()
        framed = df.select("*", F.lit(0).alias("_chunk"), F.lit(0).alias("_halo"),
                           F.lit(0).cast("long").alias("_bstart"), F.lit(None).cast("long").alias("_kn"))
        return Framed(framed, spec, keys)

    # Bucket = (time bucket, tie-break sub-bucket). The sub-bucket is used
    # only once a key's time buckets are down to single timestamps, so
    # ordering buckets by (_b, _b2) still follows (order, tiebreak).
    bexpr = F.floor((F.coalesce("_ov", "_lo") - F.col("_lo")) / F.col("_w")).cast("long")
    b2expr = F.when(F.col("_tw").isNotNull(),
                    F.floor((F.coalesce("_tv", "_tlo") - F.col("_tlo")) / F.col("_tw"))).otherwise(F.lit(0)).cast("long")
    for _attempt in range(12):
        hb = _maybe_broadcast(heavy, n_heavy, spec.max_broadcast_rows)
        bt = (df.select(*keys, ov.alias("_ov"), tv.alias("_tv")).join(hb, keys)
              .groupBy(*keys, bexpr.alias("_b"), b2expr.alias("_b2")).agg(F.count(F.lit(1)).alias("_n"))
              .persist())
        dense = (bt.groupBy(*keys).agg(F.max("_n").alias("_mx"))
                 .filter(F.col("_mx") > half)
                 .withColumn("_f", F.ceil(F.col("_mx") * 8.0 / F.lit(float(half))).cast("double")))
        n_dense = dense.count()
        if n_dense == 0:
            break
        # New widths computed in Spark (no per-key list on the driver): shrink
        # the time width; once a key's buckets are single timestamps, split by
        # the tiebreak; once split by tiebreak, shrink that width.
        j = heavy.join(_maybe_broadcast(dense, n_dense, spec.max_broadcast_rows), keys, "left")
        is_dense = F.col("_f").isNotNull()
        to_tie = F.col("_tw").isNull() & F.lit(integral and tb_numeric) & (F.col("_w") <= 1.0)
        new_tw = (F.when(~is_dense, F.col("_tw"))
                  .when(F.col("_tw").isNotNull(), F.col("_tw") / F.col("_f"))
                  .when(to_tie, (F.col("_thi") - F.col("_tlo") + 1.0) * F.lit(float(bucket_rows)) / F.col("_kn")))
        new_w = F.when(is_dense & F.col("_tw").isNull() & ~to_tie, F.col("_w") / F.col("_f")).otherwise(F.col("_w"))
        # written to the shared folder: cuts the lineage, which would otherwise
        # nest one more join per refinement round
        new_heavy = materialize(j.withColumn("_stuck", is_dense & new_tw.isNull() & (new_w <= F.lit(1e-9)))
                                .withColumn("_tw", new_tw).withColumn("_w", new_w)
                                .drop("_mx", "_f"), "series-widths")
        stuck = new_heavy.filter(F.col("_stuck")).limit(1).count()
        if stuck or _attempt == 11:
            raise ValueError("cannot split a run of equal (order, tiebreak) values below chunk_rows/2; "
                             "use a unique numeric tiebreak or raise chunk_rows")
        bt.unpersist()
        heavy.unpersist()
        heavy = new_heavy.drop("_stuck").persist()

    # Row positions of buckets: a two-level prefix sum, so no window partition
    # holds more than COARSE buckets (coarse totals per key are n/C·8/COARSE
    # rows, fine offsets are bounded by COARSE).
    bt = bt.withColumn("_cb", F.floor(F.col("_b") / F.lit(COARSE)).cast("long"))
    coarse = bt.groupBy(*keys, "_cb").agg(F.sum("_n").alias("_cn"))
    wcb = Window.partitionBy(*keys).orderBy("_cb").rowsBetween(UNB, -1)
    coarse = coarse.select(*keys, "_cb", F.coalesce(F.sum("_cn").over(wcb), F.lit(0)).alias("_coff"))
    wk = Window.partitionBy(*keys, "_cb").orderBy("_b", "_b2").rowsBetween(UNB, -1)
    bt2 = (bt.join(coarse, keys + ["_cb"])
           .withColumn("_start", (F.col("_coff") + F.coalesce(F.sum("_n").over(wk), F.lit(0))).cast("long"))
           .withColumn("_end", F.col("_start") + F.col("_n"))
           .withColumn("_chunk", F.floor(F.col("_start") / F.lit(C)).cast("int")))
    # Every bucket holds at most C/2 rows, so chunk ids are contiguous and a
    # chunk's neighbours are chunk ± 1: equi-joins instead of lead/lag.
    ct = bt2.groupBy(*keys, "_chunk").agg(F.min("_start").alias("_S"))
    nxt = ct.select(*keys, (F.col("_chunk") - 1).alias("_chunk"), F.col("_chunk").alias("_nchunk"),
                    F.col("_S").alias("_nS"))
    prv = ct.select(*keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("_chunk").alias("_pchunk"))
    ct = ct.join(nxt, keys + ["_chunk"], "left").join(prv, keys + ["_chunk"], "left")
    bt3 = bt2.join(ct, keys + ["_chunk"])
    tgt = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("h", T.IntegerType())])
    home = F.struct(F.col("_chunk").alias("c"), F.lit(0).alias("h"))
    parts = [home]
    if spec.back > 0:
        parts.append(F.when(F.col("_nchunk").isNotNull() & (F.col("_end") > F.col("_nS") - spec.back),
                            F.struct(F.col("_nchunk").alias("c"), F.lit(1).alias("h"))))
    if spec.forward > 0:
        parts.append(F.when(F.col("_pchunk").isNotNull() & (F.col("_start") < F.col("_S") + spec.forward),
                            F.struct(F.col("_pchunk").alias("c"), F.lit(1).alias("h"))))
    targets = F.filter(F.array(*parts).cast(T.ArrayType(tgt)), lambda x: x.isNotNull())
    buckets = bt3.select(*keys, "_b", "_b2", F.col("_start").alias("_bstart"), targets.alias("_tg")).persist()
    n_buckets = buckets.count()
    bt.unpersist()

    heavy_info = heavy.select(*keys, "_kn", "_lo", "_w", "_tlo", "_tw")
    data = df.join(_maybe_broadcast(heavy_info, n_heavy, spec.max_broadcast_rows), keys, "left")
    data = (data.withColumn("_ov", ov).withColumn("_tv", tv)
            .withColumn("_b", F.when(F.col("_w").isNotNull(), bexpr))
            .withColumn("_b2", F.when(F.col("_w").isNotNull(), b2expr)))
    data = data.join(_maybe_broadcast(buckets, n_buckets, spec.max_broadcast_rows), keys + ["_b", "_b2"], "left")
    default = F.array(F.struct(F.lit(0).alias("c"), F.lit(0).alias("h"))).cast(T.ArrayType(tgt))
    data = (data.withColumn("_t", F.explode(F.coalesce(F.col("_tg"), default)))
            .withColumn("_chunk", F.col("_t.c"))
            .withColumn("_halo", F.col("_t.h"))
            .withColumn("_bstart", F.coalesce(F.col("_bstart"), F.lit(0)).cast("long"))
            .drop("_t", "_tg", "_b", "_b2", "_ov", "_tv", "_lo", "_w", "_tlo", "_tw"))
    return Framed(data, spec, keys)


def row_index(df: DataFrame, spec: SeriesSpec, idx_col: str = "row_idx",
              n_col: str | None = "series_rows") -> DataFrame:
    """Global 0-based position of each row within its series (and the series
    length), exact and without a single-task window."""
    framed = frame_series(df, spec.with_reach(0, 0))
    cols = [F.col(c) for c in framed.df.columns]
    cols.append(framed.idx().alias(idx_col))
    if n_col:
        cols.append(framed.length().alias(n_col))
    return framed.finish(framed.df.select(*cols))


def running_totals(df: DataFrame, order: str, sum_cols: list[str], descending: bool = False,
                   bucket_rows: int = 250_000, groups: Sequence[str] = (), prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in the order of ``order``, per
    combination of ``groups`` (none: over the whole table). ``order`` must be
    unique within a group (group first).

    Rows are cut into value buckets whose totals give each bucket its offset,
    so no task holds more than a bucket of a group."""
    df = materialize(df, "running-totals")  # counted, cut and summed below: computed once
    n = df.count()
    ordered = F.col(order).desc() if descending else F.col(order).asc()
    groups = list(groups)
    from pyspark.ml.feature import Bucketizer

    # Equal-count value buckets from approximate quantiles (a bounded list of
    # split points); a value always falls into exactly one bucket.
    nb = max(2, math.ceil(n / bucket_rows))
    probs = [i / nb for i in range(1, nb)]
    cuts = sorted(set(df.approxQuantile(order, probs, 1.0 / (4 * nb))))
    splits = [-math.inf] + cuts + [math.inf]
    data = Bucketizer(splits=splits, inputCol="_ov", outputCol="_bk").transform(
        df.withColumn("_ov", F.col(order).cast("double"))).drop("_ov")
    nbk = len(splits) - 1
    bcol = (F.lit(nbk - 1) - F.col("_bk")) if descending else F.col("_bk")
    data = data.withColumn("_b", bcol.cast("long")).drop("_bk")
    # bucket offsets by a two-level prefix sum (no window over all buckets)
    tot = (data.groupBy(*groups, "_b").agg(*[F.sum(c).alias("_t_" + c) for c in sum_cols])
           .withColumn("_cb", F.floor(F.col("_b") / F.lit(COARSE))))
    ctot = tot.groupBy(*groups, "_cb").agg(*[F.sum("_t_" + c).alias("_ct_" + c) for c in sum_cols])
    wcb = Window.partitionBy(*groups).orderBy("_cb").rowsBetween(UNB, -1)
    ctot = ctot.select(*groups, "_cb", *[F.coalesce(F.sum("_ct_" + c).over(wcb), F.lit(0)).alias("_co_" + c)
                                         for c in sum_cols])
    wb = Window.partitionBy(*groups, "_cb").orderBy("_b").rowsBetween(UNB, -1)
    offs = tot.join(ctot, [*groups, "_cb"]).select(
        *groups, "_b", *[(F.col("_co_" + c) + F.coalesce(F.sum("_t_" + c).over(wb), F.lit(0))).alias("_o_" + c)
                         for c in sum_cols])
    data = data.join(offs, [*groups, "_b"])
    w = Window.partitionBy(*groups, "_b").orderBy(ordered).rowsBetween(UNB, 0)
    return data.select(*[F.col(c) for c in df.columns],
                       *[(F.sum(c).over(w) + F.col("_o_" + c)).alias(prefix + c) for c in sum_cols])
