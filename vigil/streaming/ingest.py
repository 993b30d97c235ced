"""Incremental ingest of several sources: quality gate, keyed merge, features of
the touched ranges.

Every micro-batch of a source is checked row by row. Rows that break a rule go
to the source's rejected table with the names of the rules; a batch with too
large a share of them fails the gate and is not taken (its files stay to be read
again). The others are merged by key into the source's table, which is
partitioned by day (or a longer span): the touched days are written anew
(dynamic overwrite), the newest row of a key stays. A batch that is played again
changes nothing.

A key has to stay in its day (span). Of rows of one key in one batch, the one of the
latest time stays (of equal ones one by its hash).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators import features as fe
from vigil.operators.series import row_index
from vigil.session import held, materialize
from vigil.sources.panel import ops_panel
from vigil.streaming.live import PAST, run_to_end


class GateFailed(ValueError):
    """A batch has too many rows that break a rule, or a source gave none."""


@dataclass(frozen=True)
class Source:
    name: str
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    time: str
    #: Rule name -> SQL condition that a good row meets (null counts as broken).
    rules: dict[str, str] = field(default_factory=dict)
    #: Largest share of broken rows of a batch that passes.
    most_rejected: float = 0.05
    #: What a partition of the table spans: day, month or year.
    span: str = "day"


#: Rows of a file that a merge writes, about.
FILE_ROWS = 1 << 21


def checked(rows: DataFrame, source: Source) -> DataFrame:
    """Adds ``broken``: the names of the rules that a row breaks."""
    rules = {"key": " and ".join(f"`{c}` is not null" for c in source.key), "time": f"`{source.time}` is not null", **source.rules}
    marks = [F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()]
    return rows.withColumn("broken", F.array_compact(F.array(*marks)))


def stored(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def merge(spark: SparkSession, rows: DataFrame, path: str, key: Sequence[str], time: str, span: str = "day",
          spans: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Put ``rows`` into the table by key; returns the days written. ``spans``
    has the times of the rows where they cost less to find than in ``rows``;
    ``once`` says that ``rows`` hold a key of a day once: they are written as
    they lie while the table has no row of their days.

    Rows are shuffled once, by day and a part of the keys, which is also the file
    they go to. Written days are put in place when the job ends, so the job reads
    the rows before from the table itself."""
    order = [F.desc("fresh"), F.desc(time), F.xxhash64(*rows.columns)]
    day = F.to_date(F.date_trunc(span, time)).alias("day")
    new = rows.withColumn("day", day)
    days = materialize((rows if spans is None else spans).select(day).distinct(), "ingest-days")
    old = stored(spark, path)
    if old is not None:
        old = old.join(F.broadcast(days), "day", "left_semi")  # a row a day of one batch
        old = None if old.isEmpty() else old
    if old is not None or not once:
        n = (rows if spans is None else spans).count()
        new = new.withColumn("fresh", F.lit(1))
        if old is not None:
            n += old.count()
            new = new.unionByName(old.withColumn("fresh", F.lit(0)).select(*new.columns))
        file = F.pmod(F.xxhash64(*key), F.lit(1 + n // FILE_ROWS))  # a large day goes to several files
        dealt = new.withColumn("file", file).repartition("day", "file")
        one = dealt.withColumn("k", F.row_number().over(Window.partitionBy("day", "file", *key).orderBy(*order))).where("k = 1")
        new = one.drop("k", "file", "fresh")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return days


def ingest(spark: SparkSession, source: Source, base: str, max_files_per_trigger: int | None = None, after=None) -> DataFrame:
    """Take what is new in a source and return its table. ``after(rows)`` runs on
    the accepted rows of each micro-batch, once they are merged."""
    reader = spark.readStream.schema(source.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    table = f"{base}/{source.name}/table"

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = checked(batch, source)  # read from its files again by each job
        bad = rows.where(F.size("broken") > 0)
        n, broken = rows.agg(F.count("*"), F.count_if(F.size("broken") > 0)).first()
        if broken > source.most_rejected * n:
            raise GateFailed(f"{source.name}: {broken} of {n} rows break a rule")
        bad.write.mode("overwrite").parquet(f"{base}/{source.name}/rejected/batch_id={batch_id}")
        good = rows.where(F.size("broken") == 0).drop("broken")
        if n > broken:
            merge(spark, good, table, source.key, source.time, source.span)
            if after:
                after(good)

    run_to_end(reader.parquet(source.path).writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{base}/{source.name}/checkpoint"))
    out = stored(spark, table)
    if out is None:
        raise GateFailed(f"{source.name} is empty after ingestion")
    return out


def touched_features(spark: SparkSession, base: str, events: str):
    """Feature update after a batch of events: a row changes the frames of the
    ``PAST`` rows after it, which need the ``PAST`` rows before them. Only these
    stretches of the touched series are read, by day, and computed anew."""
    path = f"{base}/features"

    def update(good: DataFrame) -> None:
        new = good.groupBy(F.col("event_type").alias("service")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        rows = spark.read.parquet(events)
        # days that hold PAST rows before the first and 2 * PAST after the last touched row
        days = rows.groupBy(F.col("event_type").alias("service"), "day").count().join(new, "service")
        before = Window.partitionBy("service").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
        behind = Window.partitionBy("service").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        first, last = F.col("day") >= F.to_date("lo"), F.col("day") <= F.to_date("hi")
        days = days.withColumn("a", F.coalesce(F.sum(F.when(~first, F.col("count")).otherwise(0)).over(before), F.lit(0)))
        days = days.withColumn("b", F.coalesce(F.sum(F.when(~last, F.col("count")).otherwise(0)).over(behind), F.lit(0)))
        days = days.where((first | (F.col("a") < PAST)) & (last | (F.col("b") < 2 * PAST)))
        near = rows.join(F.broadcast(days.select(F.col("service").alias("event_type"), "day")), ["event_type", "day"], "left_semi")
        panel = row_index(ops_panel(near), fe.default_spec(), "pos", None)
        ids = good.select("event_id").distinct()
        ends = panel.join(ids, "event_id", "left_semi").groupBy("service").agg(F.min("pos").alias("p"), F.max("pos").alias("q"))
        stretch = panel.join(ends, "service").where(f"pos between p - {PAST} and q + {PAST}")
        # rows before the first touched one keep their frames; near a series' begin its length counts as well
        changed = f"pos >= if(p <= {PAST}, 0, p)"
        with held(stretch, "ingest-stretch") as stretch:
            framed = fe.feat_full(stretch, fe.default_spec()).where(changed)
            # the table of events holds a key of a day once, and so do its frames
            merge(spark, framed.drop("pos", "p", "q"), path, ("service", "event_id"), "timestamp",
                  spans=stretch.where(changed), once=True)
    return update
