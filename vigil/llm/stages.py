"""The pipeline's stages: each applies one operator and acts on its result.

Where ids may repeat or be null, rows are named by their place in one scan and
written with their names before they are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.batches import small_batches
from vigil.session import materialize

#: Least mean probability of the best language.
MIN_LANGUAGE_SCORE = 0.3
#: Rows to leave out that are broadcast; more are left out by a shuffled join.
MAX_BROADCAST_ROWS = 1 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without
    letters and those of no clear language go."""
    from vigil.llm.langid import UNKNOWN, identify
    small_batches(spark)
    seen = identify(docs, whole_rows=True)
    return seen.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one of the smallest id (null ids
    last; of rows that share it, the first). Documents without words all stay."""
    from vigil.llm.jaccard import join
    small_batches(spark)
    at = f"row_{uuid.uuid4().hex}"
    # written once: the names follow how the scan is cut, which differs between scans
    named = materialize(docs.withColumn(at, F.monotonically_increasing_id()), "pipeline-named")
    groups = materialize(join(named, row_col=at).where("comp is not null").select("comp", "doc_id", "row"), "pipeline-groups")
    # of a component the row of the smallest id (null last), of these the first
    first = groups.groupBy("comp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("first"))
    gone = groups.join(first, "comp").where("row != first.row").select(F.col("row").alias(at))
    gone = materialize(gone, "pipeline-gone")
    small = gone.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return named.join(F.broadcast(gone) if small else gone, at, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    from vigil.llm.decontaminate import decontaminate
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items, whole_rows=True).where("not contaminated").select("row.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; ``n_chars`` follows the text."""
    from vigil.llm.pii import mask
    out = mask(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text; the result has the ids and both digests."""
    import public_tokenizers
    from vigil.llm.bpe import bpe
    small_batches(spark)
    return bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
