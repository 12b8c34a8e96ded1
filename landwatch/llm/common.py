"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landwatch.session import materialize


#: Bytes of one Arrow batch between Spark and Python; with Spark's own 64 MB each task holds several hundred MB outside the heap.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the size of Arrow batches in the session, unless it has been set there."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and outlives executors."""
    small_batches(df.sparkSession)
    return materialize(df, f"llm-{name}")


def remainder(column: str | Column, divisor: int) -> Column:
    """crc32 of an id written as text, modulo ``divisor``; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % divisor


def labelled_sample(labelled: DataFrame, label: Column | str, per_label: int, key_col: str = "doc_id") -> DataFrame:
    """About ``per_label`` keys of each label, as (key, label): the bounded sample a classifier is fitted on.

    A key is taken where its hash falls below ``per_label`` / rows of its label, so the choice
    does not depend on the layout, nothing is sorted and no label is a hot task. All keys of a
    label with fewer rows are taken. The labels must be few: their counts are collected.
    """
    rows = labelled.select(F.col(key_col).alias("key"), (F.col(label) if isinstance(label, str) else label).cast("string").alias("label")).where(
        F.col("key").isNotNull() & F.col("label").isNotNull()
    )
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows
    spread = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("sample")), F.lit(1 << 32))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, per_label / n)])
    return rows.where(spread < share[F.col("label")] * (1 << 32))


def sampled_texts(documents: DataFrame, sample: DataFrame, max_chars: int, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """(key, text, label) of a ``labelled_sample``; texts of more than ``max_chars`` characters are left out of fitting.

    The sample's size is a parameter, so its keys are broadcast and no text is shuffled.
    """
    texts = documents.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).where(F.length("text") <= max_chars)
    return texts.join(F.broadcast(sample), "key")
