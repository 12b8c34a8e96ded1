"""Landed columns laid out by connection, so that a few connections are read without the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from landwatch.schemas import LANDED_COLUMNS
from landwatch.session import path_exists

#: Folders that the connections are dealt to.
BUCKETS = 256


def bucket_of(connection_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(connection_id), F.lit(buckets)).cast("int")


def _layout(path: str, buckets: int) -> str:
    return f"{path.rstrip('/')}/of={buckets}"


def write_landed(landed: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store the landed columns of the whole fleet, each connection's rows in one of ``buckets`` folders.

    Replaces what is stored. Rows are brought together by bucket, a large one split over several
    files, and sorted by connection inside each, so row groups of other connections are skipped too.
    """
    (
        landed.select(*LANDED_COLUMNS.names)
        .withColumn("bucket", bucket_of(F.col("connection_id"), buckets))
        .hint("rebalance", F.col("bucket"))
        .sortWithinPartitions("bucket", "connection_id", "table_name")
        .write.mode("overwrite").partitionBy("bucket").parquet(_layout(path, buckets))
    )


def read_landed(spark: SparkSession, path: str, syncs: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The stored columns, or only those of the connections in ``syncs``.

    The ids of ``syncs`` name their buckets, and the join prunes the folders by them: a micro-batch
    of few syncs opens few folders, however large the fleet.
    """
    folder = _layout(path, buckets)
    if not path_exists(spark, folder):
        raise ValueError(f"no landed columns in {buckets} buckets under {path}")
    stored = spark.read.schema(StructType([*LANDED_COLUMNS.fields, StructField("bucket", IntegerType())])).parquet(folder)
    if syncs is not None:
        wanted = syncs.select("connection_id").distinct().withColumn("bucket", bucket_of(F.col("connection_id"), buckets))
        # Spark prunes by a join only where the pruning side is filtered by a comparison.
        stored = stored.join(wanted.where(F.col("bucket") >= 0), ["bucket", "connection_id"], "left_semi")
    return stored.select(*LANDED_COLUMNS.names)
