"""Session helpers: suggested settings and fault-tolerant materialization."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings we suggest for a large cluster. AQE splits skewed join sides and coalesces or
# splits rebalanced partitions; the forced skew split is worth its extra shuffle when one
# connection holds a large share of the rows.
SUGGESTED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Spark 4.1 lets a union keep its inputs' partitioning, which adaptive local shuffle
    # reads do not respect. No operator here depends on it.
    "spark.sql.unionOutputPartitioning": "false",
}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, from ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only for a local master; on a cluster an
    unset folder is an error, since executors could not read each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    created = tempfile.mkdtemp(prefix="landwatch-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored under ``path``, in whatever file system it names."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def materialize(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and fixes the rows: used where a plan is consumed several times and
    must not be recomputed (model replies, the current schema during detection).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/landwatch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done.

    Spark keeps them until the driver's garbage collector finds their plans, by default every 30
    minutes, so a job of many stored stages would hold the shuffles of all of them at once. To be
    called after stages that move much; a frame that is still referred to keeps its own.
    """
    spark.sparkContext._jvm.System.gc()
