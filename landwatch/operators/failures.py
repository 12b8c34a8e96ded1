"""Sync failures: top errors, counts, severity, live connector status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landwatch.functions.text import blank_to
from landwatch.sources.rows import failure_window_scan

# -- fixed values: severity thresholds, error states, number of errors reported ---------
SEVERITY_THRESHOLDS = {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 2, "LOW": 1}
ERROR_STATES = ("error", "broken")
TOP_ERRORS = 5


def _error_groups(failures: DataFrame) -> DataFrame:
    newest = F.struct("failed_at", "log_id")
    return failures.groupBy(
        "connection_id", blank_to(F.col("error_code"), "UNKNOWN").alias("error_code")
    ).agg(
        F.count(F.lit(1)).alias("count"),
        F.max_by(F.coalesce("error_message", F.lit("")), newest).alias("sample_message"),
        F.max("failed_at").alias("last_failed_at"),
    )


def failure_top_errors(
    failures: DataFrame, as_of: str | datetime, days: int = 7, k: int = TOP_ERRORS
) -> DataFrame:
    """The ``k`` most frequent error codes of each connection with the newest message of each.

    Ties go to the code that failed most recently. Failures are first combined per code;
    the rank limit is then applied before the shuffle as well (window group limit), so at
    most ``k`` codes per connection and task are moved.
    """
    order = Window.partitionBy("connection_id").orderBy(
        F.desc("count"), F.desc("last_failed_at"), "error_code"
    )
    return (
        _error_groups(failure_window_scan(failures, as_of, days))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("connection_id", "error_code", "count", "sample_message", "rank")
    )


def failure_count(failures: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    """All failures of each connection in the window, not only those of the top codes."""
    return (
        failure_window_scan(failures, as_of, days)
        .groupBy("connection_id")
        .agg(F.count(F.lit(1)).alias("failure_count"))
    )


def severity_from_count(count: Column) -> Column:
    """CRITICAL from 10 failures, HIGH from 5, MEDIUM from 2, else LOW."""
    ladder = F
    for level, threshold in SEVERITY_THRESHOLDS.items():
        ladder = ladder.when(count >= threshold, level)
    return ladder.otherwise(F.lit("LOW"))


def connector_status_errors(status: DataFrame, k: int = TOP_ERRORS) -> DataFrame:
    """Errors read from live connector status, for connections without logged failures.

    ``status`` has ``connection_id, sync_state, tasks array<struct<code, message>>``. A
    connection in an error state or with open tasks yields one error per task, the first
    ``k`` of them, or one for the state itself; any other connection yields none.
    ``total_errors`` counts all of a connection's errors, listed or not.
    """
    tasks = F.coalesce("tasks", F.array().cast("array<struct<code:string,message:string>>"))
    state_error = F.array(
        F.struct(F.upper("sync_state").alias("code"), F.lit("Connection is in error state").alias("message"))
    )
    errors = (
        F.when(F.size(tasks) > 0, tasks)
        .when(F.col("sync_state").isin(*ERROR_STATES), state_error)
        .otherwise(F.array().cast("array<struct<code:string,message:string>>"))
    )
    counted = status.select("connection_id", errors.alias("errors"))
    listed = F.posexplode(F.slice("errors", 1, k)).alias("pos", "e")
    return counted.select("connection_id", F.size("errors").cast("bigint").alias("total_errors"), listed).select(
        "connection_id",
        "total_errors",
        F.coalesce("e.code", F.lit("UNKNOWN")).alias("error_code"),
        F.lit(1).cast("bigint").alias("count"),
        F.coalesce("e.message", F.lit("")).alias("sample_message"),
        (F.col("pos") + 1).alias("rank"),
    )
