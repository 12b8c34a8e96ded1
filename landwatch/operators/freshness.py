"""Freshness of connections against an SLA, and receiver latency."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.functions.times import hours_between, literal_like

DEFAULT_SLA_HOURS = 24.0


def _last_sync(sync_log: DataFrame) -> DataFrame:
    return sync_log.groupBy("connection_id").agg(F.max("synced_at").alias("last_synced_at"))


def _status(hours: Column, sla_hours: float) -> Column:
    # The unrounded hours decide; only the shown value is rounded.
    return (
        F.when(hours.isNull(), "NEVER_SYNCED").when(hours <= F.lit(float(sla_hours)), "OK").otherwise("STALE")
    )


def _with_status(last: DataFrame, sync_log: DataFrame, as_of, sla_hours: float) -> DataFrame:
    hours = hours_between(F.col("last_synced_at"), literal_like(sync_log, "synced_at", as_of))
    return last.select(
        "connection_id",
        "last_synced_at",
        F.round(hours, 2).alias("hours_since_sync"),
        F.lit(float(sla_hours)).alias("sla_hours"),
        _status(hours, sla_hours).alias("status"),
    )


def freshness_fleet(
    sync_log: DataFrame,
    as_of: str | datetime,
    sla_hours: float = DEFAULT_SLA_HOURS,
    ordered: bool = False,
) -> DataFrame:
    """Freshness of every connection that has synced, stalest first when ``ordered``."""
    out = _with_status(_last_sync(sync_log), sync_log, as_of, sla_hours)
    return out.orderBy("last_synced_at", "connection_id") if ordered else out


def freshness_check(
    ids: DataFrame,
    sync_log: DataFrame,
    as_of: str | datetime,
    sla_hours: float = DEFAULT_SLA_HOURS,
) -> DataFrame:
    """Freshness of the given connections; those without a sync are NEVER_SYNCED."""
    wanted = ids.select("connection_id").distinct()
    last = wanted.join(_last_sync(sync_log), "connection_id", "left")
    return _with_status(last, sync_log, as_of, sla_hours)


def freshness_signal(
    ids: DataFrame,
    sync_log: DataFrame,
    as_of: str | datetime,
    sla_hours: float = DEFAULT_SLA_HOURS,
) -> DataFrame:
    """The freshness part of the readiness grade: status and hours."""
    return freshness_check(ids, sync_log, as_of, sla_hours).select(
        "connection_id", "status", "hours_since_sync"
    )


def receiver_latency(sync_log: DataFrame, window: str = "1 hour") -> DataFrame:
    """Seconds from sync completion to receipt, per tumbling window of the sync time.

    Works on a batch or a watermarked stream.
    """
    seconds = F.timestamp_diff("MILLISECOND", F.col("synced_at"), F.col("received_at")) / F.lit(1000.0)
    return (
        sync_log.groupBy(F.window("synced_at", window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.round(F.avg(seconds), 3).alias("avg_latency_sec"),
            F.max(seconds).alias("max_latency_sec"),
        )
        .select(F.col("w.start").alias("window_start"), "n_events", "avg_latency_sec", "max_latency_sec")
    )
