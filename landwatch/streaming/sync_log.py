"""Sync events as a stream: verified, routed, deduplicated, stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landwatch.operators.freshness import receiver_latency
from landwatch.sources.state import write_new_syncs
from landwatch.sources.sync_events import accepted_syncs, route_sync_events


def stream_sync_log(raw: DataFrame, key: bytes) -> DataFrame:
    """Sync-log rows of a stream of raw events, late ones and redelivered ones too.

    Nothing is held back or dropped by the sender's clock: a sync may arrive days late, or carry
    a time in the future, and still counts. Repeats are removed where rows are stored.
    """
    return accepted_syncs(route_sync_events(raw, key))


def write_sync_log_stream(
    syncs: DataFrame, root: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append the stream to the sync log. A batch replayed after a failure, or an event that is
    delivered again in a later batch, adds nothing."""
    writer = syncs.writeStream.foreachBatch(lambda batch, _: write_new_syncs(batch, root)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_rejected(raw: DataFrame, key: bytes) -> DataFrame:
    """Events that were not accepted, with the reply each gets, for a sink of their own."""
    routed = route_sync_events(raw, key)
    return routed.filter(F.col("route") != "accepted").select(
        "body", "received_at", "route", "reply", "http_status"
    )


def stream_receiver_latency(
    syncs: DataFrame, window: str = "1 hour", watermark: str = "2 days"
) -> DataFrame:
    """Receiver latency per window of a stream of sync rows.

    The watermark bounds the state of a report that closes its windows: a sync later than that
    is missing from the streamed windows, but not from the sync log. ``receiver_latency`` over
    the stored log counts it.
    """
    return receiver_latency(syncs.withWatermark("synced_at", watermark), window)
