"""Signed sync-completion events: source, parsing and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landwatch.functions.crypto import verify_signature
from landwatch.functions.text import blank_to, stable_id
from landwatch.schemas import RAW_SYNC_EVENT, SYNC_EVENT_BODY

# -- fixed values: accepted event and status, and the reply given for each route --------
SYNC_EVENT = "sync_end"
OK_STATUS = "SUCCESSFUL"
ROUTES = {
    "unauthorized": ("invalid signature", 401),
    "ignored_event": ("ignored", 200),
    "ignored_status": ("ignored: non-successful sync", 200),
    "accepted": ("ok", 200),
    "rejected": ("rejected: no connector_id", 200),
}


def sync_event_source(
    spark: SparkSession, path: str, fmt: str = "json", streaming: bool = True, **options: str
) -> DataFrame:
    """Raw event bodies ``(body, signature, received_at)`` from files, as a stream or batch."""
    reader = spark.readStream if streaming else spark.read
    return reader.format(fmt).schema(RAW_SYNC_EVENT).options(**options).load(path)


def parse_body(body: Column) -> Column:
    """Event body as a struct; malformed text gives NULL fields."""
    return F.from_json(body.cast("string"), SYNC_EVENT_BODY)


def route_sync_events(raw: DataFrame, key: bytes) -> DataFrame:
    """Parse and route every event; adds the body fields, ``route``, ``reply`` and ``http_status``.

    Checked in order: signature, event name, sync status, connection id. An unreadable body
    has no event name and is ignored like any other event we do not act on.
    """
    parsed = raw.withColumn("e", parse_body(F.col("body")))
    route = (
        F.when(~verify_signature(F.col("body"), F.col("signature"), key), "unauthorized")
        .when(~F.coalesce(F.col("e.event") == SYNC_EVENT, F.lit(False)), "ignored_event")
        .when(~F.coalesce(F.col("e.data.status") == OK_STATUS, F.lit(False)), "ignored_status")
        .when(F.coalesce(F.col("e.connector_id"), F.lit("")) == "", "rejected")
        .otherwise("accepted")
    )
    replies = F.create_map(*[F.lit(x) for r, (text, _) in ROUTES.items() for x in (r, text)])
    codes = F.create_map(*[F.lit(x) for r, (_, code) in ROUTES.items() for x in (r, code)])
    return (
        parsed.withColumn("route", route)
        .withColumns(
            {
                "connection_id": F.col("e.connector_id"),
                "connection_name": F.col("e.connector_name"),
                "event": F.col("e.event"),
                "sync_id": F.nullif(F.col("e.sync_id"), F.lit("")),
                "created": F.try_to_timestamp(F.col("e.created")),
                "sync_status": F.col("e.data.status"),
                "reply": replies[F.col("route")],
                "http_status": codes[F.col("route")],
            }
        )
        .drop("e")
    )


def accepted_syncs(routed: DataFrame) -> DataFrame:
    """Sync-log rows of the accepted events.

    ``synced_at`` is the reported completion time, else the time of receipt. ``log_id`` is
    built from connection and sync id, so a redelivered event gets the same id; an event
    without sync id falls back to its own times.
    """
    synced_at = F.coalesce("created", "received_at")
    identity = F.coalesce(
        F.col("sync_id"), F.concat(F.lit("@"), synced_at.cast("string"), F.lit("/"), F.sha2("body", 256))
    )
    return routed.filter(F.col("route") == "accepted").select(
        stable_id(F.col("connection_id"), identity).alias("log_id"),
        "connection_id",
        "sync_id",
        synced_at.alias("synced_at"),
        "received_at",
        blank_to(F.col("connection_name"), "").alias("connection_name"),
    )
