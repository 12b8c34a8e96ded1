"""Reading schema snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landwatch.schemas import COLUMN_STRUCT


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot row of each connection; ties go to the larger snapshot_id.

    An aggregate rather than a window: it is combined on the map side, so a connection
    with a long history does not land in one task.
    """
    rest = [c for c in snapshots.columns if c != "connection_id"]
    newest = F.max_by(F.struct(*rest), F.struct("captured_at", "snapshot_id"))
    return (
        snapshots.groupBy("connection_id").agg(newest.alias("s")).select("connection_id", "s.*")
    )


def prunable(wanted: DataFrame, date_column: str) -> DataFrame:
    """``wanted`` in a form that lets a join on ``date_column`` prune partitions of the other
    side. Spark prunes dynamically only when the pruning side is filtered by a comparison, so
    this adds one that every date passes."""
    return wanted.filter(F.col(date_column) >= F.lit("0001-01-01").cast("date"))


def snapshot_columns(
    column_snapshots: DataFrame, snapshots: DataFrame, ordered: bool = False
) -> DataFrame:
    """Columns of the given snapshots (all at once), one row per column name.

    ``snapshots`` needs snapshot_id; when both sides carry ``captured_at_date`` the join
    uses it too, so only the partitions of the wanted dates are read. Replayed writes and
    repeated names collapse to the row with the largest ordinal.
    """
    on = ["snapshot_id"]
    if "captured_at_date" in snapshots.columns and "captured_at_date" in column_snapshots.columns:
        on.append("captured_at_date")
        snapshots = prunable(snapshots, "captured_at_date")
    wanted = snapshots.select(*on).distinct()
    side = ["snapshot_id", "connection_id", "table_schema", "table_name", "column_name"]
    payload = F.max(F.struct("ordinal_position", "data_type", "is_nullable"))
    out = (
        column_snapshots.join(wanted, on, "left_semi")
        .groupBy(*side)
        .agg(payload.alias("c"))
        .select("snapshot_id", "connection_id", *[
            F.col(n) if n in side else F.col(f"c.{n}") for n in COLUMN_STRUCT.names
        ])
    )
    if ordered:
        out = out.orderBy("snapshot_id", "table_schema", "table_name", "ordinal_position")
    return out


def snapshot_pairs(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the one before it:
    ``(connection_id, from_snapshot_id, to_snapshot_id, from_captured_at, to_captured_at)``.
    The first snapshot of a connection has no pair.

    The previous row is looked up within one day of one connection; only the day's first
    snapshot looks at the last one of the connection's previous active day. A connection
    with most of the history is thereby split by day, and the per-connection window sees
    one row per day.
    """
    s = snapshots.select(
        "connection_id", "snapshot_id", "captured_at", F.to_date("captured_at").alias("day")
    )
    key = F.struct("captured_at", "snapshot_id")
    last_of_day = s.groupBy("connection_id", "day").agg(F.max(key).alias("last"))
    by_day = Window.partitionBy("connection_id").orderBy("day")
    previous_day = last_of_day.select(
        "connection_id", "day", F.lag("last").over(by_day).alias("carry")
    )
    within_day = Window.partitionBy("connection_id", "day").orderBy("captured_at", "snapshot_id")
    return (
        s.withColumn("prev", F.lag(key).over(within_day))
        .join(previous_day, ["connection_id", "day"])
        .withColumn("prev", F.coalesce("prev", "carry"))
        .filter(F.col("prev").isNotNull())
        .select(
            "connection_id",
            F.col("prev.snapshot_id").alias("from_snapshot_id"),
            F.col("snapshot_id").alias("to_snapshot_id"),
            F.col("prev.captured_at").alias("from_captured_at"),
            F.col("captured_at").alias("to_captured_at"),
        )
    )
