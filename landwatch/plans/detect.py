"""Drift detection: accepted syncs and current columns in, snapshots and drift events out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.functions.hashing import content_hash, empty_hash
from landwatch.functions.text import blank_to, stable_id
from landwatch.operators.classify import classify_by_rules, classify_changes
from landwatch.operators.drift import (
    attribute_collateral_reorder,
    changes_from,
    diff_columns,
    hash_gate,
    match_tagged,
    store_changed,
)
from landwatch.schemas import STATE_TABLES
from landwatch.session import free_shuffles, materialize
from landwatch.sources.metadata import exclude_system_columns, resolve_destination
from landwatch.sources.snapshots import latest_snapshot, prunable
from landwatch.sources.state import (
    append_state,
    each_once as _each_once,
    head_snapshots,
    insert_drift_event,
    read_state,
    write_new_syncs,
)

PAIR = ("connection_id", "from_snapshot_id", "to_snapshot_id")


def diff_history(
    pairs: DataFrame, column_snapshots: DataFrame, exclude: tuple[str, str] | None = None
) -> DataFrame:
    """Candidate changes of every snapshot pair at once.

    Each column row is read once and sent to the pairs its snapshot takes part in, as the
    older side of at most one and the newer side of at most one; one shuffle by column name
    then matches the sides of all pairs. When the columns carry their date partition, the
    join names the dates too, so only those partitions are read. Rows a replay wrote twice
    collapse in the match. Rows carry the number of their pair instead of its ids.
    """
    numbered = _numbered(pairs)
    return _told(_numbered_changes(numbered, column_snapshots, exclude), numbered, PAIR)


def _numbered(pairs: DataFrame) -> DataFrame:
    """The pairs with a number each, stored so that it stays the same."""
    return materialize(pairs.withColumn("_pair", F.monotonically_increasing_id()), "pairs")


def _told(changes: DataFrame, numbered: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The pairs' columns beside the changes that go by their numbers."""
    rest = [c for c in changes.columns if c != "_pair"]
    return changes.join(numbered.select("_pair", *names), "_pair").select(*names, *rest)


def _numbered_changes(numbered: DataFrame, column_snapshots: DataFrame, exclude: tuple[str, str] | None = None) -> DataFrame:
    columns = column_snapshots
    if exclude is not None:
        columns = exclude_system_columns(columns, *exclude)
    on = ["connection_id", "snapshot_id"]
    sides = [
        F.struct(
            F.col(f"{side}_snapshot_id").alias("snapshot_id"),
            F.to_date(f"{side}_captured_at").alias("captured_at_date"),
            F.lit(side == "to").alias("is_current"),
        )
        for side in ("from", "to")
    ]
    wanted = numbered.select("_pair", "connection_id", F.explode(F.array(*sides)).alias("w")).select("_pair", "connection_id", "w.*")
    if "captured_at_date" in columns.columns:
        on.append("captured_at_date")
        wanted = prunable(wanted, "captured_at_date")
    else:
        wanted = wanted.drop("captured_at_date")
    place = ["_pair", "table_schema", "table_name", "column_name"]
    # Moved as plain rows: a column has one row a side, so there is nothing to combine before.
    tagged = columns.join(wanted, on).select(*place, "ordinal_position", "data_type", "is_nullable", "is_current").repartition(*place)
    return changes_from(store_changed(match_tagged(tagged, ("_pair",))), ("_pair",))


def drift_rows(classified: DataFrame, detected_at: str = "detected_at") -> DataFrame:
    """PROPOSED drift events from valid classified changes. The id is built from the snapshot
    pair and the column pair, so detecting the same change again gives the same row."""
    return classified.filter("is_valid").select(
        stable_id(
            F.col("connection_id"), F.col("from_snapshot_id"), F.col("to_snapshot_id"),
            F.col("table_schema"), F.col("table_name"),
            F.col("before.column_name"), F.col("after.column_name"),
        ).alias("drift_id"),
        "connection_id",
        F.col(detected_at).alias("detected_at"),
        "from_snapshot_id",
        "to_snapshot_id",
        "table_schema",
        "table_name",
        "change_type",
        F.col("before").alias("column_before"),
        F.col("after").alias("column_after"),
        "classification_conf",
        "rationale",
        "remediation_sql",
        F.lit(None).cast("string").alias("transformation_id"),
        F.lit("PROPOSED").alias("remediation_status"),
        F.lit(None).cast("string").alias("approved_by"),
        F.col(detected_at).alias("updated_at"),
    )


def gate_connections(
    syncs: DataFrame,
    landed: DataFrame,
    snapshots: DataFrame,
    connections: DataFrame | None = None,
    default_schema: str = "public",
) -> DataFrame:
    """One row per synced connection with its hash, gate state and new snapshot id.

    ``landed`` must already be free of system columns. The id is built from the content and
    the prior snapshot, so repeating the step gives the same id.
    """
    newest = (
        syncs.groupBy("connection_id")
        .agg(
            F.max("received_at").alias("captured_at"),
            F.max_by(F.struct("connection_name", "sync_id"), F.struct("received_at", "log_id")).alias("s"),
        )
        .select("connection_id", "captured_at", "s.connection_name", "s.sync_id")
    )
    # Stored first, so its real size decides the join below: while the ids fit the broadcast
    # threshold the landed columns are filtered in place, and a connection with a large share
    # of them is hashed from map-side partial results instead of being moved to one task.
    newest = materialize(newest, "synced")
    hashes = content_hash(landed.join(newest.select("connection_id"), "connection_id", "left_semi"))
    current = newest.join(hashes, "connection_id", "left").withColumns(
        {
            "content_hash": F.coalesce("content_hash", empty_hash()),
            "column_count": F.coalesce("column_count", F.lit(0)),
        }
    )
    if connections is None:
        current = current.withColumn("destination_schema", F.lit(default_schema))
    else:
        current = resolve_destination(current, connections, default_schema)
    gated = hash_gate(current, latest_snapshot(snapshots))
    return gated.withColumn(
        "snapshot_id",
        stable_id(F.col("connection_id"), F.col("current_hash"), F.col("prior_snapshot_id")),
    )


def detect_drift(
    syncs: DataFrame,
    landed: DataFrame,
    root: str,
    system_columns: tuple[str, str],
    connections: DataFrame | None = None,
    model_fn: Callable[[str], str] | None = None,
    default_schema: str = "public",
) -> DataFrame:
    """Run detection for all synced connections and store the outcome under ``root``.

    ``syncs`` are accepted sync rows (``sources.sync_events.accepted_syncs``); ``landed`` the
    current columns of at least those connections, from a source that does not change during
    the run; ``system_columns`` the (prefix, suffix)
    of the loader's own columns. Returns the drift events of this run.

    Every sync is logged first, changed schema or not. Column rows are then written and read
    back, so the diff sees exactly what was stored; the events follow; the snapshot header
    comes last. A snapshot exists once its header does: if the job dies anywhere before, a
    rerun repeats the same rows under the same ids, and readers keep one of each. Changes the
    model could not classify go to ``drift_rejected`` for ``retry_rejected``.
    """
    spark = syncs.sparkSession
    write_new_syncs(syncs, root)
    user_columns = exclude_system_columns(landed, *system_columns)
    gated = gate_connections(syncs, user_columns, head_snapshots(spark, root), connections, default_schema)
    # One row per synced connection, read by every later step: fixed once.
    opened = materialize(gated.filter(F.col("gate_state") != "UNCHANGED"), "opened")

    new_columns = user_columns.join(
        opened.select("connection_id", "snapshot_id", "captured_at"), "connection_id"
    )
    append_state(new_columns, root, "column_snapshots")
    free_shuffles(spark)

    stored = read_state(spark, root, "column_snapshots", deduplicate=False)
    changed = opened.filter(F.col("gate_state") == "CHANGED")
    pairs = changed.select(
        "connection_id",
        F.col("prior_snapshot_id").alias("from_snapshot_id"),
        F.col("snapshot_id").alias("to_snapshot_id"),
        F.col("prior_captured_at").alias("from_captured_at"),
        F.col("captured_at").alias("to_captured_at"),
    )
    numbered = _numbered(pairs.withColumn("detected_at", F.col("to_captured_at")))
    changes = _numbered_changes(numbered, stored)
    free_shuffles(spark)
    if model_fn is None:
        # Rows are brought together while they are short: ids and texts are added after it.
        described = attribute_collateral_reorder(changes, ("_pair",)).hint("rebalance", F.col("_pair"))
        classified = classify_by_rules(_told(described, numbered, (*PAIR, "detected_at")))
        insert_drift_event(drift_rows(classified), root, gathered=True)
    else:
        detected = pairs.select("to_snapshot_id", F.col("to_captured_at").alias("detected_at"))
        classified = classify_changes(_told(changes, numbered, PAIR), model_fn, PAIR).join(detected, "to_snapshot_id")
        insert_drift_event(drift_rows(classified), root)
        _store_rejected(classified, root)

    free_shuffles(spark)
    headers = opened.select(
        "snapshot_id",
        "connection_id",
        blank_to(F.col("connection_name"), "").alias("connection_name"),
        "destination_schema",
        "captured_at",
        F.lit("sync_end").alias("trigger_event"),
        F.coalesce("sync_id", F.lit("")).alias("sync_id"),
        "column_count",
        F.col("current_hash").alias("content_hash"),
    )
    append_state(headers, root, "schema_snapshots")
    # Events carry the time of their snapshot, so only the partitions of this run are read.
    new_ids = prunable(
        opened.select(F.col("snapshot_id").alias("to_snapshot_id"), F.to_date("captured_at").alias("detected_at_date")),
        "detected_at_date",
    )
    written = read_state(spark, root, "drift_events", deduplicate=False)
    return _each_once(written.join(new_ids, ["to_snapshot_id", "detected_at_date"], "left_semi")).select(
        *STATE_TABLES["drift_events"].schema.names
    )


_REJECTED_KEEP = (*PAIR, "table_schema", "table_name", "change_type", "before", "after", "error", "detected_at")


def _store_rejected(classified: DataFrame, root: str) -> None:
    classified.filter("NOT is_valid").select(*_REJECTED_KEEP).write.mode("append").parquet(
        f"{root.rstrip('/')}/drift_rejected"
    )


def retry_rejected(spark, root: str, model_fn: Callable[[str], str] | None = None) -> DataFrame:
    """Classify again the stored changes that still have no drift event. Returns the rows
    that were added."""
    rejected = spark.read.parquet(f"{root.rstrip('/')}/drift_rejected").drop("error")
    identity = [*PAIR, "table_schema", "table_name", "before", "after"]
    changes = rejected.dropDuplicates(identity)
    detected = changes.select(F.col("to_snapshot_id"), "detected_at").groupBy("to_snapshot_id").agg(
        F.max("detected_at").alias("detected_at")
    )
    classified = classify_changes(changes.drop("detected_at"), model_fn, PAIR).join(detected, "to_snapshot_id")
    known = read_state(spark, root, "drift_events").select("drift_id")
    added = materialize(drift_rows(classified).join(known, "drift_id", "left_anti"), "retried")
    insert_drift_event(added, root)
    return added


def plan_drift(
    prior: DataFrame, current: DataFrame, system_columns: tuple[str, str] | None = None
) -> DataFrame:
    """Read-only detection between two column sets of the whole fleet: diff and
    classification by rules.

    Connections with no prior columns are new: they get no changes. There is no hash gate
    here, since hashing both sides costs more than the one pass that matches them; the gate
    pays when the prior hash is stored, as in ``detect_drift``.
    """
    if system_columns is not None:
        prior = exclude_system_columns(prior, *system_columns)
        current = exclude_system_columns(current, *system_columns)
    # Stored first, so its real size decides the join: while the ids fit the broadcast threshold,
    # the columns stay where they are, and no connection's share of them is one task.
    known = materialize(prior.select("connection_id").distinct(), "known")
    return classify_changes(diff_columns(prior, current.join(known, "connection_id", "left_semi")))


__all__ = [
    "detect_drift",
    "diff_history",
    "drift_rows",
    "gate_connections",
    "plan_drift",
    "retry_rejected",
]
