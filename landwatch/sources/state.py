"""State tables on shared storage: append, read, fold of drift-event updates, and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from landwatch.session import materialize, path_exists
from landwatch.sources.folded import (
    STORE_OF,
    close_generation,
    generations,
    new_base,
    open_generation,
    read_pointer,
)
from landwatch.sources.snapshots import latest_snapshot, prunable
from landwatch.schemas import (
    DRIFT_UPDATE_FIELDS,
    DRIFT_UPDATES,
    STATE_TABLES,
    StateTable,
)

_TABLES: dict[str, StateTable] = {**STATE_TABLES, "drift_event_updates": DRIFT_UPDATES}


def _path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def append_state(df: DataFrame, root: str, table: str, gathered: bool = False, many_dates: bool = False) -> None:
    """Append rows to a state table.

    Rows are brought together by date and first cluster column, so a file holds few
    connections and readers skip the others; the rebalance hint lets AQE split a key that
    holds too many rows and merge small ones. Rows are sorted inside each file. With
    ``gathered`` the caller has brought them together before.

    Every task opens a file for each of its dates. With ``many_dates``, as a history has, tasks
    take ranges of the dates and their connections instead, so there are about as many files as
    dates and tasks, not their product. The range is found from a sample of the rows, for which
    the last step before is worked out once more; the row id splits a connection of many rows.
    """
    spec = _TABLES[table]
    missing = [f.name for f in spec.schema.fields if not f.nullable and f.name not in df.columns]
    if missing:
        raise ValueError(f"{table} rows lack required columns: {missing}")
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in spec.schema.fields
    ]
    required = [f.name for f in spec.schema.fields if not f.nullable]
    checked = [
        F.when(F.col(n).isNull(), F.raise_error(F.lit(f"{table}.{n} is required"))).otherwise(F.col(n)).alias(n)
        if n in required
        else F.col(n)
        for n in spec.schema.names
    ]
    path = _path(root, table)
    if table in STORE_OF:
        path += f"/generation={read_pointer(df.sparkSession, root, STORE_OF[table]).generation}"
    rows = df.select(*columns).select(*checked).withColumn(spec.date_column, F.to_date(spec.time_column))
    if many_dates:
        rows = rows.repartitionByRange(spec.date_column, *spec.cluster_by, F.xxhash64(*spec.row_id))
    elif not gathered:
        rows = rows.hint("rebalance", F.col(spec.date_column), F.col(spec.cluster_by[0]))
    (
        rows.sortWithinPartitions(spec.date_column, *spec.cluster_by)
        .write.mode("append")
        .option("compression", "zstd")  # ids are hex digits, half of which the default codec keeps
        .partitionBy(spec.date_column)
        .parquet(path)
    )


def read_state(spark: SparkSession, root: str, table: str, deduplicate: bool = True, since: int | None = None) -> DataFrame:
    """A state table with its date partition column; rows a replay wrote twice appear once.

    Removing those rows shuffles the table by row id. Readers that repeats do not affect,
    such as the newest sync of freshness, pass ``deduplicate=False``. A table nothing was
    written to yet is empty. ``since`` limits a folded table to that generation and later ones;
    other folders are not even listed.
    """
    spec = _TABLES[table]
    path = _path(root, table)
    paths = [path] if path_exists(spark, path) else []
    if since is not None:
        paths = generations(spark, path, since, read_pointer(spark, root, STORE_OF[table]).generation)
    if not paths:
        empty = spark.createDataFrame([], spec.schema)
        return empty.withColumn(spec.date_column, F.to_date(spec.time_column))
    schema = StructType([*spec.schema.fields, StructField(spec.date_column, DateType())])
    df = spark.read.schema(schema).option("basePath", path).parquet(*paths).select(*schema.names)
    return df.dropDuplicates(list(spec.row_id)) if deduplicate else df


def write_snapshot(snapshots: DataFrame, columns: DataFrame, root: str) -> None:
    """Append snapshots with their columns. Columns go first: the header row is what makes
    a snapshot visible, so a failure between the two writes leaves nothing half-visible."""
    append_state(columns, root, "column_snapshots", many_dates=True)
    append_state(snapshots, root, "schema_snapshots", many_dates=True)


def insert_drift_event(events: DataFrame, root: str, gathered: bool = False) -> None:
    """Append new drift events in state PROPOSED."""
    append_state(events, root, "drift_events", gathered)


def write_sync_log(rows: DataFrame, root: str) -> None:
    append_state(rows, root, "sync_log")


def write_new_syncs(batch: DataFrame, root: str) -> None:
    """Append the syncs of ``batch`` that the log does not hold yet, each once.

    Ids are built from content, so a repeat has the date of the row it repeats: only the log's
    partitions of the batch's own dates are read.
    """
    once = batch.dropDuplicates(["log_id"]).withColumn("_date", F.to_date("synced_at"))
    days = once.select("_date").distinct()
    stored = read_state(batch.sparkSession, root, "sync_log", deduplicate=False)
    known = stored.join(prunable(days, "_date"), F.col("synced_at_date") == F.col("_date"), "left_semi").select("log_id")
    write_sync_log(once.join(known, "log_id", "left_anti").drop("_date"), root)


def write_flattener_log(rows: DataFrame, root: str) -> None:
    append_state(rows, root, "json_flattener_log")


def write_entity_map(rows: DataFrame, root: str) -> None:
    append_state(rows, root, "entity_map")


def update_drift_event(updates: DataFrame, root: str) -> None:
    """Append field updates for drift events.

    ``updates`` has drift_id, updated_at and the fields to set. With a ``set_fields`` array
    column each row sets just the fields it names (also to NULL); otherwise every non-NULL
    field is set. An unknown column is an error; a frame with no field to set does nothing.
    """
    rows = normalize_updates(updates)
    if rows is not None:
        append_state(rows, root, "drift_event_updates")


def normalize_updates(updates: DataFrame) -> DataFrame | None:
    """Updates with an explicit ``set_fields`` array, or None when there is nothing to set."""
    fields = [c for c in updates.columns if c not in ("drift_id", "set_fields")]
    unknown = [c for c in fields if c not in DRIFT_UPDATE_FIELDS]
    if unknown:
        raise ValueError(f"unknown drift event fields: {unknown}")
    settable = [c for c in fields if c != "updated_at"]
    if not fields:
        return None
    if "updated_at" not in fields:
        raise ValueError("updates need updated_at; the wall clock is never read")
    if "set_fields" in updates.columns:
        return updates
    # A frame with only updated_at is an explicit touch of that field.
    named = F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in settable]) if settable else F.array(F.lit("updated_at"))
    return updates.withColumn("set_fields", F.filter(named, lambda n: n.isNotNull())).filter(
        F.size("set_fields") > 0
    )


def _ordered(updates: DataFrame, fields: list[str]) -> DataFrame:
    """Updates with ``_order``, what makes one the latest.

    Ties in updated_at go to the further lifecycle status, then to a hash of the content, so
    the fold does not depend on read order.
    """
    status_rank = F.lit(0)
    if "remediation_status" in updates.columns:
        status_rank = F.coalesce(
            F.array_position(
                F.array(*map(F.lit, ("PROPOSED", "REJECTED", "APPROVED", "APPLIED", "VERIFIED"))),
                F.col("remediation_status"),
            ).cast("int"),
            F.lit(0),
        )
    # Ties are broken by content, computed once per row.
    content = F.xxhash64(F.array_join("set_fields", ","), *[F.col(c) for c in fields])
    return updates.withColumn("_order", F.struct("updated_at", status_rank.alias("r"), content.alias("h")))


def _latest_sets(updates: DataFrame, fields: list[str], used: list[str] | None = None) -> DataFrame:
    """Per event and field the latest value that an update sets, beside what makes it the latest.
    Fields outside ``used``, which no update sets, are left NULL and not looked for."""
    used = fields if used is None else used
    aggregates = []
    for c in fields:
        if c == "updated_at":
            aggregates.append(F.max("updated_at").alias("_updated_at"))
            continue
        if c in used:
            order = F.when(F.array_contains("set_fields", c), F.col("_order"))
            aggregates.append(F.max_by(F.struct(F.col("_order").alias("o"), F.col(c).alias("v")), order).alias(f"_{c}"))
    sets = _ordered(updates, fields).groupBy("drift_id").agg(*aggregates)
    return _all_sets(sets) if set(used) < set(fields) else sets


def _with_sets(events: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """The events' ``columns`` after the sets that stand beside them."""
    out = []
    for c in columns:
        if c == "updated_at" and c in fields:
            out.append(F.coalesce(F.col("_updated_at"), F.col(c)).alias(c))
        elif c in fields:
            out.append(F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return events.select(*out)


def fold_drift_events(inserted: DataFrame, updates: DataFrame | None) -> DataFrame:
    """Current state of every drift event: each field's latest set value over its insert.
    Updates of unknown events change nothing."""
    if updates is None:
        return inserted
    present = [c for c in DRIFT_UPDATE_FIELDS if c in updates.columns and c in inserted.columns]
    return _with_sets(inserted.join(_latest_sets(updates, present), "drift_id", "left"), inserted.columns, present)


_SETS = list(DRIFT_UPDATE_FIELDS)
_EVENT = [*STATE_TABLES["drift_events"].schema.names, STATE_TABLES["drift_events"].date_column]
_ORDER = "struct<updated_at:timestamp,r:int,h:bigint>"


def _all_sets(frame: DataFrame) -> DataFrame:
    """``frame`` with a column for the sets of every field, NULL where it has none."""
    types = {c: DRIFT_UPDATES.schema[c].dataType.simpleString() for c in _SETS}
    missing = {
        f"_{c}": F.lit(None).cast("timestamp" if c == "updated_at" else f"struct<o:{_ORDER},v:{types[c]}>")
        for c in _SETS if f"_{c}" not in frame.columns
    }
    return frame.withColumns(missing) if missing else frame


def _fields_set(updates: DataFrame) -> list[str]:
    """The fields that any of the updates sets, at most as many as an event has."""
    return [c for c, in updates.select(F.explode("set_fields")).distinct().where(F.col("col").isin(_SETS)).collect()]


def _merged_sets(left: str, right: str) -> list:
    """The later of two sets of each field, as columns of a join of ``left`` and ``right``."""
    later = lambda c: F.greatest(F.col(f"{left}._{c}.o"), F.col(f"{right}._{c}.o")) == F.col(f"{right}._{c}.o")
    return [
        F.greatest(F.col(f"{left}._{c}"), F.col(f"{right}._{c}")).alias(f"_{c}") if c == "updated_at"
        else F.when(F.coalesce(later(c), F.lit(False)), F.col(f"{right}._{c}")).otherwise(F.col(f"{left}._{c}")).alias(f"_{c}")
        for c in _SETS
    ]


def _headed(events: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """The events whose newer snapshot has a header. Repeated headers change nothing, so none are removed first."""
    headers = read_state(spark, root, "schema_snapshots", deduplicate=False).select(F.col("snapshot_id").alias("to_snapshot_id"))
    return events.join(headers, "to_snapshot_id", "left_semi").select(*events.columns)


def _drift_state(spark: SparkSession, root: str) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(base, events of the tail, sets of the tail) of the drift store."""
    at = read_pointer(spark, root, "drift")
    # Beside a base only the events it lacks are looked at, and these are told apart then.
    events = read_state(spark, root, "drift_events", deduplicate=at.base is None, since=at.tail)
    # A repeated update is the latest once or twice, so none are removed first.
    updates = read_state(spark, root, "drift_event_updates", deduplicate=False, since=at.tail).drop("updated_at_date")
    base = _all_sets(spark.read.parquet(at.base)) if at.base else None
    sets = _latest_sets(updates, _SETS, _fields_set(updates))
    # A join with nothing is left out of the plan only if it is known before.
    return base, events, sets.limit(0) if updates.isEmpty() else sets


def _events_with_sets(spark: SparkSession, root: str) -> DataFrame:
    """All events with what their updates set, and ``_committed`` where compaction saw their header.

    The base is joined with the tail's updates alone, and stays where it is while there are none;
    the tail's own events are those whose ids a lookup in the base does not find.
    """
    base, events, sets = _drift_state(spark, root)
    if base is None:
        return events.join(sets, "drift_id", "left").withColumn("_committed", F.lit(False))
    columns = [*_EVENT, *[f"_{c}" for c in _SETS], "_committed"]
    old = base.alias("b").join(sets.alias("t"), "drift_id", "left").where("_known").select(
        *[F.col(f"b.{c}") if c != "drift_id" else F.col(c) for c in _EVENT], *_merged_sets("b", "t"), "_committed"
    ).select(*columns)
    new = _new_events(events, base)
    if new is None:
        return old
    # Updates may have come, and been folded, before their event.
    early = base.where("NOT _known").select("drift_id", *[f"_{c}" for c in _SETS])
    new = new.join(sets, "drift_id", "left").alias("t").join(early.alias("b"), "drift_id", "left").select(
        *[F.col(f"t.{c}") if c != "drift_id" else F.col(c) for c in _EVENT], *_merged_sets("b", "t"), F.lit(False).alias("_committed")
    )
    return old.unionByName(new.select(*columns))


def _new_events(events: DataFrame, base: DataFrame) -> DataFrame | None:
    """The events that the base does not hold, each once, or None where it holds all.

    Ids of both are told apart by 16 bytes. Mostly the base holds all of the tail's events or none,
    and only else are the fewer of both kinds stored, by which the events are picked."""
    digest = F.unhex(F.md5(F.col("drift_id").cast("binary"))).alias("_id")
    known = base.where("_known")
    if known.isEmpty():
        return each_once(events)
    ids = events.select(digest).distinct().join(known.select(digest, F.lit(True).alias("_held")), "_id", "left")
    n, held = ids.agg(F.count(F.lit(1)), F.count("_held")).first()
    if n == held:
        return None
    if held == 0:
        return each_once(events)
    fewer = materialize(ids.where(F.col("_held").isNull() if n < 2 * held else F.col("_held").isNotNull()).select("_id"), "event-ids")
    picked = events.select("*", digest).join(fewer, "_id", "left_semi" if n < 2 * held else "left_anti")
    return each_once(picked.drop("_id"))


def each_once(events: DataFrame) -> DataFrame:
    """One row per drift_id. Only a rerun after a failure repeats any: digests of the ids are
    counted, and the rows of those that repeat, if there are some, are the only ones moved whole."""
    digest = F.xxhash64("drift_id").alias("_digest")
    repeated = events.select(digest).groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_digest")
    repeated = materialize(repeated, "repeated-events")
    if repeated.isEmpty():
        return events
    marked = events.select("*", digest)
    single = marked.join(repeated, "_digest", "left_anti").drop("_digest")
    return single.unionByName(marked.join(repeated, "_digest", "left_semi").drop("_digest").dropDuplicates(["drift_id"]))


def drift_events_current(
    spark: SparkSession, root: str, committed_only: bool = True
) -> DataFrame:
    """Drift events as they stand after all stored updates.

    Events whose newer snapshot has no header are left out: those of a detection run that
    died before its end and was not repeated on the same columns. ``committed_only=False``
    shows them too, and events that did not come from a detection run. After ``compact_state``
    only what was written since is folded, and only events without a header then are looked up.
    """
    events = _events_with_sets(spark, root)
    if committed_only:
        events = events.where("_committed").unionByName(_headed(events.where("NOT _committed"), spark, root))
    return _with_sets(events, _EVENT, _SETS)


def head_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The newest header of each connection: the base's, or a later one written since."""
    at = read_pointer(spark, root, "heads")
    names = STATE_TABLES["schema_snapshots"].schema.names
    # The newest header is the same whether a replay wrote it once or twice.
    headers = read_state(spark, root, "schema_snapshots", deduplicate=False, since=at.tail).select(*names)
    if at.base:
        headers = headers.unionByName(spark.read.parquet(at.base).select(*names))
    return latest_snapshot(headers).select(*names)


def compact_state(spark: SparkSession, root: str) -> None:
    """Fold the drift events with their updates, and the newest headers, into new bases.

    Logs are kept as they are; whoever reads the current state no longer reads the folded
    generations. A run that dies on the way changes nothing but the generation written to.
    """
    before, during = open_generation(spark, root, "heads")
    path = new_base(root, "heads")
    head_snapshots(spark, root).write.parquet(path)
    close_generation(spark, root, "heads", before, during, path)

    before, during = open_generation(spark, root, "drift")
    path = new_base(root, "drift")
    _folded_events(spark, root).write.parquet(path, compression="zstd")
    close_generation(spark, root, "drift", before, during, path)


def _folded_events(spark: SparkSession, root: str) -> DataFrame:
    """The next base: the present one with the tail's events and updates, by one shuffle.

    Rows of the base, events, updates and ids of events that have a header by now are brought
    together by drift id and folded there. An event in the base stands before a replay of it in
    the tail; updates of events that are still to come are kept without one. Where the tail
    updates nothing, no rows are moved (``_appended_events``).
    """
    at = read_pointer(spark, root, "drift")
    events = read_state(spark, root, "drift_events", deduplicate=False, since=at.tail)
    updates = read_state(spark, root, "drift_event_updates", deduplicate=False, since=at.tail)
    if updates.isEmpty():
        return _appended_events(spark, root, spark.read.parquet(at.base) if at.base else None, events)
    used = _fields_set(updates)
    event = F.struct(*[c for c in _EVENT if c != "drift_id"])
    plain = events.select("drift_id", event.alias("_event"), F.lit(0).alias("_from"))
    latest = lambda c: F.when(F.array_contains("set_fields", c), F.struct(F.col("_order").alias("o"), F.col(c).alias("v")))
    sets = _ordered(updates, _SETS).select(
        "drift_id", F.col("updated_at").alias("_updated_at"), *[latest(c).alias(f"_{c}") for c in used if c != "updated_at"]
    )
    waiting = events.select("drift_id", "to_snapshot_id")
    rows = plain.unionByName(sets, allowMissingColumns=True)
    if at.base:
        base = spark.read.parquet(at.base)
        used = [c for c in _SETS if c in used or f"_{c}" in base.columns]
        kept = [f"_{c}" for c in _SETS if f"_{c}" in base.columns]
        folded = base.select("drift_id", F.when(F.col("_known"), event).alias("_event"), F.when(F.col("_known"), 1).alias("_from"), *kept, "_committed")
        rows = rows.unionByName(folded, allowMissingColumns=True)
        waiting = waiting.unionByName(base.where("_known AND NOT _committed").select("drift_id", "to_snapshot_id"))
    headed = _headed(waiting, spark, root).select("drift_id", F.lit(True).alias("_committed"))
    rows = rows.unionByName(headed, allowMissingColumns=True)
    aggregates = [F.max_by(f"_{c}", F.col(f"_{c}.o")).alias(f"_{c}") for c in used if c != "updated_at"]
    folded = rows.repartition("drift_id").groupBy(F.xxhash64("drift_id").alias("_digest"), "drift_id").agg(
        F.max_by("_event", "_from").alias("_event"), F.max("_updated_at").alias("_updated_at"), *aggregates,
        F.coalesce(F.max("_committed"), F.lit(False)).alias("_committed"),
    )
    return folded.select(
        "drift_id", "_event.*", *[f"_{c}" for c in _SETS if c in used or c == "updated_at"],
        F.col("_event").isNotNull().alias("_known"), (F.col("_committed") & F.col("_event").isNotNull()).alias("_committed"),
    )


def _appended_events(spark: SparkSession, root: str, base: DataFrame | None, events: DataFrame) -> DataFrame:
    """The next base where no event is updated: the present one, and the events it lacks, as they
    are stored. Moved are ids of events, and the ids of the snapshots that wait for a header."""
    unset = _all_sets(events.sparkSession.range(0).select()).schema
    if base is None:
        rows = each_once(events).select(*_EVENT, F.lit(True).alias("_known"), F.lit(False).alias("_committed"))
        rows = rows.withColumn("_updated_at", F.lit(None).cast(unset["_updated_at"].dataType))
    else:
        rows, new = base, _new_events(events, base)
        if new is not None:
            early = base.where("NOT _known").select("drift_id", *[c for c in base.columns if c in unset.names])
            early = materialize(early, "early-updates")
            new = new.select(*_EVENT).join(early, "drift_id", "left").withColumns({"_known": F.lit(True), "_committed": F.lit(False)})
            arrived = new.join(early.select("drift_id"), "drift_id", "left_semi").select("drift_id")
            waits = base.where("NOT _known").join(arrived, "drift_id", "left_anti").select(*base.columns)
            rows = base.where("_known").unionByName(waits).unionByName(new.select(*base.columns))
    waiting = rows.where("_known AND NOT _committed").select("to_snapshot_id").distinct()
    headers = read_state(spark, root, "schema_snapshots", deduplicate=False).select(F.col("snapshot_id").alias("to_snapshot_id"))
    # Headers are written last, so few snapshots lack one: these are stored and looked up.
    headless = materialize(waiting.join(headers, "to_snapshot_id", "left_anti").withColumn("_headless", F.lit(True)), "headless")
    committed = F.col("_known") & (F.col("_committed") | F.col("_headless").isNull())
    return rows.join(headless, "to_snapshot_id", "left").withColumn("_committed", committed).select(*rows.columns)


def entity_map_latest(entity_map: DataFrame) -> DataFrame:
    """Rows of the newest detection run. The run id is one scalar, not a collected value."""
    newest = entity_map.agg(F.max_by("detection_id", F.struct("detected_at", "detection_id"))).scalar()
    return entity_map.filter(F.col("detection_id") == newest)
