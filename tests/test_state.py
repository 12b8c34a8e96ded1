import pytest
from pyspark.sql import functions as F

import landwatch as lw
from landwatch.operators.lifecycle import check_transitions, lifecycle_updates
from landwatch.schemas import LANDED_COLUMNS
from landwatch.sources.state import append_state, normalize_updates

SYSTEM = ("_sys_", "_sys_id")


def syncs(spark, *ids, at="2024-01-01 00:00:00"):
    df = spark.createDataFrame([(i,) for i in ids], "connection_id string")
    when = F.lit(at).cast("timestamp")
    return df.select(
        F.concat("connection_id", F.lit(at)).alias("log_id"), "connection_id", F.lit(at).alias("sync_id"),
        when.alias("synced_at"), when.alias("received_at"), F.lit("n").alias("connection_name"),
    )


def landed(spark, *cols, conn="c1"):
    rows = [(conn, "public", "orders", n, k, i + 1, True) for i, (n, k) in enumerate(cols)]
    return spark.createDataFrame(rows, LANDED_COLUMNS)


BASE = [("order_id", "INT64"), ("amount", "BIGNUMERIC"), ("_sys_synced", "TIMESTAMP")]
NEXT = [("order_id", "INT64"), ("amount", "STRING"), ("note", "STRING"), ("_sys_synced", "TIMESTAMP")]


def test_pipeline_bootstrap_unchanged_changed_and_replay(spark, root):
    first = lw.detect_drift(syncs(spark, "c1"), landed(spark, *BASE), root, SYSTEM)
    assert first.count() == 0
    header = lw.read_state(spark, root, "schema_snapshots").collect()
    assert [(h.connection_id, h.column_count, h.trigger_event, h.destination_schema) for h in header] == [("c1", 2, "sync_end", "public")]

    assert lw.detect_drift(syncs(spark, "c1", at="2024-01-02 00:00:00"), landed(spark, *BASE), root, SYSTEM).count() == 0
    assert lw.read_state(spark, root, "schema_snapshots").count() == 1
    assert lw.read_state(spark, root, "sync_log").count() == 2

    day3 = syncs(spark, "c1", at="2024-01-03 00:00:00")
    events = lw.detect_drift(day3, landed(spark, *NEXT), root, SYSTEM).collect()
    assert sorted((e.change_type, e.remediation_status) for e in events) == [("NEW_FIELD", "PROPOSED"), ("TYPE_PROMOTION", "PROPOSED")]
    promoted = next(e for e in events if e.change_type == "TYPE_PROMOTION")
    assert promoted.column_before.data_type == "BIGNUMERIC" and promoted.column_after.data_type == "STRING"
    assert promoted.from_snapshot_id == header[0].snapshot_id

    # The same batch again: the gate finds nothing new and nothing is doubled.
    assert lw.detect_drift(day3, landed(spark, *NEXT), root, SYSTEM).count() == 0
    assert lw.read_state(spark, root, "drift_events").count() == 2
    assert lw.read_state(spark, root, "sync_log").count() == 3


def test_crash_before_the_header_is_repeated_without_doubles(spark, root, monkeypatch):
    lw.detect_drift(syncs(spark, "c1"), landed(spark, *BASE), root, SYSTEM)
    day2 = syncs(spark, "c1", at="2024-01-02 00:00:00")
    import landwatch.plans.detect as detect

    real = detect.append_state

    def dying(df, where, table):
        if table == "schema_snapshots":
            raise RuntimeError("executor gone")
        return real(df, where, table)

    monkeypatch.setattr(detect, "append_state", dying)
    with pytest.raises(RuntimeError):
        detect.detect_drift(day2, landed(spark, *NEXT), root, SYSTEM)
    assert lw.drift_events_current(spark, root).count() == 0
    monkeypatch.setattr(detect, "append_state", real)
    assert detect.detect_drift(day2, landed(spark, *NEXT), root, SYSTEM).count() == 2
    assert lw.drift_events_current(spark, root).count() == 2
    assert lw.read_state(spark, root, "schema_snapshots").count() == 2


def test_unclassified_changes_are_kept_and_retried(spark, root):
    lw.detect_drift(syncs(spark, "c1"), landed(spark, *BASE), root, SYSTEM)

    def model(prompt):
        if '"NEW_FIELD"' in prompt.split("DATA:")[1]:
            raise RuntimeError("quota")
        return '{"change_type": "TYPE_PROMOTION", "confidence": 0.8, "rationale": "wider", "remediation_sql": "s"}'

    events = lw.detect_drift(syncs(spark, "c1", at="2024-01-02 00:00:00"), landed(spark, *NEXT), root, SYSTEM, model_fn=model)
    assert [(e.change_type, e.classification_conf, e.rationale) for e in events.collect()] == [("TYPE_PROMOTION", 0.8, "wider")]
    assert [e.change_type for e in lw.retry_rejected(spark, root).collect()] == ["NEW_FIELD"]
    assert lw.retry_rejected(spark, root).count() == 0
    assert lw.read_state(spark, root, "drift_events").count() == 2


def test_connection_without_columns_and_hot_history(spark, root):
    assert lw.detect_drift(syncs(spark, "empty"), landed(spark, *BASE), root, SYSTEM).count() == 0
    header = lw.read_state(spark, root, "schema_snapshots").collect()[0]
    import hashlib

    assert (header.column_count, header.content_hash) == (0, "2:" + hashlib.sha256(b"0|0|0").hexdigest())


def event(spark, root, drift_id="d1"):
    rows = [(drift_id, "c1", "s1", "s2", "public", "orders", "RENAME", 0.5, "PROPOSED")]
    df = spark.createDataFrame(rows, "drift_id string, connection_id string, from_snapshot_id string, to_snapshot_id string, table_schema string, table_name string, change_type string, classification_conf double, remediation_status string")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    lw.insert_drift_event(df.withColumns({"detected_at": at, "updated_at": at}), root)


def transitions(spark, *rows):
    df = spark.createDataFrame(rows, "drift_id string, action string, actor string, transformation_id string, at string")
    return df.withColumn("updated_at", F.col("at").cast("timestamp"))


def test_lifecycle_is_folded_from_the_log(spark, root):
    event(spark, root)
    steps = transitions(
        spark,
        ("d1", "approve", "ann", None, "2024-01-02"),
        ("d1", "apply", None, "tf1", "2024-01-03"),
        ("d1", "verify", None, None, "2024-01-04"),
        ("unknown", "approve", "bob", None, "2024-01-02"),
    )
    lw.update_drift_event(lifecycle_updates(steps), root)
    lw.update_drift_event(lifecycle_updates(steps), root)
    now = lw.drift_events_current(spark, root, committed_only=False).collect()
    assert [(e.remediation_status, e.approved_by, e.transformation_id, str(e.updated_at)) for e in now] == [("VERIFIED", "ann", "tf1", "2024-01-04 00:00:00")]
    assert now[0].classification_conf == 0.5


def test_any_order_is_taken_unless_strict(spark, root):
    event(spark, root)
    current = lw.drift_events_current(spark, root, committed_only=False)
    verify = transitions(spark, ("d1", "verify", None, None, "2024-01-02"))
    assert lw.drift_lifecycle(current, verify).collect()[0].remediation_status == "VERIFIED"
    assert lw.drift_lifecycle(current, verify, strict=True).collect()[0].remediation_status == "PROPOSED"
    assert [r.is_legal for r in check_transitions(current, verify).collect()] == [False]


def test_updates_check_their_fields(spark, root):
    event(spark, root)
    base = spark.createDataFrame([("d1",)], "drift_id string")
    at = F.lit("2024-01-02").cast("timestamp")
    assert normalize_updates(base) is None
    with pytest.raises(ValueError, match="unknown"):
        lw.update_drift_event(base.withColumns({"colour": F.lit("red"), "updated_at": at}), root)
    cleared = base.withColumns({"classification_conf": F.lit(None).cast("double"), "updated_at": at, "set_fields": F.array(F.lit("classification_conf"))})
    lw.update_drift_event(cleared, root)
    assert lw.drift_events_current(spark, root, committed_only=False).collect()[0].classification_conf is None


def test_list_proposed_orders_and_renders_json(spark, root):
    event(spark, root)
    row = lw.list_proposed(lw.drift_events_current(spark, root, committed_only=False)).collect()[0]
    assert row.column_before is None and row.remediation_status == "PROPOSED" and len(row) == 12


def test_required_columns_are_enforced(spark, root):
    with pytest.raises(ValueError, match="lack"):
        append_state(spark.createDataFrame([("l",)], "log_id string"), root, "sync_log")
    bad = syncs(spark, "c1").withColumn("connection_id", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="required"):
        append_state(bad, root, "sync_log")


def test_state_is_partitioned_and_pruned(spark, root):
    lw.write_sync_log(syncs(spark, "c1"), root)
    lw.write_sync_log(syncs(spark, "c1", at="2024-02-01 00:00:00"), root)
    log = lw.read_state(spark, root, "sync_log", deduplicate=False)
    recent = lw.time_window_filter(log, "synced_at", "2024-02-02", 7)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(synced_at_date" in plan and "PushedFilters: [IsNotNull(synced_at), GreaterThanOrEqual(synced_at" in plan
    assert recent.count() == 1


def test_entity_map_latest_run_only(spark, root):
    rows = spark.createDataFrame([("Customer", "c1", "public.users", "id", 0.9, ["x"], "cross_connection")], "entity_name string, connection_id string, table_key string, join_key_col string, confidence double, conflicts array<string>, analysis_mode string")
    for at in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        lw.write_entity_map(lw.entity_map_rows(rows, at), root)
    assert lw.read_state(spark, root, "entity_map").count() == 2
    assert [str(r.detected_at) for r in lw.entity_map_latest(lw.read_state(spark, root, "entity_map")).collect()] == ["2024-01-02 00:00:00"]


def test_column_snapshots_are_read_by_date_partition(spark, root):
    """The diff joins pairs to stored columns with dynamic partition pruning."""
    from landwatch.session import materialize
    from landwatch.sources.snapshots import prunable

    lw.detect_drift(syncs(spark, "c1"), landed(spark, *BASE), root, SYSTEM)
    lw.detect_drift(syncs(spark, "c1", at="2024-01-05 00:00:00"), landed(spark, *NEXT), root, SYSTEM)
    stored = lw.read_state(spark, root, "column_snapshots", deduplicate=False)
    headers = lw.read_state(spark, root, "schema_snapshots", deduplicate=False)
    wanted = materialize(headers.select("snapshot_id", "captured_at_date"), "wanted")
    joined = stored.join(prunable(wanted, "captured_at_date"), ["snapshot_id", "captured_at_date"])
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()
    assert lw.snapshot_columns(stored, lw.latest_snapshot(headers)).count() == 3
