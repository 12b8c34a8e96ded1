"""What is moved and stored stays in proportion to what changes, not to ids, texts and files beside it."""

import glob

import landwatch as lw
from pyspark.sql import functions as F

from landwatch.plans.detect import _each_once
from landwatch.session import shared_dir
from test_state import BASE, NEXT, SYSTEM, landed, syncs


def stages(spark, name):
    return set(glob.glob(f"{shared_dir(spark)}/landwatch/{name}-*"))


def test_changed_columns_hold_no_ids_and_no_name_twice(spark, root):
    lw.detect_drift(syncs(spark, "c1"), landed(spark, *BASE), root, SYSTEM)
    before = stages(spark, "changed-columns")
    events = lw.detect_drift(syncs(spark, "c1", at="2024-01-02 00:00:00"), landed(spark, *NEXT), root, SYSTEM).collect()
    new, = stages(spark, "changed-columns") - before
    schema = spark.read.parquet(new).schema
    assert not {"from_snapshot_id", "to_snapshot_id", "connection_id"} & set(schema.names)
    assert "column_name" not in schema["before"].dataType.names
    assert {e.connection_id for e in events} == {"c1"} and {len(e.from_snapshot_id) for e in events} == {64}
    promoted, = [e for e in events if e.change_type == "TYPE_PROMOTION"]
    assert promoted.column_before.table_name == "orders" and promoted.column_before.column_name == "amount"


def test_repeated_events_are_returned_once(spark):
    rows = spark.range(6).select(F.concat(F.lit("d"), (F.col("id") % 4).cast("string")).alias("drift_id"), F.lit("x").alias("t"))
    assert sorted(r.drift_id for r in _each_once(rows).collect()) == ["d0", "d1", "d2", "d3"]
    once = rows.filter("drift_id = 'd3'")
    plan = _each_once(once)._jdf.queryExecution().toString()
    assert _each_once(once).count() == 1 and "Aggregate" not in plan  # nothing is moved where nothing repeats


def test_known_connections_are_stored_and_new_ones_left_out(spark):
    before = stages(spark, "known")
    current = landed(spark, *NEXT).unionByName(landed(spark, *NEXT, conn="c2"))
    got = lw.plan_drift(landed(spark, *BASE), current).collect()
    assert {r.connection_id for r in got} == {"c1"} and len(stages(spark, "known") - before) == 1


def test_a_history_has_as_many_files_as_dates_and_tasks(spark, root):
    day = lambda c: F.expr(f"timestamp'2024-01-01 08:00:00' + make_dt_interval(cast({c} % 30 as int))")
    headers = spark.range(900).select(
        F.concat(F.lit("s"), "id").alias("snapshot_id"), F.concat(F.lit("c"), F.col("id") % 7).alias("connection_id"), F.lit("public").alias("destination_schema"),
        day("id").alias("captured_at"), F.lit("sync_end").alias("trigger_event"), F.lit("h").alias("content_hash"),
    )
    columns = headers.select(
        "snapshot_id", "connection_id", F.lit("public").alias("table_schema"), F.lit("t").alias("table_name"), F.lit("id").alias("column_name"),
        F.lit("INT64").alias("data_type"), F.lit(1).alias("ordinal_position"), "captured_at",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lw.write_snapshot(headers, columns, root)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for table in ("schema_snapshots", "column_snapshots"):
        files = glob.glob(f"{root}/{table}/**/*.parquet", recursive=True)
        assert 30 <= len(files) <= 30 + 4
        stored = lw.read_state(spark, root, table, deduplicate=False)
        assert stored.select("snapshot_id").distinct().count() == stored.count() == 900
        assert stored.where("captured_at_date != to_date(captured_at)").isEmpty()
