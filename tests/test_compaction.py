"""Folded state: compaction changes what is read, never what is found."""


import pytest
from pyspark.sql import functions as F

import landwatch as lw
from landwatch.sources import folded
from landwatch.sources.state import _folded_events, append_state
from tests.test_state import BASE, NEXT, SYSTEM, event, landed, syncs


def update(spark, root, drift_id, at, **fields):
    row = spark.createDataFrame([(drift_id,)], "drift_id string").withColumns({n: F.lit(v) for n, v in fields.items()})
    lw.update_drift_event(row.withColumn("updated_at", F.lit(at).cast("timestamp")), root)


def now(spark, root):
    rows = lw.drift_events_current(spark, root, committed_only=False).collect()
    return sorted((r.drift_id, r.remediation_status, r.approved_by, r.classification_conf, str(r.updated_at)) for r in rows)


def read_files(df):
    return {f.split("://")[-1] for f in df.inputFiles()}


def test_events_are_the_same_whenever_compacted(spark, tmp_path):
    roots = [str(tmp_path / f"r{k}") for k in range(2)]
    for k, root in enumerate(roots):
        event(spark, root, "d1")
        update(spark, root, "d1", "2024-01-03", remediation_status="APPROVED", approved_by="ann")
        update(spark, root, "d3", "2024-01-02", approved_by="early")  # of an event that comes later
        if k:
            lw.compact_state(spark, root)
        event(spark, root, "d2")
        event(spark, root, "d1")  # a replay
        update(spark, root, "d1", "2024-01-02", approved_by="late", classification_conf=0.1)  # older than what is folded
        update(spark, root, "d2", "2024-01-04", remediation_status="REJECTED")
        if k:
            lw.compact_state(spark, root)
            assert now(spark, root)
            lw.compact_state(spark, root)
        event(spark, root, "d3")
    assert now(spark, roots[0]) == now(spark, roots[1])
    assert now(spark, roots[1]) == [
        ("d1", "APPROVED", "ann", 0.1, "2024-01-03 00:00:00"),
        ("d2", "REJECTED", None, 0.5, "2024-01-04 00:00:00"),
        ("d3", "PROPOSED", "early", 0.5, "2024-01-02 00:00:00"),
    ]


def test_folded_generations_are_not_read(spark, root):
    for d in range(1, 6):
        event(spark, root, f"d{d}")
    lw.compact_state(spark, root)
    lw.compact_state(spark, root)  # the first one's generations leave the tail
    event(spark, root, "d9")
    current = lw.drift_events_current(spark, root, committed_only=False)
    assert current.count() == 6
    assert not any("generation=0" in f for f in read_files(current))


def test_dead_compactions_and_late_writers(spark, root, monkeypatch):
    event(spark, root, "d1")
    late = folded.read_pointer(spark, root, "drift")
    before, _ = folded.open_generation(spark, root, "drift")  # a run that dies after this
    assert folded.read_pointer(spark, root, "drift").generation == 1 and len(now(spark, root)) == 1
    path = f"{folded._pointers(root, 'drift')}/{99:012d}.json"
    hadoop, fs = folded._folder(spark, path)
    fs.create(hadoop, False).close()  # a pointer without content
    assert folded.read_pointer(spark, root, "drift").version == 1
    lw.compact_state(spark, root)
    # A writer that had looked at the pointer before both writes into the old generation.
    monkeypatch.setattr("landwatch.sources.state.read_pointer", lambda *a: folded.Pointer(generation=1))
    event(spark, root, "d2")
    monkeypatch.undo()
    assert [r[0] for r in now(spark, root)] == ["d1", "d2"] and late.generation == before.generation == 0
    lw.compact_state(spark, root)
    assert [r[0] for r in now(spark, root)] == ["d1", "d2"]


def test_only_one_compaction_publishes(spark, root):
    event(spark, root, "d1")
    pointer = folded.read_pointer(spark, root, "drift")
    folded.publish(spark, root, "drift", folded.Pointer(pointer.version + 1))
    with pytest.raises(Exception, match="exist"):
        folded.publish(spark, root, "drift", folded.Pointer(pointer.version + 1))


def test_detection_reads_the_heads_only(spark, root):
    """400 earlier dates of headers, and the newest ones come from the base."""
    days = spark.range(400).select(
        F.concat(F.lit("s"), "id").alias("snapshot_id"), F.concat(F.lit("c"), F.col("id") % 7).alias("connection_id"), F.lit("public").alias("destination_schema"),
        F.expr("timestamp'2022-01-01 00:00:00' + cast(id AS int) * interval '1' day").alias("captured_at"), F.lit("sync_end").alias("trigger_event"),
        F.lit("h").alias("content_hash"),
    )
    append_state(days, root, "schema_snapshots")
    lw.compact_state(spark, root)
    lw.compact_state(spark, root)
    heads = lw.head_snapshots(spark, root)
    assert {r.snapshot_id for r in heads.collect()} == {f"s{k}" for k in range(393, 400)}
    assert len(read_files(heads)) <= 7 and not any("captured_at_date" in f for f in read_files(heads))
    lw.detect_drift(syncs(spark, "c1"), landed(spark, *BASE), root, SYSTEM)
    lw.compact_state(spark, root)
    events = lw.detect_drift(syncs(spark, "c1", at="2024-01-02 00:00:00"), landed(spark, *NEXT), root, SYSTEM)
    assert sorted(e.change_type for e in events.collect()) == ["NEW_FIELD", "TYPE_PROMOTION"]
    assert lw.drift_events_current(spark, root).count() >= 2


@pytest.mark.parametrize("replayed", [1, 5])
def test_events_without_updates_stay_where_they_are(spark, root, replayed):
    """Replays, late events and early updates come together whatever part of the tail the base holds."""
    update(spark, root, "d8", "2024-01-02", approved_by="early")
    lw.compact_state(spark, root)
    lw.compact_state(spark, root)  # the update leaves the tail
    lw.compact_state(spark, root)
    for d in range(6):
        event(spark, root, f"d{d}")
    moved = _folded_events(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(drift_id" not in moved.split("Initial Plan")[-1]
    event(spark, root, "d0")  # a replay in the same generation
    before = now(spark, root)
    lw.compact_state(spark, root)
    assert now(spark, root) == before and [r[0] for r in before] == [f"d{d}" for d in range(6)]
    lw.compact_state(spark, root)
    for d in (*range(replayed), 7, 8):
        event(spark, root, f"d{d}")
    before = now(spark, root)
    lw.compact_state(spark, root)
    lw.compact_state(spark, root)
    assert now(spark, root) == before
    assert [r[0] for r in before] == [*(f"d{d}" for d in range(6)), "d7", "d8"] and {r[2] for r in before if r[0] == "d8"} == {"early"}
    base = spark.read.parquet(folded.read_pointer(spark, root, "drift").base)
    assert base.where("_known").count() == base.count() == 8
    assert all(f.endswith(".zstd.parquet") for f in read_files(base))
