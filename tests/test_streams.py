import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

import landwatch as lw
from landwatch.functions.crypto import hmac_sha256_hex
from landwatch.schemas import LANDED_COLUMNS
from landwatch.streaming.sync_log import stream_rejected, write_sync_log_stream

KEY = b"stream-key"


def body(**changes):
    base = {"event": "sync_end", "created": "2024-01-02T03:04:05.638Z", "connector_id": "c1", "connector_name": "n", "sync_id": "s1", "data": {"status": "SUCCESSFUL"}}
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v is not ...})


def signed(text, key=KEY):
    return (text, hmac.new(key, text.encode(), hashlib.sha256).hexdigest())


def raw(spark, *pairs):
    return spark.createDataFrame(pairs, "body string, signature string").withColumn("received_at", F.lit("2024-01-02 03:04:06").cast("timestamp"))


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long key " * 20])
@pytest.mark.parametrize("text", ["", "hello", "naïve ☃" * 50])
def test_hmac_equals_the_standard_library(spark, key, text):
    got = spark.createDataFrame([(text,)], "t string").select(hmac_sha256_hex(F.col("t"), key).alias("h")).collect()[0].h
    assert got == hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def test_routing_order(spark):
    good = body()
    cases = [
        (good, signed(good)[1], "accepted"), (good, None, "unauthorized"), (good, signed(good)[1].upper(), "unauthorized"),
        (good, signed(good, b"other")[1], "unauthorized"), (*signed(body(event="other", data=...)), "ignored_event"), (*signed("{oops"), "ignored_event"),
        (*signed(body(data={"status": "FAILURE"})), "ignored_status"), (*signed(body(data=...)), "ignored_status"), (*signed(body(connector_id=...)), "rejected"),
    ]
    df = raw(spark, *[c[:2] for c in cases]).withColumn("n", F.monotonically_increasing_id())
    got = [r.route for r in lw.route_sync_events(df, KEY).orderBy("n").collect()]
    assert got == [c[2] for c in cases]


def test_sync_rows_fall_back_to_receipt(spark):
    rows = lw.accepted_syncs(lw.route_sync_events(raw(spark, signed(body(created=..., sync_id=""))), KEY)).collect()
    assert rows[0].sync_id is None and rows[0].synced_at == rows[0].received_at


def land(spark, path, *pairs):
    raw(spark, *pairs).write.mode("append").json(path)


def test_stream_equals_batch_and_drops_redeliveries(spark, root, tmp_path):
    path = str(tmp_path / "events")
    failed_first = signed(body(sync_id="s9", data={"status": "FAILURE"}))
    pairs = [signed(body(sync_id=f"s{i % 5}", connector_id=f"c{i % 3}")) for i in range(30)] + [failed_first, signed(body(sync_id="s9"))]
    land(spark, path, *pairs)
    source = lw.sync_event_source(spark, path)
    for _ in range(2):  # the second run resumes from the checkpoint and adds only what is new
        write_sync_log_stream(lw.stream_sync_log(source, KEY), root, f"{root}-cp", available_now=True).awaitTermination()
        land(spark, path, signed(body(sync_id="late")))
    stored = {(r.connection_id, r.sync_id) for r in lw.read_state(spark, root, "sync_log", deduplicate=False).collect()}
    batch = lw.accepted_syncs(lw.route_sync_events(raw(spark, *pairs), KEY)).select("connection_id", "sync_id").distinct().collect()
    assert stored == {tuple(r) for r in batch} | {("c1", "late")} and ("c1", "s9") in stored
    assert lw.read_state(spark, root, "sync_log", deduplicate=False).count() == len(stored)


def test_late_and_future_syncs_are_all_stored_once(spark, root, tmp_path):
    path = str(tmp_path / "events")
    days = [[9, 30, 1], [4, 9, 2, 28], [3, 4, 30]]  # landed out of order in three runs, some delivered again
    for run in days:
        land(spark, path, *[signed(body(sync_id=f"s{d}", created=f"2024-01-{d:02d}T03:00:00Z")) for d in run], signed(body(sync_id="far", created="2031-01-01T00:00:00Z")))
        stream = lw.stream_sync_log(lw.sync_event_source(spark, path), KEY)
        write_sync_log_stream(stream, root, f"{root}-cp", available_now=True).awaitTermination()
    stored = [r.sync_id for r in lw.read_state(spark, root, "sync_log", deduplicate=False).collect()]
    assert sorted(stored) == sorted({f"s{d}" for run in days for d in run} | {"far"})


def test_rejected_stream_and_latency(spark, root, tmp_path):
    path = str(tmp_path / "events")
    land(spark, path, signed(body()), signed(body(connector_id=...)))
    query = stream_rejected(lw.sync_event_source(spark, path), KEY).writeStream.format("memory").queryName("rejected").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.route for r in spark.table("rejected").collect()] == ["rejected"]
    syncs = lw.accepted_syncs(lw.route_sync_events(lw.sync_event_source(spark, path), KEY))
    query = lw.stream_receiver_latency(syncs).writeStream.outputMode("complete").format("memory").queryName("latency").trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.table("latency").collect()[0]
    assert (str(row.window_start), row.n_events, row.max_latency_sec) == ("2024-01-02 03:00:00", 1, 0.362)


def test_stream_detection_finds_the_change_of_the_second_batch(spark, root, tmp_path):
    path = str(tmp_path / "events")
    versions = [[("id", "INT64")], [("id", "INT64"), ("note", "STRING")]]
    for i, cols in enumerate(versions):
        land(spark, path, signed(body(sync_id=f"s{i}")))
        rows = [("c1", "public", "t", n, k, j + 1, True) for j, (n, k) in enumerate(cols)]
        stream = lw.stream_sync_log(lw.sync_event_source(spark, path), KEY)
        lw.stream_detect_drift(stream, lambda s, rows=rows: s.createDataFrame(rows, LANDED_COLUMNS), root, f"{root}-cp", ("_sys_", "_sys_id"), available_now=True).awaitTermination()
    assert [e.change_type for e in lw.drift_events_current(spark, root, committed_only=True).collect()] == ["NEW_FIELD"]
    assert lw.read_state(spark, root, "schema_snapshots").count() == 2
