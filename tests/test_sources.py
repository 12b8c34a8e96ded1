"""Landed columns from footers, mergeable profiles, views in parts, entity names, consumers, orders."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import landwatch as lw
from landwatch.operators.entities import merged_names
from landwatch.plans.entity_map import COLUMNS_ASKED, entity_questions
from landwatch.schemas import LANDED_COLUMNS


def write(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def test_footers_of_a_tree_of_tables(spark, tmp_path):
    write(tmp_path / "c1/public/orders/part-0.parquet", id=[1], total=[1.5])
    write(tmp_path / "c1/public/orders/day=2/part-1.parquet", id=[1], total=["x"], note=["y"])
    write(tmp_path / "c2/sales/users.parquet", name=["n"], tags=[["a"]])
    (tmp_path / "c2/sales/readme.txt").write_text("no table")
    (tmp_path / "c2/sales/empty").mkdir()
    (tmp_path / "_temporary/x/y").mkdir(parents=True)
    import os

    os.utime(tmp_path / "c1/public/orders/part-0.parquet", (1, 1))  # the other file is the newer one
    for tasks in (1, 5):
        got = lw.landed_columns_from_footers(spark, str(tmp_path), tasks=tasks)
        assert got.schema == LANDED_COLUMNS
        assert sorted(tuple(r) for r in got.collect()) == [
            ("c1", "public", "orders", "id", "INT64", 1, True), ("c1", "public", "orders", "note", "STRING", 3, True),
            ("c1", "public", "orders", "total", "STRING", 2, True), ("c2", "sales", "users", "name", "STRING", 1, True),
            ("c2", "sales", "users", "tags", "ARRAY<STRING>", 2, True),
        ]
    with pytest.raises(Exception, match="table_name"):
        lw.landed_columns_from_footers(spark, str(tmp_path), levels="connection_id").collect()


def test_profiles_merge_in_any_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "", " ", "x", f"v{i % 700}"]), i % 5, [i % 3], {"k": i}) for i in range(4000)]
    df = spark.createDataFrame(rows, "s string, n int, a array<int>, m map<string,int>")
    parts = [lw.column_profiles(df.where(F.col("n") == k)).withColumn("day", F.lit(k)) for k in range(5)]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])
    merged = {r["column_name"]: r for r in lw.completeness_of(lw.merge_profiles(union)).collect()}
    direct = {r["column_name"]: r for r in lw.column_completeness(df).collect()}
    for name in ("s", "n", "a", "m"):
        for field in ("total_rows", "null_count", "blank_count", "missing_pct", "is_empty"):
            assert merged[name][field] == direct[name][field]
    exact = len({r[0] for r in rows} - {None})
    assert abs(merged["s"]["approx_distinct"] - exact) <= 0.05 * exact and merged["n"]["approx_distinct"] == 5
    assert merged["a"]["approx_distinct"] == 3 and merged["m"]["approx_distinct"] is None
    assert lw.completeness_of(lw.merge_profiles(union, ("day",))).where("day = 3 AND column_name = 'n'").first()["approx_distinct"] == 1
    empty = {r["column_name"]: r for r in lw.completeness_of(lw.merge_profiles(lw.column_profiles(df.limit(0)))).collect()}
    assert empty["s"]["total_rows"] == 0 and empty["s"]["missing_pct"] == 0.0 and not empty["s"]["is_empty"]


def test_view_of_a_million_keys_comes_in_parts(spark):
    structure = spark.range(1_000_000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("int").alias("json_type"), F.col("id").alias("key_order"))
    parts = lw.flatten_view_parts("ds", "public.events", "data", structure)
    sizes = parts.agg(F.sum("n_columns"), F.max("n_columns"), F.count("*")).first()
    assert sizes[0] == 1_000_000 and sizes[1] <= 1000 and sizes[2] >= 1000
    at = parts.select("part", F.regexp_extract("text", "`k([0-9]+)`", 1).alias("first")).where("first != ''").orderBy("part").collect()
    assert [int(r["first"]) for r in at] == sorted(int(r["first"]) for r in at)


def test_view_parts_are_the_view(spark):
    rows = [(f"k{i}", "str", i) for i in range(2500)]
    structure = spark.createDataFrame(rows, "key string, json_type string, key_order int").repartition(7)
    texts = [r["text"] for r in lw.flatten_view_parts("ds", "public.events", "data", structure, 100).orderBy("part").collect()]
    view = lw.flatten_view("ds", "public.events", "data", structure).first()
    items = ", ".join(f"JSON_VALUE(data, '$.\"k{i}\"') AS `k{i}`" for i in range(2500))
    assert "".join(texts) == view["view_sql"] == f"CREATE OR REPLACE VIEW ds.events_flat AS SELECT * EXCEPT(data), {items} FROM ds.events"
    assert view["estimated_columns"] == 2500


def test_structure_of_rows_with_many_keys(spark):
    texts = [(i, json.dumps({f"k{i}_{j}": 1 for j in range(3)})) for i in range(30_000)]
    df = spark.createDataFrame(texts, "id long, p string")
    orders = [r["key_order"] for r in lw.infer_json_structure(df, "p", "sample", "id", n=25_000).collect()]
    assert len(orders) == 75_000 and len(set(orders)) == 75_000 and min(orders) >= 0


def landed(spark, *rows):
    return spark.createDataFrame([(c, "public", t, n, "STRING", i, True) for c, t, ns in rows for i, n in enumerate(ns, 1)], LANDED_COLUMNS)


def test_names_are_merged_over_links(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("z", "z"), (None, "x")], "a string, b string")
    got = {r["name"]: r["entity"] for r in merged_names(links, spark.createDataFrame([("n030",), ("q",)], "name string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n030"} and got["x"] == got["y"] == "x" and got["z"] == "z"


def test_client_and_customer_meet(spark):
    tables = landed(
        spark, ("c1", "customers", ["customer_id", "email", "city"]), ("c2", "mandanten", ["mandant_nr", "customer_id", "email"]),
        ("c3", "widgets", ["id", "email"]), ("c4", "widgets", ["id", "colour"]),
    )
    said = {"mandanten": ("Client", "customer_id"), "customers": ("Customer", "customer_id")}

    def model(prompt):
        f = json.loads(prompt.split("DATA:\n", 1)[1])
        assert set(f) == {"table_name", "columns"} and set(f["columns"][0]) == {"name", "type"}
        name, key = said[f["table_name"]]
        return json.dumps({"entity_name": name, "join_key": key, "confidence": 0.9})

    got = {r["table_key"]: r for r in lw.entity_overlaps(tables, model).collect()}
    assert got["public.mandanten"]["entity_name"] == got["public.customers"]["entity_name"] == "Customer"
    assert got["public.mandanten"]["join_key_col"] == "customer_id" and got["public.customers"]["confidence"] == 0.9
    assert got["public.widgets"]["entity_name"] == "Widget"
    assert "public.mandanten" not in {r["table_key"] for r in lw.entity_overlaps(tables).collect()}


def test_questions_about_wide_tables_are_short(spark):
    wide = landed(spark, ("c1", "t", [f"c{i}" for i in range(3 * COLUMNS_ASKED + 1)]))
    pieces = entity_questions(wide).collect()
    assert len(pieces) == 4 and max(len(p["columns"]) for p in pieces) == COLUMNS_ASKED
    assert sum(len(p["columns"]) for p in pieces) == 3 * COLUMNS_ASKED + 1


def test_consumers_stand_beside_the_changes(spark):
    before, after = landed(spark, ("c1", "t", ["a", "b"]), ("c1", "u", ["a"])), landed(spark, ("c1", "t", ["a"]), ("c1", "u", ["a", "z"]))
    readers = spark.createDataFrame([("c1", "public", "t", f"job{i:02}") for i in range(30)] * 2 + [("c1", "public", "t", None), ("c9", "public", "u", "other")],
                                    "connection_id string, table_schema string, table_name string, consumer string")
    got = {r["table_name"]: r for r in lw.classify_changes(lw.diff_columns(before, after), consumers=readers).collect()}
    assert got["t"]["n_consumers"] == 30 and got["t"]["downstream_consumers"] == [f"job{i:02}" for i in range(20)]
    assert got["t"]["rationale"] == "b was dropped. Downstream readers of the table: 30." and got["u"]["rationale"] == "z is new."
    seen = []
    told = lw.classify_changes(lw.diff_columns(before, after), lambda p: json.dumps(
        {"change_type": "DEPRECATION", "confidence": 0.7, "rationale": ",".join(json.loads(p.split("DATA:\n", 1)[1])["downstream_consumers"]), "remediation_sql": ""}), consumers=readers)
    assert {r["table_name"]: r["rationale"].count("job") for r in told.collect()} == {"t": 20, "u": 0} and not seen


def test_sensitive_columns_are_ordered_by_tier_then_place(spark):
    tables = landed(spark, ("c2", "t", ["email", "salary", "diagnosis"]), ("c1", "t", ["salary", "phone_number", "email"]), ("c1", "a", ["email", "colour"]))
    got = [(r["sensitivity_class"], r["connection_id"], r["table_key"], r["column_name"]) for r in lw.sensitive_columns(tables, "HEALTH", ordered=True).collect()]
    rank = {"PII": 0, "FINANCIAL": 1, "HEALTH": 2}
    assert got == sorted(got, key=lambda r: (rank[r[0]], *r[1:])) and {r[0] for r in got} == set(rank)


def test_volatility_is_ordered_by_rate_then_connection(spark):
    rows = [(f"c{i % 7}", "RENAME", "2024-01-20") for i in range(20)] + [("c9", "NEW_FIELD", "2024-01-21")] * 3
    events = spark.createDataFrame(rows, "connection_id string, change_type string, at string").withColumn("detected_at", F.col("at").cast("timestamp"))
    got = [(r["changes_per_week"], r["connection_id"]) for r in lw.drift_volatility(events, "2024-01-31", ordered=True).collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and len(got) == 8


def test_only_folders_of_the_synced_connections_are_read(spark, tmp_path):
    path = str(tmp_path / "landed")
    fleet = landed(spark, *[(f"c{i}", "t", ["a", "b"]) for i in range(60)])
    lw.write_landed(fleet, path, 16)
    syncs = spark.createDataFrame([("c3",), ("c3",), ("unknown",)], "connection_id string")
    got = lw.read_landed(spark, path, syncs, 16)
    assert got.columns == LANDED_COLUMNS.names and sorted(r["column_name"] for r in got.collect()) == ["a", "b"]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert lw.read_landed(spark, path, buckets=16).count() == 120
    with pytest.raises(ValueError):
        lw.read_landed(spark, path, buckets=32)
    lw.write_landed(fleet.limit(2), path, 16)
    assert lw.read_landed(spark, path, buckets=16).count() == 2
