import json
import random

import pytest
from pyspark.sql import functions as F

import landwatch as lw
from landwatch.operators.entities import entity_of_table
from landwatch.operators.jsonflat import structure_to_list
from landwatch.schemas import LANDED_COLUMNS


def landed(spark, *rows):
    """Rows (connection, table, column, type[, nullable])."""
    full = [(r[0], "public", r[1], r[2], r[3], i + 1, r[4] if len(r) > 4 else True) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, LANDED_COLUMNS)


def test_landed_columns_from_the_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.sql("CREATE TABLE IF NOT EXISTS shop.orders (order_id INT, amount DECIMAL(10,2), at TIMESTAMP, tags ARRAY<STRING>) USING parquet")
    got = [(r.connection_id, r.table_name, r.column_name, r.data_type, r.ordinal_position) for r in lw.landed_columns(spark, {"c1": "shop"}).collect()]
    assert got == [("c1", "orders", "order_id", "INT64", 1), ("c1", "orders", "amount", "NUMERIC", 2), ("c1", "orders", "at", "TIMESTAMP", 3), ("c1", "orders", "tags", "ARRAY<STRING>", 4)]


@pytest.mark.parametrize("value, expected", [("YES", True), ("yes", True), ("NO", False), (None, False)])
def test_nullable_text(spark, value, expected):
    df = spark.createDataFrame([(value, "3")], "is_nullable string, ordinal_position string")
    assert [tuple(r) for r in lw.normalize_column_rows(df).collect()] == [(expected, 3)]


def test_destination_fallbacks(spark):
    conns = spark.createDataFrame([("a", "s", "p"), ("b", "", "p"), ("c", None, "")], "connection_id string, config_schema string, schema_prefix string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "connection_id string")
    got = {r.connection_id: r.destination_schema for r in lw.resolve_destination(asked, conns, "").collect()}
    assert got == {"a": "s", "b": "p", "c": "public", "d": "public"}


@pytest.mark.parametrize(
    "name, klass, strategy",
    [
        ("email", "PII", "HASH"), ("phone_number", "PII", "REDACT"), ("account_balance", "FINANCIAL", "GENERALIZE"),
        ("diagnosis", "HEALTH", "REDACT"), ("patient_id", "HEALTH", "HASH"), ("credit_card", "FINANCIAL", "TOKENIZE"),
        ("created_at", "SAFE", None), ("phonetic", "SAFE", None), ("event_name", "SAFE", None), ("Date Of Birth", "PII", "GENERALIZE"),
    ],
)
def test_sensitivity_rules(spark, name, klass, strategy):
    got = lw.classify_sensitivity(landed(spark, ("c", "t", name, "STRING"))).collect()[0]
    assert (got.sensitivity_class, got.masking_strategy) == (klass, strategy)


def test_tiers(spark):
    df = spark.createDataFrame([("PII",), ("FINANCIAL",), ("health",), ("SAFE",), ("ODD",)], "sensitivity_class string")
    pick = lambda tier: sorted(r[0] for r in lw.sensitivity_tier_filter(df, tier).collect())
    assert pick("pii") == pick("nonsense") == ["PII"]
    assert pick("HEALTH") == ["FINANCIAL", "PII", "health"] and "ODD" not in pick("SAFE") and len(pick("SAFE")) == 4


def test_sensitivity_model_overrides_what_it_names(spark):
    model = lambda p: '[{"table": "public.t", "column": "x", "sensitivity_class": "health", "masking_strategy": "REDACT"}]'
    got = {r.column_name: r.sensitivity_class for r in lw.classify_sensitivity(landed(spark, ("c", "t", "x", "STRING"), ("c", "t", "email", "STRING")), model).collect()}
    assert got == {"x": "HEALTH", "email": "PII"}
    bad = {r.column_name: r.sensitivity_class for r in lw.classify_sensitivity(landed(spark, ("c", "t", "email", "STRING")), lambda p: "sorry").collect()}
    assert bad == {"email": "PII"}


def test_masking_and_reading_back(spark):
    df = spark.createDataFrame([("ann", 34, "4111", None), ("bob", -1, "4111", "x")], "name string, age int, card string, note string")
    plan = {"name": "HASH", "age": {"strategy": "GENERALIZE", "bucket": 10}, "card": "TOKENIZE", "note": "REDACT"}
    masked = lw.mask_columns(df, plan, "s")
    rows = masked.collect()
    assert [r.age for r in rows] == [30, -10] and rows[0].card == rows[1].card != "4111" and rows[1].note is None
    assert sorted(r.card for r in lw.detokenize(masked, "card", lw.build_token_vault(df, ["card"], "s")).collect()) == ["4111", "4111"]
    with pytest.raises(ValueError):
        lw.mask_columns(df, {"nope": "HASH"}, "s")


def test_generalized_numbers_keep_their_type(spark):
    df = spark.sql("SELECT 0.37D AS d, -0.37D AS m, 12.34BD AS x, 7 AS i, true AS b, CAST('NaN' AS DOUBLE) AS n")
    plan = {c: {"strategy": "GENERALIZE", "bucket": 0.1} for c in ("d", "m", "x", "n")} | {"i": {"strategy": "GENERALIZE", "bucket": 5}}
    masked = lw.mask_columns(df, plan, "s")
    assert masked.dtypes == df.dtypes
    assert [str(v) for v in masked.first()] == ["0.3", "-0.4", "12.30", "5", "True", "None"]
    for bad in ({"b": "GENERALIZE"}, {"i": {"strategy": "GENERALIZE", "bucket": 0}}):
        with pytest.raises(ValueError):
            lw.mask_columns(df, bad, "s")


@pytest.mark.parametrize("name", ["metadata", "properties", "attributes", "payload", "details", "extras", "config", "context", "user_metadata", "Event_Payload_v2"])
def test_payload_names(spark, name):
    assert lw.detect_json_columns(landed(spark, ("c", "t", name, "STRING"))).count() == 1
    assert lw.detect_json_columns(landed(spark, ("c", "t", name, "INT64"))).count() == 0


def test_json_type_in_any_case_and_plain_names(spark):
    got = lw.detect_json_columns(landed(spark, ("c", "t", "data", "json"), *[("c", "t", n, "STRING") for n in ("email", "customer_id", "amount", "created_at")])).collect()
    assert [(r.column_name, r.reason) for r in got] == [("data", "data_type=JSON")]


def payloads(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, p string")


def test_structure_takes_the_first_kind_and_keeps_key_order(spark):
    df = payloads(spark, '{"user_id": 1, "action": null, "page": "/home"}', '{"action": "click", "score": 1.5, "ok": true, "l": [1], "d": {}}', "[1]", "broken")
    assert structure_to_list(lw.infer_json_structure(df, "p", order_by="id")) == [
        ("user_id", "int"), ("action", "NoneType"), ("page", "str"), ("score", "float"), ("ok", "bool"), ("l", "list"), ("d", "dict")
    ]
    full = dict(structure_to_list(lw.infer_json_structure(df, "p", mode="full")))
    assert full["action"] == "str" and full["l"] == "list"


def test_full_structure_widens_and_empty_has_the_placeholder(spark):
    df = payloads(spark, '{"a": 1, "b": 1, "c": "x", "n": null}', '{"a": 1.5, "b": {"z": 1}, "c": true, "n": null}')
    assert dict(structure_to_list(lw.infer_json_structure(df, "p", mode="full"))) == {"a": "float", "b": "dict", "c": "str", "n": "NoneType"}
    for mode in ("sample", "full"):
        assert structure_to_list(lw.infer_json_structure(payloads(spark, "nope", None), "p", mode=mode, order_by="id")) == [("_unknown_key", "str")]


def test_flatten_casts_safely_and_renames_clashes(spark):
    df = payloads(spark, '{"id": 7, "K": "x", "k": "y", "n": "12", "t": {"a": [1]}, "s": {"in": 1}, "w.d": "dot"}', '{"n": "1.7", "s": "{text", "n2": 1}', "broken")
    structure = [("id", "int"), ("K", "str"), ("k", "str"), ("n", "int"), ("t", "dict"), ("s", "str"), ("w.d", "str")]
    out = lw.flatten_json(df, "p", structure)
    assert out.columns == ["id", "id_2", "K", "k_2", "n", "t", "s", "w.d"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [
        (0, 7, "x", "y", 12, '{"a":[1]}', None, "dot"), (1, None, None, None, None, None, "{text", None), (2, None, None, None, None, None, None, None)
    ]


def test_long_form_keeps_every_key_of_every_row(spark):
    texts = [json.dumps({f"k{i}_{j}": j for j in range(300)}) for i in range(20)] + ['{"late": {"x": [1]}, "n": null}', "[1]", "broken", "{}", None]
    out = lw.flatten_json_long(payloads(spark, *texts), "p")
    assert out.columns == ["id", "key", "json_type", "value"] and out.select("key").distinct().count() == 6002
    assert [tuple(r) for r in out.filter("id = 20").orderBy("key").collect()] == [(20, "late", "dict", '{"x":[1]}'), (20, "n", "NoneType", None)]
    with pytest.raises(ValueError):
        lw.flatten_json_long(out.withColumnRenamed("id", "p"), "p")


def test_flatten_view_text(spark):
    structure = spark.createDataFrame([("tags", "list", 2), ("user_id", "int", 1), ("page", "str", 3)], "key string, json_type string, key_order int")
    view = lw.flatten_view("ds", "public.events", "data", structure).first().asDict()
    assert view["view_name"] == "ds.events_flat" and view["estimated_columns"] == 3
    assert "SAFE_CAST(JSON_VALUE(data, '$.\"user_id\"') AS INT64) AS `user_id`" in view["view_sql"] and "JSON_QUERY(data" in view["view_sql"] and "* EXCEPT(data)" in view["view_sql"]


def brute_match(fields, cols):
    out = {}
    for f in fields:
        token = f.lower().replace("_", "").replace(" ", "")
        hit = next((c for c in sorted(cols, key=lambda c: (c[0], c[1], c[3])) if token in c[2].lower().replace("_", "") or c[2].lower().replace("_", "") in token), None)
        out[f] = hit[:3] if hit else None
    return out


def test_fuzzy_match_equals_brute_force(spark):
    cols = [("c2", "users", "id", 1), ("c1", "tickets", "ticket_id", 1), ("c1", "tickets", "User_ID", 2), ("c1", "customers", "email", 2), ("c1", "customers", "subscription_plan", 3), ("c3", "x", "paid amount", 1)]
    df = spark.createDataFrame([(c, "public", t, n, "STRING", o, True) for c, t, n, o in cols], LANDED_COLUMNS)
    fields = ["paid_amount", "email address", "E MAIL", "userid", "plan", "login_count", "", "paidamount", "naïve"]
    required = spark.createDataFrame([("e", f) for f in fields], "entity string, field string")
    got = {r.field: (r.connection_id, r.table_key.split(".")[1], r.column_name) if r.is_covered else None for r in lw.fuzzy_field_match(required, df).collect()}
    assert got == brute_match(fields, cols)


def test_fuzzy_match_of_long_names_stays_linear(spark):
    from landwatch.operators.coverage import GRAM, _containing

    rng = random.Random(5)
    names = ["".join(rng.choices("abcd", k=300)) for _ in range(20)]
    fields = [n[rng.randrange(200):][: rng.randint(1, 90)] for n in names] + ["z" * 300, "ab"]
    holders = spark.createDataFrame([(n,) for n in names], "holder string")
    held = spark.createDataFrame([(f,) for f in set(fields)], "held string")
    got = {(r.holder, r.held) for r in _containing(holders, held).collect()}
    assert got == {(n, f) for n in names for f in fields if f in n}
    exploded = _containing(holders, spark.createDataFrame([("a",)], "held string")).count()
    assert exploded <= 20 and GRAM * 300 < 300 * 301 / 2


def test_coverage_percent(spark):
    df = landed(spark, ("c", "customers", "id", "INT64"), ("c", "customers", "email", "STRING"), ("c", "customers", "subscription_plan", "STRING"))
    required = spark.createDataFrame([("Customer", "email"), ("Customer", "plan"), ("Login", "zz_top")], "entity string, field string")
    got = lw.coverage_summary(lw.use_case_coverage(required, df)).collect()[0]
    assert (got.total_fields, got.covered_fields, got.coverage_pct) == (3, 2, 66.7)
    empty = lw.coverage_summary(lw.use_case_coverage(required.limit(0), df)).collect()[0]
    assert empty.coverage_pct == 0.0 and empty.narrative.startswith("No required fields")
    advised = lw.use_case_coverage(required, df, lambda p: '{"suggested_connector_type": "app", "why": "logins"}').collect()
    assert {r.field: r.suggested_connector_type for r in advised} == {"email": "", "plan": "", "zz_top": "app"}


def test_required_fields_from_a_model(spark):
    reply = '[{"entity": "Customer", "required_fields": ["email", "plan"], "why": "w"}]'
    assert sorted(tuple(r) for r in lw.required_fields(spark, "churn", lambda p: reply).collect()) == [("Customer", "email"), ("Customer", "plan")]
    assert lw.required_fields(spark, "churn", lambda p: "no idea").count() == 0


@pytest.mark.parametrize("table, entity", [("users", "customer"), ("crm_accounts", "customer"), ("Companies", "company"), ("order_2024", "order"), ("addresses", "address"), ("status", "statu"), ("boxes", "box")])
def test_entity_names(spark, table, entity):
    assert spark.range(1).select(entity_of_table(F.lit(table)).alias("e")).collect()[0].e == entity


def test_entity_modes(spark):
    a = [("c1", "users", "user_id", "INT64", False), ("c1", "users", "email", "STRING", False), ("c1", "users", "created_at", "TIMESTAMP")]
    b = [("c2", "accounts", "account_id", "INT64"), ("c2", "accounts", "email", "STRING", True), ("c2", "accounts", "created_at", "DATE"), ("c2", "gizmos", "id", "INT64")]
    both = lw.entity_overlaps(landed(spark, *a, *b)).collect()
    assert {(r.entity_name, r.connection_id, r.join_key_col, r.analysis_mode) for r in both} == {("Customer", "c1", "user_id", "cross_connection"), ("Customer", "c2", "account_id", "cross_connection")}
    assert {c for r in both for c in r.conflicts} == {"createdat has types DATE and TIMESTAMP", "email is NOT NULL in one place and NULLABLE in another"}
    one = lw.entity_overlaps(landed(spark, *a)).collect()
    assert [(r.entity_name, r.analysis_mode) for r in one] == [("Customer", "single_connection")]
    assert lw.entity_overlaps(landed(spark, *a).limit(0)).count() == 0
    pairs = lw.entity_overlap_pairs(landed(spark, *a, *b)).collect()
    assert sorted((p.anchor_table_key, p.table_key, p.n_common, p.jaccard) for p in pairs) == [
        ("public.accounts", "public.users", 2, 0.5), ("public.users", "public.accounts", 2, 0.5)
    ]


def test_every_table_with_a_counterpart_elsewhere_has_a_row(spark):
    a = [("c1", t, n, "STRING") for t in ("customers", "clients") for n in ("id", "email")] + [("c2", "users", "id", "STRING"), ("c3", "orders", "id", "STRING")]
    pairs = lw.entity_overlap_pairs(landed(spark, *a)).collect()
    assert sorted((p.table_key, p.anchor_table_key) for p in pairs) == [
        ("public.clients", "public.users"), ("public.customers", "public.users"), ("public.users", "public.clients")
    ]


def test_schema_docs(spark):
    df = landed(spark, ("c", "users", "user_id", "INT64"), ("c", "users", "email", "STRING"))
    assert lw.schema_docs(df).filter("column_name = 'user_id'").collect()[0].description == "Identifier: user id of users."
    said = {r.column_name: r.description for r in lw.schema_docs(df, lambda p: '```json\n[{"column_name": "email", "description": "Mail"}]\n```').collect()}
    assert said == {"email": "Mail", "user_id": ""}


CASES = [
    ('{"change_type": "RENAME", "confidence": 0.5, "rationale": "r", "remediation_sql": ""}', None),
    ('```json\n{"change_type": "RENAME", "confidence": "1", "rationale": "r", "remediation_sql": ""}\n```', None),
    ('```\n{"change_type": "RENAME", "confidence": 0, "rationale": 5, "remediation_sql": null}\n```', None),
    ('{"change_type": "RENAME", "confidence": 1.01, "rationale": "r", "remediation_sql": ""}', "out of range"),
    ('{"change_type": "RENAME", "confidence": "high", "rationale": "r", "remediation_sql": ""}', "not a number"),
    ('{"change_type": "rename", "confidence": 0.5, "rationale": "r", "remediation_sql": ""}', "unknown"),
    ('{"change_type": "RENAME", "confidence": 0.5, "rationale": "r"}', "lacks"),
    ("[1]", "not a JSON object"), ("plain", "not a JSON object"), (None, "failed"),
]


@pytest.mark.parametrize("raw, error", CASES)
def test_reply_contract(spark, raw, error):
    got = lw.validate_classification(spark.createDataFrame([(raw,)], "raw string")).collect()[0]
    assert got.is_valid == (error is None) and (error is None or error in got.error)


def test_merge_never_multiplies_rows(spark):
    base = spark.createDataFrame([("a",), ("b",)], "k string")
    said = spark.createDataFrame([("a", "x"), ("a", "y")], "k string, v string")
    assert sorted(tuple(r) for r in lw.merge_model_rows(base, said, ["k"], {"v": "UNKNOWN"}).collect()) == [("a", "y"), ("b", "UNKNOWN")]


def test_wide_decimals_stay_text():
    from landwatch.functions.types import spark_type_of

    assert [spark_type_of(t) for t in ("BIGNUMERIC", "BIGNUMERIC(76,38)", "BIGNUMERIC(38,10)", "NUMERIC(10)", "NUMERIC")] == [
        "string", "string", "decimal(38,10)", "decimal(10,0)", "decimal(38,9)"
    ]
