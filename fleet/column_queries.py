"""Queries over columns and rows: sensitivity, JSON, coverage, entities, docs, shims, model, streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

import landwatch as lw
from fleet.drift_queries import (
    _CLASSIFIED,
    _CLASSIFIED_COLUMNS,
    _COLLATERAL,
    _DIFF,
    _PLACE,
    _WITH_DIFF,
    changes_of,
    flat,
    new_root,
)
from fleet.inputs import AS_OF, SALT, SIGNING_KEY, ctes, stored, table
from fleet.registry import register
from fleet.signal_queries import _ACTIVE, _SIGNALS, _inputs
from landwatch.functions.crypto import hmac_sha256_hex, verify_signature
from landwatch.functions.json_text import extract_json
from landwatch.session import materialize, shared_dir
from landwatch.streaming.sync_log import write_sync_log_stream

# ---- sensitivity and masking --------------------------------------------------------------

_CLASSES = """
base AS (SELECT connection_id, table_schema || '.' || table_name AS table_key, column_name,
  regexp_replace(column_name, '_[0-9]+$', '') AS stem FROM d_named),
classed AS (SELECT connection_id, table_key, column_name,
  CASE WHEN stem IN ('email', 'phone_number', 'full_name', 'home_address', 'ip_address') THEN 'PII'
       WHEN stem IN ('account_balance', 'credit_card', 'unit_price', 'salary') THEN 'FINANCIAL'
       WHEN stem IN ('diagnosis', 'patient_id') THEN 'HEALTH' ELSE 'SAFE' END AS sensitivity_class,
  CASE WHEN stem IN ('email', 'patient_id') THEN 'HASH' WHEN stem = 'credit_card' THEN 'TOKENIZE'
       WHEN stem IN ('account_balance', 'unit_price', 'salary') THEN 'GENERALIZE'
       WHEN stem IN ('phone_number', 'full_name', 'home_address', 'ip_address', 'diagnosis') THEN 'REDACT' END AS masking_strategy
  FROM base)"""
_WITH_CLASSES = ctes("named") + "," + _CLASSES


@register("classify_sensitivity", _WITH_CLASSES + " SELECT * FROM classed")
def classify_sensitivity(spark, sf):
    return lw.classify_sensitivity(table(spark, sf, "named"))


@register("sensitivity_tier_filter", _WITH_CLASSES + " SELECT * FROM classed WHERE sensitivity_class IN ('PII', 'FINANCIAL')")
def sensitivity_tier_filter(spark, sf):
    return lw.sensitivity_tier_filter(lw.classify_sensitivity(table(spark, sf, "named")), "financial")


@register("sensitive_columns", ctes("named", "sync_log") + "," + _CLASSES + """ SELECT * FROM classed
WHERE sensitivity_class <> 'SAFE' AND connection_id IN (SELECT connection_id FROM d_sync_log)""")
def sensitive_columns(spark, sf):
    active = lw.active_connections(table(spark, sf, "sync_log"))
    return lw.sensitive_columns(table(spark, sf, "named"), "HEALTH", active=active)


def _hmac_sql(text: str, key: str) -> str:
    pad = key.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in pad).hex(), bytes(b ^ 0x5C for b in pad).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


_PLAN = {
    "c_name": "HASH",
    "c_custkey": "TOKENIZE",
    "c_acctbal": {"strategy": "GENERALIZE", "bucket": 1000},
    "c_mktsegment": {"strategy": "REDACT", "value": "***"},
}


@register("mask_columns", f"""SELECT 'tok_' || left({_hmac_sql('c_custkey::VARCHAR', SALT)}, 32) AS c_custkey, sha256('{SALT}' || c_name) AS c_name,
  c_nationkey, floor(c_acctbal / 1000) * 1000 AS c_acctbal, '***' AS c_mktsegment FROM customer""")
def mask_columns(spark, sf):
    return lw.mask_columns(table(spark, sf, "customer"), _PLAN, SALT)


@register("mask_columns_fraction", """SELECT l_orderkey, l_linenumber, (floor(round(l_discount * 100) / 5) * 5 / 100)::DOUBLE AS l_discount,
  floor(l_quantity / 7) * 7 AS l_quantity FROM lineitem""")
def mask_columns_fraction(spark, sf):
    """A bucket below one, on a column that keeps its type."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    return lw.mask_columns(lines, {"l_discount": {"strategy": "GENERALIZE", "bucket": "0.05"}, "l_quantity": {"strategy": "GENERALIZE", "bucket": 7}}, SALT)


@register("detokenize", "SELECT l_orderkey, l_linenumber, l_suppkey::VARCHAR AS l_suppkey FROM lineitem")
def detokenize(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    masked = lw.mask_columns(lines, {"l_suppkey": "TOKENIZE"}, SALT)
    return lw.detokenize(masked, "l_suppkey", lw.build_token_vault(lines, ["l_suppkey"], SALT))


# ---- JSON -----------------------------------------------------------------------------------

@register("detect_json_columns", ctes("named") + """
SELECT connection_id, table_schema || '.' || table_name AS table_key, column_name, data_type,
  CASE WHEN data_type = 'JSON' THEN 'data_type=JSON' ELSE 'STRING column name matches structured-payload pattern (' || column_name || ')' END AS reason
FROM d_named WHERE data_type = 'JSON' OR (data_type = 'STRING' AND regexp_matches(lower(column_name), 'metadata|attributes|payload'))""")
def detect_json_columns(spark, sf):
    return lw.detect_json_columns(table(spark, sf, "named"))


_SAMPLE = """sample AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_no, payload
  FROM (SELECT * FROM d_payloads WHERE payload IS NOT NULL ORDER BY event_id LIMIT 5)),
objects AS (SELECT * FROM {source} WHERE json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload ELSE '0' END) = 'OBJECT'),
keys AS (SELECT row_no, payload, unnest(json_keys(payload)) AS key FROM objects),
kinds AS (SELECT key, row_no, list_position(json_keys(payload), key) - 1 AS pos,
  CASE json_type(payload, '$."' || key || '"') WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float'
    WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' ELSE 'NoneType' END AS kind FROM keys)"""


@register("json_sample", ctes("payloads") + ", " + _SAMPLE.format(source="sample") + " SELECT row_no, payload AS value FROM sample")
def json_sample(spark, sf):
    return lw.json_sample(table(spark, sf, "payloads"), "payload", order_by="event_id")


@register("infer_json_structure", ctes("payloads") + ", " + _SAMPLE.format(source="sample") + """
SELECT key, arg_min(kind, row_no * 100000 + pos) AS json_type, min(row_no * 100000000 + pos)::BIGINT AS key_order FROM kinds GROUP BY key""")
def infer_json_structure(spark, sf):
    return lw.infer_json_structure(table(spark, sf, "payloads"), "payload", order_by="event_id")


@register("infer_json_structure_full", ctes("payloads") + ", everything AS (SELECT 0 AS row_no, payload FROM d_payloads WHERE payload IS NOT NULL), "
          + _SAMPLE.format(source="everything") + """
SELECT key, max(kind) FILTER (kind <> 'NoneType') AS json_type, min(pos)::BIGINT AS key_order FROM kinds GROUP BY key""")
def infer_json_structure_full(spark, sf):
    return lw.infer_json_structure(table(spark, sf, "payloads"), "payload", mode="full")


_OBJECT = """objects AS (SELECT event_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'OBJECT' THEN payload::JSON END END AS o FROM d_payloads)"""


@register("flatten_json", ctes("payloads") + f""", {_OBJECT}
SELECT event_id, (o->>'user')::BIGINT AS user, o->>'type' AS type, (o->>'ratio')::DOUBLE AS ratio, (o->>'ok')::BOOLEAN AS ok,
  (o->'tags')::VARCHAR AS tags, (o->'inner')::VARCHAR AS inner, o->>'note' AS note FROM objects""")
def flatten_json(spark, sf):
    rows = table(spark, sf, "payloads")
    keys = [("user", "int"), ("type", "str"), ("ratio", "float"), ("ok", "bool"), ("tags", "list"), ("inner", "dict"), ("note", "str")]
    return lw.flatten_json(rows, "payload", keys)


@register("flatten_event_props", """SELECT event_id, user_id, event_type, key, CASE json_type(v) WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' ELSE 'str' END AS json_type,
  v->>'$' AS value FROM (SELECT event_id, user_id, event_type, key, json_extract(props, '$."' || key || '"') AS v
  FROM (SELECT *, unnest(json_keys(props)) AS key FROM (SELECT event_id, user_id, event_type,
    CASE WHEN event_id % 9973 = 9001 THEN '{"k": 1, "late": "x"}' ELSE props END AS props FROM events)))""")
def flatten_event_props(spark, sf):
    """Every key of every row, one that first appears late in the table among them."""
    late = F.when(F.col("event_id") % 9973 == 9001, '{"k": 1, "late": "x"}').otherwise(F.col("props"))
    return lw.flatten_json_long(table(spark, sf, "events").select("event_id", "user_id", "event_type", late.alias("props")), "props")


@register("write_flattener_log", ctes("payloads") + ", everything AS (SELECT 0 AS row_no, payload FROM d_payloads WHERE payload IS NOT NULL), "
          + _SAMPLE.format(source="everything") + """,
s AS (SELECT key, max(kind) FILTER (kind <> 'NoneType') AS kind, min(pos) AS o FROM kinds GROUP BY key)
SELECT 'conn_1' AS connection_id, 'public.events' AS table_name, 'payload' AS column_name, 'ds.events_flat' AS view_name,
  'CREATE OR REPLACE VIEW ds.events_flat AS SELECT * EXCEPT(payload), ' || string_agg(
    CASE WHEN kind IN ('list', 'dict') THEN 'JSON_QUERY(payload, ''$."' || key || '"'')'
         WHEN kind IN ('str', 'NoneType') THEN 'JSON_VALUE(payload, ''$."' || key || '"'')'
         ELSE 'SAFE_CAST(JSON_VALUE(payload, ''$."' || key || '"'') AS ' || CASE kind WHEN 'int' THEN 'INT64' WHEN 'float' THEN 'FLOAT64' ELSE 'BOOL' END || ')' END
    || ' AS `' || key || '`', ', ' ORDER BY o, key) || ' FROM ds.events' AS view_sql, false AS deployed FROM s""")
def write_flattener_log(spark, sf):
    root = new_root(spark)
    row = lw.generate_flattener(
        table(spark, sf, "payloads"), "conn_1", "ds", "public.events", "payload", AS_OF
    )
    lw.write_flattener_log(row, root)
    return lw.read_state(spark, root, "json_flattener_log").select(
        "connection_id", "table_name", "column_name", "view_name", "view_sql", "deployed"
    )


# ---- completeness and shims ---------------------------------------------------------------

def _completeness_sql(source: str, columns: dict[str, bool]) -> str:
    rows = [
        f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, "
        + (f"count(*) FILTER (trim({c}) = '')" if text else "0::BIGINT")
        + f" AS blank_count, round((count(*) - count({c}))::DOUBLE / count(*) * 100, 2) AS missing_pct, count({c}) = 0 AS is_empty FROM {source}"
        for c, text in columns.items()
    ]
    return " UNION ALL ".join(rows)


_LINE = {c: c in ("l_returnflag", "l_linestatus") for c in (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()}


@register("column_completeness", _completeness_sql("lineitem", _LINE))
def column_completeness(spark, sf):
    return lw.column_completeness(table(spark, sf, "lineitem")).drop("approx_distinct")


@register("column_completeness_nulls", ctes("payloads") + " " + _completeness_sql("d_payloads", {"event_id": False, "payload": True}))
def column_completeness_nulls(spark, sf):
    return lw.column_completeness(table(spark, sf, "payloads")).drop("approx_distinct")


@register("column_profiles", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_distinct, true AS is_near, true AS is_same
    FROM lineitem""" for c in _LINE))
def column_profiles(spark, sf):
    """Profiles of parts, merged, beside the exact distinct counts: near them, and the same as a profile of all rows."""
    lines = table(spark, sf, "lineitem")
    part = F.col("l_linenumber") % 3
    profiles = [lw.column_profiles(lines.filter(part == k)) for k in range(3)]
    merged = lw.merge_profiles(lw.merge_profiles(profiles[0].unionByName(profiles[1])).unionByName(profiles[2]))
    whole = lw.completeness_of(lw.column_profiles(lines)).select("column_name", F.col("approx_distinct").alias("_whole"))
    exact = lines.agg(*[F.count_distinct(c).alias(c) for c in _LINE])
    counted = exact.select(F.explode(F.create_map(*[x for c in _LINE for x in (F.lit(c), F.col(c))])).alias("column_name", "n_distinct"))
    near = F.abs(F.col("approx_distinct") - F.col("n_distinct")) <= 0.08 * F.col("n_distinct")
    # Sketches merged in another order may differ in the last digits of their estimate.
    same = F.abs(F.col("approx_distinct") - F.col("_whole")) <= 0.02 * F.col("_whole")
    return lw.completeness_of(merged).join(counted, "column_name").join(whole, "column_name").select(
        "column_name", "total_rows", "null_count", "n_distinct", near.alias("is_near"), same.alias("is_same")
    )


_SHIMS = [
    {"change_type": "RENAME", "old_name": "total_amount", "new_name": "o_totalprice"},
    {"change_type": "TYPE_PROMOTION", "new_name": "o_custkey", "old_type": "STRING"},
    {"change_type": "TYPE_PROMOTION", "new_name": "o_orderstatus", "old_type": "INT64"},
    {"change_type": "DEPRECATION", "old_name": "o_clerk", "old_type": "STRING"},
    {"change_type": "NEW_FIELD", "new_name": "o_orderdate"},
]


@register("apply_shim", """SELECT *, o_totalprice AS total_amount, o_custkey::VARCHAR AS o_custkey_legacy,
  try_cast(o_orderstatus AS BIGINT) AS o_orderstatus_legacy, NULL::VARCHAR AS o_clerk FROM orders""")
def apply_shim(spark, sf):
    return lw.apply_shim(table(spark, sf, "orders"), _SHIMS)


# ---- coverage -------------------------------------------------------------------------------

_MATCHES = """
cols AS (SELECT *, replace(lower(column_name), '_', '') AS name, row_number() OVER
  (ORDER BY connection_id, table_schema, table_name, ordinal_position, column_name) AS pos FROM {columns}),
names AS (SELECT name, min(pos) AS pos FROM cols GROUP BY name),
wanted AS (SELECT entity, field, replace(replace(lower(field), '_', ''), ' ', '') AS token FROM d_required_fields),
best AS (SELECT token, min(pos) AS pos FROM (SELECT DISTINCT token FROM wanted) JOIN names ON contains(name, token) OR contains(token, name) GROUP BY token),
matches AS (SELECT w.entity, w.field, c.connection_id, c.table_schema || '.' || c.table_name AS table_key, c.column_name, c.data_type, c.pos IS NOT NULL AS is_covered
  FROM wanted w LEFT JOIN best USING (token) LEFT JOIN cols c ON c.pos = best.pos)"""
_WITH_MATCHES = ctes("part_columns", "required_fields") + "," + _MATCHES.format(columns="d_part_columns")


@register("fuzzy_field_match", _WITH_MATCHES + " SELECT * FROM matches")
def fuzzy_field_match(spark, sf):
    return lw.fuzzy_field_match(table(spark, sf, "required_fields"), table(spark, sf, "part_columns"))


@register("coverage_pct", _WITH_MATCHES + """ SELECT count(*) AS total_fields, count(*) FILTER (is_covered) AS covered_fields,
  round(count(*) FILTER (is_covered)::DOUBLE / count(*) * 100, 1) AS coverage_pct FROM matches""")
def coverage_pct(spark, sf):
    return lw.coverage_pct(lw.fuzzy_field_match(table(spark, sf, "required_fields"), table(spark, sf, "part_columns")))


@register("use_case_coverage", ctes("part_columns", "required_fields", "sync_log") + """,
live AS (SELECT * FROM d_part_columns WHERE connection_id IN (SELECT connection_id FROM d_sync_log)),""" + _MATCHES.format(columns="live")
          + " SELECT *, '' AS suggested_connector_type, '' AS why FROM matches")
def use_case_coverage(spark, sf):
    active = lw.active_connections(table(spark, sf, "sync_log"))
    return lw.use_case_coverage(table(spark, sf, "required_fields"), table(spark, sf, "part_columns"), active=active)


# ---- entities ---------------------------------------------------------------------------------

_PROFILE = """
profile AS (SELECT connection_id, table_schema || '.' || table_name AS table_key, ordinal_position, column_name, data_type, is_nullable,
  CASE WHEN table_name IN ('customers', 'users', 'accounts') THEN 'customer' WHEN table_name IN ('orders', 'purchases') THEN 'order'
       WHEN table_name IN ('suppliers', 'vendors') THEN 'supplier' ELSE left(table_name, length(table_name) - 1) END AS entity,
  replace(lower(column_name), '_', '') AS name FROM d_named),
about AS (SELECT entity, name, min(connection_id) <> max(connection_id) AS is_shared,
  CASE WHEN min(data_type) <> max(data_type) THEN name || ' has types ' || min(data_type) || ' and ' || max(data_type) END AS type_conflict,
  CASE WHEN bool_or(is_nullable) AND NOT bool_and(is_nullable) THEN name || ' is NOT NULL in one place and NULLABLE in another' END AS null_conflict
  FROM profile GROUP BY entity, name),
joined AS (SELECT p.*, is_shared, type_conflict, null_conflict, CASE WHEN lower(column_name) = entity || '_id' THEN 0 WHEN lower(column_name) = 'id' THEN 1
    WHEN ends_with(lower(column_name), '_id') THEN 2 END * 1000000 + ordinal_position AS key_rank FROM profile p JOIN about USING (entity, name)),
notes AS (SELECT entity, connection_id, table_key, string_agg(DISTINCT c, '|' ORDER BY c) AS conflicts FROM
  (SELECT entity, connection_id, table_key, type_conflict AS c FROM joined UNION ALL SELECT entity, connection_id, table_key, null_conflict FROM joined) GROUP BY ALL),
occurrences AS (SELECT entity, connection_id, table_key, count(*) AS n_columns, count(*) FILTER (is_shared) AS n_shared,
  arg_min(column_name, key_rank) FILTER (key_rank IS NOT NULL) AS join_key_col, coalesce(any_value(n.conflicts), '') AS conflicts,
  round(0.4::DOUBLE + 0.6::DOUBLE * (count(*) FILTER (is_shared)::DOUBLE / count(*)), 2) AS confidence
  FROM joined JOIN notes n USING (entity, connection_id, table_key) GROUP BY entity, connection_id, table_key)"""
_WITH_ENTITIES = ctes("named") + "," + _PROFILE


@register("entity_occurrences", _WITH_ENTITIES + " SELECT * FROM occurrences")
def entity_occurrences(spark, sf):
    return lw.entity_occurrences(stored(spark, sf, "named")).withColumn("conflicts", F.array_join("conflicts", "|"))


_OVERLAPS = """, found AS (SELECT upper(left(entity, 1)) || substr(entity, 2) AS entity_name, connection_id, table_key, join_key_col, confidence, conflicts,
  'cross_connection' AS analysis_mode FROM occurrences WHERE confidence >= 0.5 AND entity IN
  (SELECT entity FROM occurrences GROUP BY entity HAVING count(DISTINCT connection_id) > 1))"""


@register("entity_overlaps", _WITH_ENTITIES + _OVERLAPS + " SELECT * FROM found")
def entity_overlaps(spark, sf):
    return lw.entity_overlaps(stored(spark, sf, "named")).withColumn("conflicts", F.array_join("conflicts", "|"))


_NAMED_BY_MODEL = """, answered AS (SELECT o.*, split_part(table_key, '.', 2) AS t FROM occurrences o),
keyed AS (SELECT DISTINCT connection_id, table_schema || '.' || table_name AS table_key FROM d_named WHERE column_name = 'customer_id'),
found AS (SELECT upper(left(a.entity, 1)) || substr(a.entity, 2) AS entity_name, a.connection_id, a.table_key, conflicts, 'cross_connection' AS analysis_mode,
  CASE WHEN t IN ('customers', 'accounts') AND k.table_key IS NOT NULL THEN 'customer_id' ELSE join_key_col END AS join_key_col,
  CASE t WHEN 'customers' THEN 0.9 WHEN 'accounts' THEN 0.8 ELSE confidence END::DOUBLE AS confidence
  FROM answered a LEFT JOIN keyed k ON k.connection_id = a.connection_id AND k.table_key = a.table_key)
SELECT * FROM found
WHERE confidence >= 0.5 AND entity_name IN (SELECT entity_name FROM found GROUP BY entity_name HAVING count(DISTINCT connection_id) > 1)"""


@register("entity_overlaps_model", _WITH_ENTITIES + _NAMED_BY_MODEL)
def entity_overlaps_model(spark, sf):
    """A model that calls accounts clients: they meet the customers, whose tables have the same key."""
    said = {"customers": ("Customer", 0.9), "accounts": ("Client", 0.8)}

    def answer(facts):
        name, sure = said[facts["table_name"]]  # no answer for other tables
        return json.dumps({"entity_name": name, "join_key": "customer_id", "confidence": sure})

    overlaps = lw.entity_overlaps(stored(spark, sf, "named"), _facts_model(answer))
    return overlaps.withColumn("conflicts", F.array_join("conflicts", "|"))


@register("entity_overlap_pairs", _WITH_ENTITIES + """,
cols AS (SELECT DISTINCT entity, connection_id, table_key, name FROM profile),
tabs AS (SELECT entity, connection_id, table_key, count(*) AS n FROM cols GROUP BY ALL),
first AS (SELECT * FROM tabs QUALIFY row_number() OVER (PARTITION BY entity ORDER BY connection_id, table_key) = 1),
second AS (SELECT t.* FROM tabs t JOIN first f ON f.entity = t.entity AND f.connection_id <> t.connection_id
  QUALIFY row_number() OVER (PARTITION BY t.entity ORDER BY t.connection_id, t.table_key) = 1),
linked AS (SELECT t.*, a.connection_id AS anchor_connection_id, a.table_key AS anchor_table_key, a.n AS anchor_n
  FROM tabs t JOIN first a ON a.entity = t.entity AND a.connection_id <> t.connection_id
  UNION ALL SELECT t.*, b.connection_id, b.table_key, b.n FROM tabs t JOIN first a ON a.entity = t.entity AND a.connection_id = t.connection_id
  JOIN second b ON b.entity = t.entity),
common AS (SELECT l.entity, l.connection_id, l.table_key, count(*) AS n_common FROM linked l
  JOIN cols c ON c.entity = l.entity AND c.connection_id = l.connection_id AND c.table_key = l.table_key
  JOIN cols x ON x.entity = l.entity AND x.connection_id = l.anchor_connection_id AND x.table_key = l.anchor_table_key AND x.name = c.name GROUP BY ALL),
alike AS (SELECT a.entity, x.connection_id AS anchor_connection_id, x.table_key AS anchor_table_key, a.connection_id, a.table_key, count(*) AS n_common
  FROM cols a JOIN cols x ON x.entity = a.entity AND x.name = a.name AND x.connection_id > a.connection_id GROUP BY ALL),
pairs AS (SELECT s.*, n_common::DOUBLE / (t.n + x.n - n_common) AS jaccard FROM alike s
  JOIN tabs t ON t.entity = s.entity AND t.connection_id = s.connection_id AND t.table_key = s.table_key
  JOIN tabs x ON x.entity = s.entity AND x.connection_id = s.anchor_connection_id AND x.table_key = s.anchor_table_key),
held AS (SELECT entity, least(connection_id || '/' || table_key, anchor_connection_id || '/' || anchor_table_key) AS one,
  greatest(connection_id || '/' || table_key, anchor_connection_id || '/' || anchor_table_key) AS two FROM linked)
SELECT entity, anchor_connection_id, anchor_table_key, connection_id, table_key, coalesce(n_common, 0) AS n_common,
  round(coalesce(n_common, 0)::DOUBLE / (n + anchor_n - coalesce(n_common, 0)), 4) AS jaccard
FROM linked LEFT JOIN common USING (entity, connection_id, table_key)
UNION ALL SELECT entity, anchor_connection_id, anchor_table_key, connection_id, table_key, n_common, round(jaccard, 4) AS jaccard FROM pairs p
WHERE jaccard >= 0.5 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.entity = p.entity
  AND h.one = least(p.connection_id || '/' || p.table_key, p.anchor_connection_id || '/' || p.anchor_table_key)
  AND h.two = greatest(p.connection_id || '/' || p.table_key, p.anchor_connection_id || '/' || p.anchor_table_key))""")
def entity_overlap_pairs(spark, sf):
    return lw.entity_overlap_pairs(stored(spark, sf, "named"))


def _entity_map(spark, sf):
    root = new_root(spark)
    # Two runs write the same finds, which are worked out once.
    overlaps = materialize(lw.entity_overlaps(stored(spark, sf, "named")), "overlaps")
    lw.write_entity_map(lw.entity_map_rows(overlaps, "2024-01-01 00:00:00"), root)
    lw.write_entity_map(lw.entity_map_rows(overlaps.filter(F.col("entity_name") == "Customer"), "2024-01-02 00:00:00"), root)
    return lw.read_state(spark, root, "entity_map")


@register("write_entity_map", _WITH_ENTITIES + _OVERLAPS + """
SELECT entity_name, connection_id, table_key AS table_name, join_key_col, confidence, conflicts,
  CASE entity_name WHEN 'Customer' THEN 2 ELSE 1 END::BIGINT AS n_runs FROM found""")
def write_entity_map(spark, sf):
    keys = ["entity_name", "connection_id", "table_name", "join_key_col", "confidence"]
    return _entity_map(spark, sf).groupBy(*keys, F.array_join("conflicts", "|").alias("conflicts")).agg(F.count(F.lit(1)).alias("n_runs"))


@register("entity_map_latest", _WITH_ENTITIES + _OVERLAPS + """
SELECT entity_name, connection_id, table_key AS table_name, confidence, timestamp '2024-01-02 00:00:00' AS detected_at FROM found WHERE entity_name = 'Customer'""")
def entity_map_latest(spark, sf):
    return lw.entity_map_latest(_entity_map(spark, sf)).select(
        "entity_name", "connection_id", "table_name", "confidence", F.col("detected_at").cast("timestamp_ntz").alias("detected_at")
    )


# ---- docs and the model step ------------------------------------------------------------------

@register("schema_docs", ctes("named") + """
SELECT connection_id, table_schema || '.' || table_name AS table_key, ordinal_position, column_name, data_type,
  CASE WHEN lower(column_name) = 'id' OR ends_with(lower(column_name), '_id') THEN 'Identifier' WHEN data_type = 'TIMESTAMP' THEN 'Time'
    WHEN data_type IN ('JSON', 'STRUCT') THEN 'Structured value' WHEN data_type = 'INT64' THEN 'Number' ELSE 'Text' END
  || ': ' || replace(lower(column_name), '_', ' ') || ' of ' || table_name || '.' AS description FROM d_named""")
def schema_docs(spark, sf):
    return lw.schema_docs(table(spark, sf, "named"))


def _facts_model(answer):
    """A stand-in model: reads the JSON facts of its prompt and answers from them."""

    def model(prompt: str) -> str:
        return answer(json.loads(prompt.split("DATA:\n", 1)[1]))

    return model


@register("schema_docs_model", ctes("current") + """
SELECT connection_id, table_schema || '.' || table_name AS table_key, ordinal_position, column_name, data_type,
  CASE WHEN ordinal_position % 2 = 1 THEN 'about ' || column_name ELSE '' END AS description FROM d_current""")
def schema_docs_model(spark, sf):
    model = _facts_model(lambda f: json.dumps(
        [{"column_name": f["column_name"], "description": "about " + f["column_name"]}] if f["ordinal_position"] % 2 else []
    ))
    return lw.schema_docs(stored(spark, sf, "current"), model)


@register("build_prompts", _SIGNALS.format(ids=_ACTIVE) + """
SELECT connection_id, '{"connection_id":"' || connection_id || '","total_changes":' || total_changes || ',"breaking_changes":' || breaking_changes || '}' AS facts FROM signals""")
def build_prompts(spark, sf):
    signals = lw.drift_stability(lw.active_connections(table(spark, sf, "sync_log")), table(spark, sf, "drift_events"), AS_OF)
    prompts = lw.build_prompts(signals, "readiness")
    return prompts.select("connection_id", F.substring_index("prompt", "DATA:\n", -1).alias("facts"))


@register("run_model", _SIGNALS.format(ids="d_connection_ids") + """
SELECT connection_id, freshness_status, CASE freshness_status WHEN 'OK' THEN '{"grade": "a", "narrative": "fresh"}'
  WHEN 'STALE' THEN 'cannot say' END AS raw FROM signals""")
def run_model(spark, sf):
    """A model that answers, answers badly, or raises, by freshness."""
    from landwatch.plans.readiness import readiness_signals

    signals = readiness_signals(table(spark, sf, "connection_ids"), *_inputs(spark, sf), AS_OF, 6.0)
    answers = {"OK": '{"grade": "a", "narrative": "fresh"}', "STALE": "cannot say"}
    model = _facts_model(lambda f: answers[f["freshness_status"]])
    return lw.run_model(lw.build_prompts(signals, "readiness"), model).select("connection_id", "freshness_status", "raw")


@register("score_readiness_model", _SIGNALS.format(ids=_ACTIVE) + """
SELECT connection_id, CASE freshness_status WHEN 'OK' THEN 'A' ELSE '?' END AS grade,
  CASE freshness_status WHEN 'OK' THEN 'fresh' ELSE 'cannot say' END AS narrative, total_changes FROM signals""")
def score_readiness_model(spark, sf):
    answers = {"OK": '```json\n{"grade": "a", "narrative": "fresh"}\n```', "STALE": "cannot say"}
    model = _facts_model(lambda f: answers[f["freshness_status"]])
    return lw.readiness_fleet(*_inputs(spark, sf), AS_OF, model, 6.0).select("connection_id", "grade", "narrative", "total_changes")


@register("classify_changes_model", _WITH_DIFF + _COLLATERAL + f"""
SELECT {_PLACE}, before_name, after_name, change_type <> 'REORDER' AS is_valid,
  CASE WHEN change_type = 'RENAME' THEN 'DEPRECATION' ELSE change_type END AS change_type,
  CASE WHEN change_type <> 'REORDER' THEN 0.9::DOUBLE END AS classification_conf FROM collateral""")
def classify_changes_model(spark, sf):
    """A model that calls every rename a deprecation and cannot answer for reorders."""

    def answer(facts):
        kind = facts["change_type"]
        reply = {"change_type": "DEPRECATION" if kind == "RENAME" else kind, "confidence": "0.9", "rationale": "r", "remediation_sql": ""}
        return "???" if kind == "REORDER" else json.dumps(reply)

    classified = lw.classify_changes(changes_of(spark, sf), _facts_model(answer))
    return flat(classified, "is_valid", "classification_conf").drop("before_type", "after_type", "before_ordinal", "after_ordinal")


@register("merge_model_rows", ctes("named") + """, plans AS (SELECT column_name, max(data_type) AS data_type FROM d_named GROUP BY column_name)
SELECT l.connection_id, l.table_name, l.column_name, coalesce(p.data_type, 'UNKNOWN') AS said
FROM d_named l LEFT JOIN (SELECT * FROM plans WHERE data_type <> 'TIMESTAMP' AND data_type <> 'JSON') p USING (column_name)""")
def merge_model_rows(spark, sf):
    landed = table(spark, sf, "named").select("connection_id", "table_name", "column_name")
    said = table(spark, sf, "named").groupBy("column_name").agg(F.max("data_type").alias("said"))
    return lw.merge_model_rows(landed, said.filter(~F.col("said").isin("TIMESTAMP", "JSON")), ["column_name"], {"said": "UNKNOWN"})


@register("extract_json", ctes("replies") + """
SELECT event_id, CASE WHEN starts_with(raw, '```') THEN trim(replace(replace(raw, '```json', ''), '```', '')) ELSE trim(raw) END AS reply FROM d_replies""")
def extract_json_query(spark, sf):
    return table(spark, sf, "replies").select("event_id", extract_json(F.col("raw")).alias("reply"))


@register("validate_classification", ctes("replies") + """
SELECT event_id, contains(raw, '0.75') OR contains(raw, '"0.5"') AS is_valid,
  CASE WHEN contains(raw, '0.75') THEN 'NEW_FIELD' WHEN contains(raw, '"0.5"') THEN 'RENAME' END AS change_type,
  CASE WHEN contains(raw, '0.75') THEN 0.75::DOUBLE WHEN contains(raw, '"0.5"') THEN 0.5::DOUBLE END AS classification_conf,
  CASE WHEN contains(raw, '0.75') OR contains(raw, '"0.5"') THEN NULL WHEN contains(raw, '1.5') THEN 'confidence is out of range'
    WHEN contains(raw, 'MERGE') THEN 'unknown change type' WHEN contains(raw, 'REORDER') THEN 'the reply lacks a required key'
    ELSE 'the reply is not a JSON object' END AS error FROM d_replies""")
def validate_classification(spark, sf):
    return lw.validate_classification(table(spark, sf, "replies")).select("event_id", "is_valid", "change_type", "classification_conf", "error")


@register("with_fallbacks", ctes("grade_replies") + """
SELECT event_id, CASE WHEN contains(raw, '" b "') THEN 'B' ELSE '?' END AS grade,
  CASE WHEN contains(raw, 'text') THEN 'just text' WHEN contains(raw, '"z"') THEN 'n' ELSE json_extract_string(raw, '$.narrative') END AS narrative,
  CASE WHEN contains(raw, '" b "') THEN 'one,two,three' ELSE '' END AS remediations FROM d_grade_replies""")
def with_fallbacks(spark, sf):
    return lw.with_fallbacks(table(spark, sf, "grade_replies"), "readiness").select(
        "event_id", "grade", "narrative", F.array_join("top_remediations", ",").alias("remediations")
    )


# ---- sync events and streams -------------------------------------------------------------------

_KEY = SIGNING_KEY.encode()
#: A landed file is compressed and read by one task.
EVENTS_A_FILE = 100_000


def _raw_events(spark, sf):
    good = hmac_sha256_hex(F.col("body"), _KEY)
    return table(spark, sf, "bodies").withColumn(
        "signature", F.when(F.col("sender") == "good", good).when(F.col("sender") == "forged", F.upper(good))
    )


_SIGNED = f"""signed AS (SELECT *, CASE sender WHEN 'good' THEN {_hmac_sql('body', SIGNING_KEY)} WHEN 'forged' THEN upper({_hmac_sql('body', SIGNING_KEY)}) END AS signature FROM d_bodies)"""


@register("verify_signature", ctes("bodies") + f", {_SIGNED} SELECT event_id, signature, sender = 'good' AS is_genuine FROM signed")
def verify_signature_query(spark, sf):
    return _raw_events(spark, sf).select("event_id", "signature", verify_signature(F.col("body"), F.col("signature"), _KEY).alias("is_genuine"))


_ROUTED = """routed AS (SELECT *, CASE WHEN sender <> 'good' THEN 'unauthorized' WHEN body = '{broken' OR contains(body, 'sync_start') THEN 'ignored_event'
  WHEN contains(body, 'FAILURE') THEN 'ignored_status' WHEN NOT contains(body, 'connector_id') THEN 'rejected' ELSE 'accepted' END AS route FROM d_bodies)"""


@register("route_sync_events", ctes("bodies") + f""", {_ROUTED}
SELECT event_id, route, CASE route WHEN 'unauthorized' THEN 401 ELSE 200 END AS http_status,
  CASE route WHEN 'unauthorized' THEN 'invalid signature' WHEN 'ignored_event' THEN 'ignored' WHEN 'ignored_status' THEN 'ignored: non-successful sync'
    WHEN 'accepted' THEN 'ok' ELSE 'rejected: no connector_id' END AS reply FROM routed""")
def route_sync_events(spark, sf):
    return lw.route_sync_events(_raw_events(spark, sf), _KEY).select("event_id", "route", "http_status", "reply")


def _land(spark, sf, path, part=None):
    """The raw events as JSON files, as a receiver would land them: all, or those of one half."""
    events = _raw_events(spark, sf)
    if part is not None:
        events = events.filter(F.col("event_id") % 4 >= 1 if part else F.col("event_id") % 4 <= 1)
    events.select("body", "signature", F.col("received_at").cast("timestamp").alias("received_at")).write.mode("append").option(
        "maxRecordsPerFile", EVENTS_A_FILE
    ).json(path, compression="gzip")


def _landing(spark, sf):
    path = f"{shared_dir(spark).rstrip('/')}/landwatch/landing-{uuid.uuid4().hex}"
    _land(spark, sf, path)
    return path


@register("sync_event_source", ctes("bodies") + f", {_SIGNED} SELECT body, signature, date_trunc('millisecond', received_at) AS received_at FROM signed")
def sync_event_source(spark, sf):
    source = lw.sync_event_source(spark, _landing(spark, sf), streaming=False)
    return source.withColumn("received_at", F.date_trunc("MILLISECOND", F.col("received_at")).cast("timestamp_ntz"))


_ACCEPTED = f"""{_ROUTED}, accepted AS (SELECT DISTINCT json_extract_string(body, '$.connector_id') AS connection_id,
  nullif(json_extract_string(body, '$.sync_id'), '') AS sync_id, left(json_extract_string(body, '$.created'), 19)::TIMESTAMP AS synced_at
  FROM routed WHERE route = 'accepted')"""


@register("stream_sync_log", ctes("bodies") + f", {_ACCEPTED} SELECT * FROM accepted")
def stream_sync_log(spark, sf):
    """Signed events with times all over a month, landed out of order in two runs that share
    some of them: every sync is in the log once."""
    root, path = new_root(spark), f"{new_root(spark)}-landing"
    for part in (0, 1):
        _land(spark, sf, path, part)
        stream = lw.stream_sync_log(lw.sync_event_source(spark, path), _KEY)
        write_sync_log_stream(stream, root, f"{root}-checkpoint", available_now=True).awaitTermination()
    in_utc = F.to_utc_timestamp("synced_at", F.current_timezone())
    return lw.read_state(spark, root, "sync_log", deduplicate=False).select(
        "connection_id", "sync_id", in_utc.cast("timestamp_ntz").alias("synced_at")
    )


@register("stream_detect_drift", ctes("prior", "current", "bodies").replace("WITH ", "WITH RECURSIVE ", 1) + "," + _DIFF + f""", {_ROUTED},
synced AS (SELECT json_extract_string(body, '$.connector_id') AS connection_id FROM routed WHERE route = 'accepted'
  GROUP BY 1 HAVING bool_or(event_id % 4 <= 1) AND bool_or(event_id % 4 >= 1))"""
  + _CLASSIFIED + f" SELECT {_CLASSIFIED_COLUMNS} FROM classified WHERE connection_id IN (SELECT connection_id FROM synced)")
def stream_detect_drift(spark, sf):
    """Streamed events drive detection: a first run stores the baseline of the connections that
    synced, a second one finds what changed in those that sync again."""
    root, path = new_root(spark), f"{new_root(spark)}-landing"
    for part, side in ((0, "prior"), (1, "current")):
        _land(spark, sf, path, part)
        stream = lw.stream_sync_log(lw.sync_event_source(spark, path), _KEY)
        lw.stream_detect_drift(
            stream, lambda s, side=side: stored(s, sf, side), root, f"{root}-checkpoint", ("_sys_", "_sys_id"), available_now=True, compact_every=1
        ).awaitTermination()
    return lw.drift_events_current(spark, root).select(
        "connection_id", "table_schema", "table_name", "change_type", F.col("column_before.column_name").alias("before_name"),
        F.col("column_after.column_name").alias("after_name"), "classification_conf", "rationale", "remediation_sql",
    )


