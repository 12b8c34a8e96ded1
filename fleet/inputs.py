"""State tables and landed metadata derived from the given tables.

Each derivation is one SQL text in the dialect Spark and DuckDB share; ``{name}`` stands for
a table or another derivation. Spark runs it over DataFrames, the SQL checks use it as a CTE.
Sizes grow with the data, and landed tables keep a realistic width at any scale: an order is
a landed table and its lines are the columns.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from landwatch.session import free_shuffles, materialize

AS_OF = "2024-01-31 00:00:00"
SLA_HOURS = 6.0
SIGNING_KEY = "fleet-signing-key"
SYSTEM_PREFIX, SYSTEM_SUFFIX = "_sys_", "_sys_id"
SALT = "salt"

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

COLUMN_NAMES = (
    "id email phone_number account_balance diagnosis created_at user_metadata payload col1 "
    "order_total status customer_id credit_card full_name event_name home_address is_active "
    "unit_price patient_id Extra_Attributes x2 ip_address notes salary"
).split()
TABLE_NAMES = (
    "customers orders products suppliers events tickets employees payments users accounts "
    "purchases vendors"
).split()


def _pick(expression: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expression} % {len(values)} {cases} END"


DERIVED: dict[str, str] = {
    # One row per successful sync: an event that is not an error. The id repeats for some
    # rows, as redelivered events do.
    "sync_log": """
        SELECT 'log_' || cast(event_id AS string) AS log_id,
               'conn_' || cast(user_id AS string) AS connection_id,
               cast(event_id AS string) AS sync_id,
               ts AS synced_at,
               ts + (event_id % 90) * interval '1' second AS received_at
        FROM {events} WHERE event_type <> 'error'""",
    "connection_ids": """
        SELECT 'conn_' || cast(c_custkey AS string) AS connection_id FROM {customer}""",
    "drift_events": """
        SELECT 'drift_' || cast(event_id AS string) AS drift_id,
               'conn_' || cast(user_id AS string) AS connection_id,
               ts AS detected_at,
               'snap_' || cast(event_id AS string) AS from_snapshot_id,
               'snap_' || cast(event_id + 1 AS string) AS to_snapshot_id,
               'public' AS table_schema,
               't_' || cast(user_id AS string) AS table_name,
               CASE event_type WHEN 'view' THEN 'TYPE_PROMOTION' WHEN 'error' THEN 'DEPRECATION'
                    WHEN 'signup' THEN 'RENAME' WHEN 'click' THEN 'REORDER' ELSE 'NEW_FIELD' END AS change_type,
               cast((event_id % 100) AS double) / 100 AS classification_conf,
               'seen ' || event_type AS rationale,
               '' AS remediation_sql,
               CASE WHEN value < 5 THEN 'APPROVED' WHEN value < 10 THEN 'REJECTED' ELSE 'PROPOSED' END AS remediation_status,
               ts AS updated_at
        FROM {events}""",
    "failures": """
        SELECT 'fail_' || cast(event_id AS string) AS log_id,
               'conn_' || cast(user_id AS string) AS connection_id,
               cast(event_id AS string) AS sync_id,
               CASE WHEN event_id % 8 = 7 THEN NULL ELSE 'E' || cast(event_id % 8 AS string) END AS error_code,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS error_message,
               ts AS failed_at,
               cast(NULL AS string) AS table_name
        FROM {events} WHERE event_type = 'error'""",
    # Landed columns: an order is a table, its lines are the columns. One connection holds
    # a third of them; the others hold 250 tables each.
    "fleet_base": """
        SELECT l_orderkey, l_partkey, min(l_linenumber) AS line, min(ascii(l_returnflag)) AS flag,
               max(ascii(l_linestatus)) AS status, cast(max(l_quantity) AS bigint) AS qty,
               max(l_discount) AS discount
        FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    "fleet_names": """
        SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'conn_hot'
                    ELSE 'conn_' || cast(cast(floor(l_orderkey / 250.0) AS bigint) AS string) END AS connection_id,
               'public' AS table_schema,
               't_' || cast(l_orderkey AS string) AS table_name,
               'col_' || cast(l_partkey AS string) AS column_name,
               CASE qty % 4 WHEN 0 THEN 'INT64' WHEN 1 THEN 'STRING' WHEN 2 THEN 'TIMESTAMP' ELSE 'BIGNUMERIC' END AS old_type,
               discount, flag, status, line, qty, l_partkey
        FROM {fleet_base}""",
    # Open 'A' lines are columns added since the prior snapshot, open 'R' lines were removed.
    "prior": """
        SELECT connection_id, table_schema, table_name, column_name, old_type AS data_type,
               cast(row_number() OVER (PARTITION BY connection_id, table_schema, table_name ORDER BY line, l_partkey) AS bigint) AS ordinal_position,
               qty > 25 AS is_nullable
        FROM {fleet_names} WHERE NOT (flag = ascii('A') AND status = ascii('O'))""",
    "current": """
        SELECT connection_id, table_schema, table_name, column_name,
               CASE WHEN discount > 0.085 THEN 'STRING' ELSE old_type END AS data_type,
               cast(row_number() OVER (PARTITION BY connection_id, table_schema, table_name ORDER BY line, l_partkey) AS bigint) AS ordinal_position,
               qty > 20 AS is_nullable
        FROM {fleet_names} WHERE NOT (flag = ascii('R') AND status = ascii('O'))""",
    # Metadata rows as an information schema gives them, some of the loader's own columns too.
    "metadata_rows": """
        SELECT connection_id, table_schema, table_name,
               CASE WHEN qty = 7 THEN '_sys_' || column_name WHEN qty = 8 THEN column_name || '_sys_id'
                    WHEN qty = 9 THEN column_name || '_sys_x' ELSE column_name END AS column_name,
               old_type AS data_type, cast(line AS string) AS ordinal_position,
               CASE qty % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'yes' ELSE 'NO' END AS is_nullable
        FROM {fleet_names}""",
    # Descriptive names for the per-column rules: twelve named tables per connection.
    "named": f"""
        SELECT 'conn_' || cast(cast(floor(l_orderkey / 12.0) AS bigint) AS string) AS connection_id,
               'public' AS table_schema,
               {_pick("l_orderkey", TABLE_NAMES)} AS table_name,
               {_pick("l_partkey", COLUMN_NAMES)} || CASE WHEN qty % 10 = 3 THEN '_' || cast(l_partkey AS string) ELSE '' END AS column_name,
               CASE WHEN qty % 13 = 0 THEN 'JSON' WHEN qty % 13 = 1 THEN 'STRUCT' WHEN qty % 13 < 5 THEN 'INT64'
                    WHEN qty % 13 = 5 THEN 'TIMESTAMP' ELSE 'STRING' END AS data_type,
               cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY line, l_partkey) AS bigint) AS ordinal_position,
               qty > 25 AS is_nullable
        FROM {{fleet_base}}""",
    # Snapshot history: an order is a snapshot of its customer's connection, its lines the columns.
    "snapshots": """
        SELECT 'snap_' || cast(o_orderkey AS string) AS snapshot_id,
               CASE WHEN o_custkey % 3 = 0 THEN 'conn_hot' ELSE 'conn_' || cast(o_custkey AS string) END AS connection_id,
               'name ' || cast(o_custkey AS string) AS connection_name,
               'public' AS destination_schema,
               o_orderdate AS captured_at,
               'sync_end' AS trigger_event,
               o_orderstatus AS sync_id,
               cast(1 AS bigint) AS column_count,
               o_orderpriority AS content_hash
        FROM {orders}""",
    "snapshot_column_rows": """
        SELECT 'snap_' || cast(b.l_orderkey AS string) AS snapshot_id, s.connection_id,
               'public' AS table_schema,
               't_' || cast(b.l_partkey % 3 AS string) AS table_name,
               'col_' || cast(b.l_partkey % 40 AS string) AS column_name,
               CASE b.qty % 4 WHEN 0 THEN 'INT64' WHEN 1 THEN 'STRING' WHEN 2 THEN 'TIMESTAMP' ELSE 'BIGNUMERIC' END AS data_type,
               b.l_partkey AS ordinal_position,
               b.qty > 25 AS is_nullable
        FROM {fleet_base} b JOIN {snapshots} s ON s.snapshot_id = 'snap_' || cast(b.l_orderkey AS string)""",
    "connections": """
        SELECT 'conn_' || cast(c_custkey AS string) AS connection_id,
               CASE WHEN c_nationkey < 5 THEN '' WHEN c_nationkey < 10 THEN NULL ELSE lower(c_mktsegment) END AS config_schema,
               CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 3000 THEN NULL ELSE 'prefix_' || lower(c_mktsegment) END AS schema_prefix
        FROM {customer}""",
    "connector_status": """
        SELECT 'conn_' || cast(c_custkey AS string) AS connection_id,
               CASE WHEN c_nationkey < 5 THEN 'error' WHEN c_nationkey < 8 THEN 'broken' ELSE 'scheduled' END AS sync_state,
               cast(CASE WHEN c_acctbal < 0 THEN 7 WHEN c_acctbal < 1000 THEN 2 ELSE 0 END AS bigint) AS n_tasks,
               lower(c_mktsegment) AS task_code
        FROM {customer}""",
    # Signed bodies; some are failed syncs, other events, unreadable, or without a connection.
    "bodies": """
        SELECT event_id, ts AS received_at,
               CASE WHEN value < 1 THEN '{{broken'
                    WHEN value < 2 THEN '{{"event":"sync_end","sync_id":"s","data":{{"status":"SUCCESSFUL"}}}}'
                    ELSE '{{"event":"' || CASE event_type WHEN 'click' THEN 'sync_start' ELSE 'sync_end' END
                      || '","created":"2024-01-' || lpad(cast(1 + cast(floor(event_id / 2.0) AS bigint) * 11 % 28 AS string), 2, '0')
                      || 'T03:04:05.000Z","connector_id":"conn_' || cast(user_id AS string)
                      || '","connector_name":"name","sync_id":"' || CASE WHEN value < 3 THEN '' ELSE cast(cast(floor(event_id / 2.0) AS bigint) AS string) END
                      || '","data":{{"status":"' || CASE event_type WHEN 'error' THEN 'FAILURE' ELSE 'SUCCESSFUL' END || '"}}}}'
               END AS body,
               CASE WHEN value > 50 THEN 'forged' WHEN value > 45 THEN 'missing' ELSE 'good' END AS sender
        FROM {events}""",
    # Payload objects with every kind of value.
    "payloads": """
        SELECT event_id,
               CASE WHEN value < 1 THEN '[1, 2]' WHEN value < 2 THEN 'not json' WHEN value < 3 THEN NULL
                    ELSE '{{"user": ' || cast(user_id AS string)
                      || ', "type": "' || event_type || '"'
                      || ', "ratio": ' || CASE WHEN user_id % 2 = 0 THEN '1.5' ELSE '2.25' END
                      || ', "ok": ' || CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END
                      || ', "tags": ["a", "b"], "inner": {{"k": 1}}'
                      || CASE WHEN event_type = 'view' THEN ', "note": null' ELSE ', "note": "n' || cast(user_id AS string) || '"' END
                      || '}}' END AS payload
        FROM {events}""",
    "required_fields": """
        SELECT DISTINCT p_brand AS entity, CASE WHEN p_size <= 25 THEN p_name ELSE p_brand END AS field FROM {part}""",
    "part_columns": """
        SELECT 'conn_' || cast(cast(floor(p_partkey / 100.0) AS bigint) AS string) AS connection_id,
               lower(p_type) AS table_schema,
               't_' || cast(p_size AS string) AS table_name,
               CASE WHEN p_size > 10 THEN upper(replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '_') || '_old' END AS column_name,
               'STRING' AS data_type, p_partkey AS ordinal_position, p_size > 20 AS is_nullable
        FROM {part}""",
    # Model replies of every quality, one per event.
    "replies": """
        SELECT event_id,
               CASE WHEN value < 2 THEN 'no json here'
                    WHEN value < 4 THEN '```json {{"change_type": "RENAME", "confidence": "0.5", "rationale": "r", "remediation_sql": ""}} ```'
                    WHEN value < 6 THEN '{{"change_type": "RENAME", "confidence": 1.5, "rationale": "r", "remediation_sql": ""}}'
                    WHEN value < 8 THEN '{{"change_type": "MERGE", "confidence": 0.5, "rationale": "r", "remediation_sql": ""}}'
                    WHEN value < 10 THEN '{{"change_type": "REORDER", "confidence": 0.5, "rationale": "r"}}'
                    ELSE '  {{"change_type": "NEW_FIELD", "confidence": 0.75, "rationale": "' || event_type || '", "remediation_sql": "x"}}  ' END AS raw
        FROM {events}""",
    "grade_replies": """
        SELECT event_id,
               CASE WHEN value < 3 THEN ' just text ' WHEN value < 6 THEN '{{"grade": "z", "narrative": "n"}}'
                    ELSE '{{"grade": " b ", "narrative": "' || event_type || '", "top_remediations": ["one", "two", "three", "four"]}}' END AS raw
        FROM {events}""",
}


# An order's lines are brought together before they are grouped, so that grouping and numbering
# them take one shuffle.
TOGETHER = {"fleet_base": ("lineitem", "l_orderkey")}


def _references(text: str) -> list[str]:
    return [name for _, name, _, _ in Formatter().parse(text) if name]


def table(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A given table or a derivation as a lazy DataFrame; ``known`` holds derivations that are stored already."""
    if known and name in known:
        return known[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    text = DERIVED[name]
    inputs = {ref: table(spark, sf_dir, ref, known) for ref in set(_references(text))}
    if name in TOGETHER:
        ref, key = TOGETHER[name]
        inputs[ref] = inputs[ref].repartition(key)
    return spark.sql(text, **inputs)


def stored(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A derivation written as a table first, as landed metadata is in production, for
    operators that read it more than once."""
    kept = materialize(table(spark, sf_dir, name, known), name)
    free_shuffles(spark)
    return kept


def ctes(*names: str) -> str:
    """``WITH`` clause defining the given derivations and all they use."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for ref in _references(DERIVED[name]):
            visit(ref)
        ordered.append(name)

    for n in names:
        visit(n)
    parts = []
    for n in ordered:
        text = DERIVED[n]
        # A CTE may shadow a table of the same name, so derivations get a prefix.
        refs = {r: r if r in TABLES else f"d_{r}" for r in _references(text)}
        parts.append(f"d_{n} AS ({text.format(**refs)})")
    return "WITH " + ",\n".join(parts)
