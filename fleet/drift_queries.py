"""Queries over snapshots, diffs, classification and detection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import landwatch as lw
from fleet.inputs import AS_OF, SYSTEM_PREFIX, SYSTEM_SUFFIX, TABLES, ctes, stored, table
from fleet.registry import register
from landwatch.session import shared_dir
from landwatch.sources.state import append_state


def new_root(spark):
    """A fresh state folder in the cluster's shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/landwatch/state-{uuid.uuid4().hex}"


def flat(changes, *extra, keys=("connection_id",)):
    """A change frame with one plain column per compared attribute."""
    return changes.select(
        *keys, "table_schema", "table_name", "change_type",
        *[F.col(f"{side}.{f}").alias(f"{side}_{n}") for side in ("before", "after")
          for f, n in (("column_name", "name"), ("data_type", "type"), ("ordinal_position", "ordinal"))],
        *extra,
    )


# ---- metadata ---------------------------------------------------------------------------

_NORMAL = ctes("metadata_rows") + """
SELECT connection_id, table_schema, table_name, column_name, data_type,
       cast(ordinal_position AS bigint) AS ordinal_position, upper(is_nullable) = 'YES' AS is_nullable
FROM d_metadata_rows"""


@register("landed_columns", _NORMAL)
def landed_columns(spark, sf):
    return lw.landed_columns_from_rows(table(spark, sf, "metadata_rows"))


_GIVEN = ", ".join(f"'{t}'" for t in TABLES)


@register("landed_columns_from_footers", f"""
SELECT 'given' AS connection_id, 'public' AS table_schema, table_name, column_name,
  CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'INT64' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'FLOAT64' WHEN data_type = 'VARCHAR' THEN 'STRING'
    WHEN data_type = 'TIMESTAMP' THEN 'DATETIME' WHEN data_type IN ('FLOAT[]', 'DOUBLE[]') THEN 'ARRAY<FLOAT64>' WHEN data_type = 'BOOLEAN' THEN 'BOOL' ELSE data_type END AS data_type,
  cast(ordinal_position AS BIGINT) AS ordinal_position, true AS is_nullable
FROM information_schema.columns WHERE table_name IN ({_GIVEN})""")
def landed_columns_from_footers(spark, sf):
    """The columns of the given tables, read by the tasks from the tables' own footers."""
    return lw.landed_columns_from_footers(spark, sf, "table_name", connection_id="given")


@register("landed_of_syncs", ctes("current", "sync_log") + """
SELECT c.* FROM d_current c WHERE connection_id IN (SELECT connection_id FROM d_sync_log WHERE synced_at >= TIMESTAMP '2024-01-25 00:00:00')""")
def landed_of_syncs(spark, sf):
    """Columns of the connections that synced lately, from a store laid out by connection."""
    path = new_root(spark)
    lw.write_landed(table(spark, sf, "current"), path, 16)
    syncs = table(spark, sf, "sync_log").filter(F.col("synced_at") >= F.lit("2024-01-25 00:00:00"))
    return lw.read_landed(spark, path, syncs, 16)


@register("normalize_column_rows", _NORMAL)
def normalize_column_rows(spark, sf):
    return lw.normalize_column_rows(table(spark, sf, "metadata_rows"))


@register("schema_by_table", ctes("current") + """
SELECT connection_id, table_schema || '.' || table_name AS table_key, count(*) AS n_columns,
       string_agg(column_name || ':' || data_type, ',' ORDER BY ordinal_position) AS columns
FROM d_current GROUP BY ALL""")
def schema_by_table(spark, sf):
    return lw.schema_by_table(table(spark, sf, "current")).select(
        "connection_id", "table_key", F.size("columns").cast("bigint").alias("n_columns"),
        F.array_join(F.transform("columns", lambda c: F.concat(c["column_name"], F.lit(":"), c["data_type"])), ",").alias("columns"),
    )


@register("exclude_system_columns", ctes("metadata_rows") + f"""
SELECT connection_id, table_schema, table_name, column_name, data_type FROM d_metadata_rows
WHERE NOT (starts_with(column_name, '{SYSTEM_PREFIX}') OR ends_with(column_name, '{SYSTEM_SUFFIX}'))""")
def exclude_system_columns(spark, sf):
    return lw.exclude_system_columns(table(spark, sf, "metadata_rows"), SYSTEM_PREFIX, SYSTEM_SUFFIX).select(
        "connection_id", "table_schema", "table_name", "column_name", "data_type"
    )


@register("resolve_destination", ctes("sync_log", "connections") + """
SELECT a.connection_id, coalesce(nullif(c.config_schema, ''), nullif(c.schema_prefix, ''), 'public') AS destination_schema
FROM (SELECT DISTINCT connection_id FROM d_sync_log) a LEFT JOIN d_connections c USING (connection_id)""")
def resolve_destination(spark, sf):
    return lw.resolve_destination(
        lw.active_connections(table(spark, sf, "sync_log")), table(spark, sf, "connections")
    )


@register("active_connections", ctes("sync_log") + " SELECT DISTINCT connection_id FROM d_sync_log")
def active_connections(spark, sf):
    return lw.active_connections(table(spark, sf, "sync_log"))


# ---- snapshots --------------------------------------------------------------------------

_LATEST = """latest AS (SELECT * FROM d_snapshots QUALIFY
  row_number() OVER (PARTITION BY connection_id ORDER BY captured_at DESC, snapshot_id DESC) = 1)"""


@register("latest_snapshot", ctes("snapshots") + f", {_LATEST} SELECT * FROM latest")
def latest_snapshot(spark, sf):
    return lw.latest_snapshot(table(spark, sf, "snapshots"))


@register("snapshot_columns", ctes("snapshots", "snapshot_column_rows") + f""", {_LATEST}
SELECT snapshot_id, connection_id, table_schema, table_name, column_name,
       arg_max(data_type, ordinal_position) AS data_type, max(ordinal_position) AS ordinal_position,
       arg_max(is_nullable, ordinal_position) AS is_nullable
FROM d_snapshot_column_rows WHERE snapshot_id IN (SELECT snapshot_id FROM latest)
GROUP BY ALL""")
def snapshot_columns(spark, sf):
    latest = lw.latest_snapshot(table(spark, sf, "snapshots"))
    return lw.snapshot_columns(table(spark, sf, "snapshot_column_rows"), latest)


@register("snapshot_pairs", ctes("snapshots") + """
SELECT * FROM (SELECT connection_id,
  lag(snapshot_id) OVER w AS from_snapshot_id, snapshot_id AS to_snapshot_id,
  lag(captured_at) OVER w AS from_captured_at, captured_at AS to_captured_at
  FROM d_snapshots WINDOW w AS (PARTITION BY connection_id ORDER BY captured_at, snapshot_id))
WHERE from_snapshot_id IS NOT NULL""")
def snapshot_pairs(spark, sf):
    return lw.snapshot_pairs(table(spark, sf, "snapshots"))


_HASH = """SELECT connection_id, count(*) AS column_count,
  '2:' || sha256(count(*) || '|' || sum(('0x' || h[1:15])::UBIGINT::HUGEINT) || '|' || sum(('0x' || h[17:31])::UBIGINT::HUGEINT)) AS content_hash
FROM (SELECT connection_id, md5(length(table_schema) || ':' || table_schema || length(table_name) || ':' || table_name
    || length(column_name) || ':' || column_name || length(data_type) || ':' || data_type
    || length(ordinal_position::VARCHAR) || ':' || ordinal_position) AS h FROM d_{side}) GROUP BY connection_id"""


@register("content_hash", ctes("current") + _HASH.format(side="current"))
def content_hash(spark, sf):
    return lw.content_hash(stored(spark, sf, "current"))


def _headers(df, suffix):
    return lw.content_hash(df).select(
        "connection_id", F.concat("connection_id", F.lit(suffix)).alias("snapshot_id"), "content_hash",
        F.to_timestamp_ntz(F.lit(AS_OF)).alias("captured_at"),
    )


@register("hash_gate", ctes("prior", "current") + f""",
hp AS ({_HASH.format(side='prior')}), hc AS ({_HASH.format(side='current')})
SELECT connection_id, hc.column_count, hc.content_hash AS current_hash, hp.content_hash AS prior_hash,
  CASE WHEN hp.connection_id IS NULL THEN 'BOOTSTRAP' WHEN hp.content_hash = hc.content_hash THEN 'UNCHANGED' ELSE 'CHANGED' END AS gate_state
FROM hc LEFT JOIN hp USING (connection_id)""")
def hash_gate(spark, sf):
    current = lw.content_hash(stored(spark, sf, "current"))
    return lw.hash_gate(current, _headers(stored(spark, sf, "prior"), "_1")).select(
        "connection_id", "column_count", "current_hash", "prior_hash", "gate_state"
    )


# ---- diff -------------------------------------------------------------------------------

_PLACE = "connection_id, table_schema, table_name"
# Names here are col_<n>: tokens 'col' and '<n>', so token overlap is 1/3 unless equal.
_SIMILARITY = """round(greatest(1.0::DOUBLE - levenshtein(lower(before_name), lower(after_name))::DOUBLE
  / greatest(length(before_name), length(after_name)), 1.0::DOUBLE / 3), 4)"""
_DIFF = f"""
removed AS (SELECT * FROM d_prior ANTI JOIN d_current USING ({_PLACE}, column_name)),
added AS (SELECT * FROM d_current ANTI JOIN d_prior USING ({_PLACE}, column_name)),
kept AS (SELECT {_PLACE}, CASE WHEN p.data_type <> c.data_type THEN 'TYPE_PROMOTION' ELSE 'REORDER' END AS change_type,
    column_name AS before_name, p.data_type AS before_type, p.ordinal_position AS before_ordinal,
    column_name AS after_name, c.data_type AS after_type, c.ordinal_position AS after_ordinal
  FROM d_prior p JOIN d_current c USING ({_PLACE}, column_name)
  WHERE p.data_type <> c.data_type OR p.ordinal_position <> c.ordinal_position),
pairs AS (SELECT {_PLACE}, r.column_name AS before_name, data_type AS before_type,
    r.ordinal_position AS before_ordinal, a.column_name AS after_name, data_type AS after_type, a.ordinal_position AS after_ordinal
  FROM removed r JOIN added a USING ({_PLACE}, data_type)),
plausible AS (SELECT *, {_SIMILARITY} AS similarity FROM pairs WHERE {_SIMILARITY} >= 0.6),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_PLACE}, before_type ORDER BY similarity DESC, before_name, after_name) AS k FROM plausible),
walk AS (SELECT DISTINCT {_PLACE}, before_type, 0::BIGINT AS k, false AS taken, []::VARCHAR[] AS used_before, []::VARCHAR[] AS used_after FROM ranked
  UNION ALL
  SELECT {_PLACE}, before_type, r.k, NOT list_contains(used_before, before_name) AND NOT list_contains(used_after, after_name),
    CASE WHEN list_contains(used_before, before_name) OR list_contains(used_after, after_name) THEN used_before ELSE list_append(used_before, before_name) END,
    CASE WHEN list_contains(used_before, before_name) OR list_contains(used_after, after_name) THEN used_after ELSE list_append(used_after, after_name) END
  FROM walk w JOIN ranked r USING ({_PLACE}, before_type) WHERE r.k = w.k + 1),
renames AS (SELECT {_PLACE}, 'RENAME' AS change_type, before_name, before_type, before_ordinal, after_name, after_type, after_ordinal
  FROM ranked JOIN walk USING ({_PLACE}, before_type, k) WHERE taken),
fresh AS (SELECT {_PLACE}, 'NEW_FIELD' AS change_type, NULL::VARCHAR AS before_name, NULL::VARCHAR AS before_type, NULL::BIGINT AS before_ordinal,
    column_name AS after_name, data_type AS after_type, ordinal_position AS after_ordinal
  FROM added ANTI JOIN (SELECT {_PLACE}, after_name AS column_name FROM renames) USING ({_PLACE}, column_name)),
gone AS (SELECT {_PLACE}, 'DEPRECATION' AS change_type, column_name AS before_name, data_type AS before_type,
    ordinal_position AS before_ordinal, NULL::VARCHAR AS after_name, NULL::VARCHAR AS after_type, NULL::BIGINT AS after_ordinal
  FROM removed ANTI JOIN (SELECT {_PLACE}, before_name AS column_name FROM renames) USING ({_PLACE}, column_name)),
diff AS (FROM kept UNION ALL FROM renames UNION ALL FROM fresh UNION ALL FROM gone)"""
_WITH_DIFF = ctes("prior", "current").replace("WITH ", "WITH RECURSIVE ", 1) + "," + _DIFF


def _sides(spark, sf):
    return table(spark, sf, "prior"), table(spark, sf, "current")


def changes_of(spark, sf):
    return lw.diff_columns(*_sides(spark, sf))


@register("diff_columns", _WITH_DIFF + " SELECT * FROM diff")
def diff_columns(spark, sf):
    return flat(changes_of(spark, sf))


@register("diff_kept", _WITH_DIFF + " SELECT * FROM kept")
def diff_kept(spark, sf):
    return flat(lw.diff_kept(lw.changed_columns(*_sides(spark, sf))))


@register("diff_rename_candidates", _WITH_DIFF + " SELECT * FROM renames")
def diff_rename_candidates(spark, sf):
    return flat(lw.diff_rename_candidates(lw.changed_columns(*_sides(spark, sf))))


@register("diff_new_field", _WITH_DIFF + " SELECT * FROM fresh")
def diff_new_field(spark, sf):
    return flat(lw.diff_new_field(lw.changed_columns(*_sides(spark, sf))))


@register("diff_deprecation", _WITH_DIFF + " SELECT * FROM gone")
def diff_deprecation(spark, sf):
    return flat(lw.diff_deprecation(lw.changed_columns(*_sides(spark, sf))))


_COLLATERAL = f""", promoted AS (SELECT DISTINCT {_PLACE} FROM diff WHERE change_type = 'TYPE_PROMOTION'),
collateral AS (SELECT diff.*, diff.change_type = 'REORDER' AND p.table_name IS NOT NULL AS is_collateral
  FROM diff LEFT JOIN promoted p USING ({_PLACE}))"""


@register("attribute_collateral_reorder", _WITH_DIFF + _COLLATERAL + " SELECT * FROM collateral")
def attribute_collateral_reorder(spark, sf):
    return flat(lw.attribute_collateral_reorder(changes_of(spark, sf)), "is_collateral")


@register("ordinal_delta", _WITH_DIFF + f""" SELECT {_PLACE}, change_type, before_name, after_name,
  after_ordinal - before_ordinal AS ordinal_delta FROM diff""")
def ordinal_delta(spark, sf):
    return flat(lw.ordinal_delta(changes_of(spark, sf)), "ordinal_delta").drop(
        "before_type", "after_type", "before_ordinal", "after_ordinal"
    )


@register("rank_rename_candidates", _WITH_DIFF + f""", scored AS (SELECT *, {_SIMILARITY} AS name_similarity FROM renames)
SELECT {_PLACE}, before_name, after_name, name_similarity, row_number() OVER
  (PARTITION BY {_PLACE}, before_name ORDER BY name_similarity DESC, after_name) AS rename_rank FROM scored""")
def rank_rename_candidates(spark, sf):
    return lw.rank_rename_candidates(changes_of(spark, sf)).select(
        "connection_id", "table_schema", "table_name", F.col("before.column_name").alias("before_name"),
        F.col("after.column_name").alias("after_name"), "name_similarity", F.col("rename_rank").cast("bigint").alias("rename_rank"),
    )


_SHIM = """CASE change_type
  WHEN 'RENAME' THEN 'CREATE OR REPLACE VIEW ' || table_schema || '.' || table_name || '_shim AS SELECT *, ' || after_name || ' AS ' || before_name || ' FROM ' || table_schema || '.' || table_name
  WHEN 'TYPE_PROMOTION' THEN 'CREATE OR REPLACE VIEW ' || table_schema || '.' || table_name || '_shim AS SELECT *, CAST(' || after_name || ' AS ' || before_type || ') AS ' || after_name || '_legacy FROM ' || table_schema || '.' || table_name
  WHEN 'DEPRECATION' THEN 'CREATE OR REPLACE VIEW ' || table_schema || '.' || table_name || '_shim AS SELECT *, CAST(NULL AS ' || before_type || ') AS ' || before_name || ' FROM ' || table_schema || '.' || table_name
  ELSE '' END"""


@register("shim_sql", _WITH_DIFF + f" SELECT {_PLACE}, change_type, before_name, after_name, {_SHIM} AS remediation_sql FROM diff")
def shim_sql(spark, sf):
    return flat(lw.shim_sql(changes_of(spark, sf)), "remediation_sql").drop(
        "before_type", "after_type", "before_ordinal", "after_ordinal"
    )


_CONFIDENCE = f"""CASE WHEN change_type = 'RENAME' THEN {_SIMILARITY} WHEN is_collateral THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END"""
_RATIONALE = """CASE WHEN change_type = 'RENAME' THEN before_name || ' was dropped and ' || after_name || ' of the same type appeared.'
  WHEN change_type = 'TYPE_PROMOTION' THEN after_name || ' changed type from ' || before_type || ' to ' || after_type || '.'
  WHEN is_collateral THEN after_name || ' moved because its table was rewritten by a type change.'
  WHEN change_type = 'REORDER' THEN after_name || ' moved to another position.'
  WHEN change_type = 'NEW_FIELD' THEN after_name || ' is new.' ELSE before_name || ' was dropped.' END"""
_CLASSIFIED = _COLLATERAL + f""", classified AS (SELECT *, {_CONFIDENCE} AS classification_conf, {_RATIONALE} AS rationale, {_SHIM} AS remediation_sql FROM collateral)"""
_CLASSIFIED_COLUMNS = f"{_PLACE}, change_type, before_name, after_name, classification_conf, rationale, remediation_sql"


def _short(classified, *extra):
    return classified.select(
        "connection_id", "table_schema", "table_name", "change_type", F.col("before.column_name").alias("before_name"),
        F.col("after.column_name").alias("after_name"), "classification_conf", "rationale", "remediation_sql", *extra,
    )


@register("classify_changes", _WITH_DIFF + _CLASSIFIED + f" SELECT {_CLASSIFIED_COLUMNS} FROM classified")
def classify_changes(spark, sf):
    return _short(lw.classify_changes(changes_of(spark, sf)))


@register("classify_changes_consumers", _WITH_DIFF + _CLASSIFIED + f""", readers AS (SELECT DISTINCT connection_id, table_schema, table_name,
  'job_' || column_name AS consumer FROM d_current WHERE ordinal_position > 1),
read AS (SELECT {_PLACE}, count(*) AS n_consumers, array_to_string(list_sort(list(consumer))[:20], '|') AS downstream_consumers FROM readers GROUP BY ALL)
SELECT {_PLACE}, change_type, before_name, after_name, coalesce(n_consumers, 0) AS n_consumers, coalesce(downstream_consumers, '') AS downstream_consumers,
  rationale || CASE WHEN n_consumers > 0 THEN ' Downstream readers of the table: ' || n_consumers || '.' ELSE '' END AS rationale
FROM classified LEFT JOIN read USING ({_PLACE})""")
def classify_changes_consumers(spark, sf):
    """Jobs that read a table stand beside its changes."""
    base = {"fleet_base": stored(spark, sf, "fleet_base")}
    current = stored(spark, sf, "current", base)
    readers = current.filter("ordinal_position > 1").select("connection_id", "table_schema", "table_name", F.concat(F.lit("job_"), "column_name").alias("consumer"))
    classified = lw.classify_changes(lw.diff_columns(table(spark, sf, "prior", base), current), consumers=readers)
    return classified.select(
        "connection_id", "table_schema", "table_name", "change_type", F.col("before.column_name").alias("before_name"),
        F.col("after.column_name").alias("after_name"), "n_consumers", F.array_join("downstream_consumers", "|").alias("downstream_consumers"), "rationale",
    )


@register("plan_drift", _WITH_DIFF + _CLASSIFIED + f""" SELECT {_CLASSIFIED_COLUMNS} FROM classified
WHERE connection_id IN (SELECT connection_id FROM d_prior)""")
def plan_drift(spark, sf):
    return _short(lw.plan_drift(stored(spark, sf, "prior"), stored(spark, sf, "current"), (SYSTEM_PREFIX, SYSTEM_SUFFIX)))


@register("needs_human_review", _WITH_DIFF + _CLASSIFIED + f""" SELECT {_CLASSIFIED_COLUMNS},
  classification_conf < 0.6 AS needs_review FROM classified""")
def needs_human_review(spark, sf):
    return _short(lw.needs_human_review(lw.classify_changes(changes_of(spark, sf))), "needs_review")


@register("autonomy_filter", ctes("drift_events") + """
SELECT drift_id, change_type, false AS strict, change_type = 'NEW_FIELD' AND classification_conf >= 0.6 AS trusted_additive,
  classification_conf >= 0.6 AS full_auto FROM d_drift_events""")
def autonomy_filter(spark, sf):
    events = table(spark, sf, "drift_events")
    for level in ("STRICT", "TRUSTED_ADDITIVE", "FULL_AUTO"):
        events = lw.autonomy_filter(events, level).withColumnRenamed("auto_apply", level.lower())
    return events.select("drift_id", "change_type", "strict", "trusted_additive", "full_auto")


# ---- state ------------------------------------------------------------------------------

def _syncs(names, received_at):
    """One accepted sync per connection of the fleet."""
    ids = names.select("connection_id").distinct()
    when = F.lit(received_at).cast("timestamp")
    return ids.select(
        F.concat(F.lit("log_"), "connection_id", F.lit(received_at)).alias("log_id"), "connection_id",
        F.lit(received_at).alias("sync_id"), when.alias("synced_at"), when.alias("received_at"),
        F.lit("name").alias("connection_name"),
    )


def run_detection(spark, sf, root):
    """A first run that stores the baseline, then a second over the changed columns."""
    system = (SYSTEM_PREFIX, SYSTEM_SUFFIX)
    names = stored(spark, sf, "fleet_names")
    known = {"fleet_names": names}
    lw.detect_drift(_syncs(names, "2024-01-01 00:00:00"), stored(spark, sf, "prior", known), root, system)
    return lw.detect_drift(_syncs(names, "2024-01-02 00:00:00"), stored(spark, sf, "current", known), root, system)


@register("detect_drift", _WITH_DIFF + _CLASSIFIED + f""" SELECT {_CLASSIFIED_COLUMNS}, 'PROPOSED' AS remediation_status FROM classified""")
def detect_drift(spark, sf):
    events = run_detection(spark, sf, new_root(spark))
    return events.select(
        "connection_id", "table_schema", "table_name", "change_type", F.col("column_before.column_name").alias("before_name"),
        F.col("column_after.column_name").alias("after_name"), "classification_conf", "rationale", "remediation_sql", "remediation_status",
    )


@register("write_snapshot", ctes("snapshots", "snapshot_column_rows") + """
SELECT s.connection_id, s.snapshot_id, cast(s.captured_at AS date) AS captured_on, count(c.snapshot_id) AS n_columns,
  count(DISTINCT c.table_name || '.' || c.column_name) AS n_names
FROM d_snapshots s LEFT JOIN d_snapshot_column_rows c USING (snapshot_id) GROUP BY ALL""")
def write_snapshot(spark, sf):
    """Every snapshot under the date it was captured on."""
    root = new_root(spark)
    snapshots = table(spark, sf, "snapshots")
    columns = table(spark, sf, "snapshot_column_rows").join(snapshots.select("snapshot_id", "captured_at"), "snapshot_id")
    lw.write_snapshot(snapshots, columns, root)
    stored = lw.read_state(spark, root, "column_snapshots", deduplicate=False)
    per_snapshot = stored.groupBy("snapshot_id", "captured_at_date", "table_name", "column_name").agg(F.count(F.lit(1)).alias("n")).groupBy(
        "snapshot_id", "captured_at_date"
    ).agg(F.sum("n").alias("n_columns"), F.count(F.lit(1)).alias("n_names"))
    return (
        lw.read_state(spark, root, "schema_snapshots")
        .select("connection_id", "snapshot_id", "captured_at_date")
        .join(per_snapshot, ["snapshot_id", "captured_at_date"], "left")
        .withColumnRenamed("captured_at_date", "captured_on")
        .fillna(0, ["n_columns", "n_names"])
    )


_EVENT_COLUMNS = "drift_id, connection_id, table_name, change_type, classification_conf, remediation_status, approved_by, transformation_id"


def _stored_events(spark, sf):
    root = new_root(spark)
    lw.insert_drift_event(table(spark, sf, "drift_events"), root)
    return root


def _event_columns(events):
    return events.select(*[c.strip() for c in _EVENT_COLUMNS.split(",")], F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@register("insert_drift_event", ctes("drift_events") + """
SELECT drift_id, connection_id, table_name, change_type, classification_conf, remediation_status,
       NULL::VARCHAR AS approved_by, NULL::VARCHAR AS transformation_id, updated_at FROM d_drift_events""")
def insert_drift_event(spark, sf):
    """A replayed insert leaves each event once."""
    root = _stored_events(spark, sf)
    lw.insert_drift_event(table(spark, sf, "drift_events").filter(F.col("remediation_status") == "APPROVED"), root)
    return _event_columns(lw.read_state(spark, root, "drift_events"))


# Reviewer actions: every proposed event is approved, the breaking ones are then applied.
_ACTIONS = """SELECT drift_id, 'approve' AS action, 'reviewer' AS actor, cast(NULL AS string) AS transformation_id,
       detected_at + interval '1' hour AS updated_at FROM {drift_events} WHERE remediation_status = 'PROPOSED'
UNION ALL
SELECT drift_id, 'apply', cast(NULL AS string), 'tf_' || drift_id, detected_at + interval '2' hour FROM {drift_events}
WHERE change_type IN ('RENAME', 'TYPE_PROMOTION') AND remediation_status <> 'REJECTED'
UNION ALL
SELECT drift_id, 'verify', cast(NULL AS string), cast(NULL AS string), detected_at + interval '3' hour FROM {drift_events}
WHERE change_type = 'RENAME'"""
_ACTION_CTE = ", actions AS (" + _ACTIONS.format(drift_events="d_drift_events") + ")"


def _actions(spark, sf):
    return spark.sql(_ACTIONS, drift_events=table(spark, sf, "drift_events"))


_FOLDED = """
SELECT e.drift_id, e.connection_id, e.table_name, e.change_type, e.classification_conf,
  coalesce(a.status, e.remediation_status) AS remediation_status, a.approved_by, a.transformation_id,
  coalesce(a.updated_at, e.updated_at) AS updated_at
FROM d_drift_events e LEFT JOIN (SELECT drift_id,
  arg_max(CASE action WHEN 'approve' THEN 'APPROVED' WHEN 'apply' THEN 'APPLIED' ELSE 'VERIFIED' END, updated_at) AS status,
  max(actor) AS approved_by, max(transformation_id) AS transformation_id, max(updated_at) AS updated_at
  FROM {actions} GROUP BY drift_id) a USING (drift_id)"""


@register("drift_events_current", ctes("drift_events") + _ACTION_CTE + _FOLDED.format(actions="actions"))
def drift_events_current(spark, sf):
    """Inserts and updates stored apart and folded when read."""
    from landwatch.operators.lifecycle import lifecycle_updates

    root = _stored_events(spark, sf)
    lw.update_drift_event(lifecycle_updates(_actions(spark, sf)), root)
    return _event_columns(lw.drift_events_current(spark, root, committed_only=False))


_HEADED = "classification_conf < 0.7 OR classification_conf > 0.9"
_COMMITTED = _FOLDED.format(actions="actions") + f" WHERE {_HEADED.replace('classification_conf', 'e.classification_conf')}"


def _committed_store(spark, sf):
    """A store whose events are headed but for those of runs that died, in two halves with a compaction between."""
    from landwatch.operators.lifecycle import lifecycle_updates

    root = new_root(spark)
    events = table(spark, sf, "drift_events")
    headers = events.filter(_HEADED).select(
        F.col("to_snapshot_id").alias("snapshot_id"), "connection_id", F.lit("public").alias("destination_schema"),
        F.col("detected_at").alias("captured_at"), F.lit("sync_end").alias("trigger_event"), F.lit("h").alias("content_hash"),
    )
    first = F.col("classification_conf") < 0.8
    updates = lifecycle_updates(_actions(spark, sf))
    lw.insert_drift_event(events.filter(first), root)
    append_state(headers.filter("captured_at < timestamp_ntz'2024-01-15 00:00:00'"), root, "schema_snapshots")
    lw.update_drift_event(updates.filter(F.col("updated_at") < F.lit("2024-01-15 00:00:00")), root)
    lw.compact_state(spark, root)
    lw.insert_drift_event(events.filter(~first), root)
    append_state(headers, root, "schema_snapshots")  # a replay repeats the headers of the first half
    lw.update_drift_event(updates, root)
    return root


@register("drift_events_committed", ctes("drift_events") + _ACTION_CTE + _COMMITTED)
def drift_events_committed(spark, sf):
    """The default reading: events of finished runs only, folded over a compacted base."""
    return _event_columns(lw.drift_events_current(spark, _committed_store(spark, sf)))


@register("drift_events_compacted", ctes("drift_events") + _ACTION_CTE + _COMMITTED)
def drift_events_compacted(spark, sf):
    """The same after two more compactions, when everything is in the base."""
    root = _committed_store(spark, sf)
    lw.compact_state(spark, root)
    lw.compact_state(spark, root)
    return _event_columns(lw.drift_events_current(spark, root))


@register("head_snapshots", ctes("snapshots") + f""", {_LATEST} SELECT connection_id, snapshot_id, captured_at, content_hash FROM latest""")
def head_snapshots(spark, sf):
    """The newest header of each connection from a base and the headers written since."""
    root = new_root(spark)
    snapshots = table(spark, sf, "snapshots")
    old = F.col("captured_at") < F.lit("1995-01-01").cast("timestamp_ntz")
    append_state(snapshots.filter(old), root, "schema_snapshots")
    lw.compact_state(spark, root)
    append_state(snapshots.filter(~old), root, "schema_snapshots")
    lw.compact_state(spark, root)
    return lw.head_snapshots(spark, root).select("connection_id", "snapshot_id", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"), "content_hash")


@register("update_drift_event", ctes("drift_events") + """
SELECT drift_id, connection_id, table_name, change_type, 1.0::DOUBLE AS classification_conf, remediation_status,
  'someone' AS approved_by, NULL::VARCHAR AS transformation_id, updated_at + interval '1' day AS updated_at FROM d_drift_events""")
def update_drift_event(spark, sf):
    root = _stored_events(spark, sf)
    lw.update_drift_event(
        table(spark, sf, "drift_events").select(
            "drift_id", F.lit(1.0).alias("classification_conf"), F.lit("someone").alias("approved_by"),
            F.expr("updated_at + interval '1' day").alias("updated_at"),
        ),
        root,
    )
    return _event_columns(lw.drift_events_current(spark, root, committed_only=False))


@register("drift_lifecycle", ctes("drift_events") + _ACTION_CTE + _FOLDED.format(actions="actions"))
def drift_lifecycle(spark, sf):
    events = table(spark, sf, "drift_events").withColumns(
        {"approved_by": F.lit(None).cast("string"), "transformation_id": F.lit(None).cast("string")}
    )
    return _event_columns(lw.drift_lifecycle(events, _actions(spark, sf)))


@register("drift_lifecycle_strict", ctes("drift_events") + _ACTION_CTE + """, legal AS (
SELECT a.* FROM actions a JOIN d_drift_events e USING (drift_id) WHERE
  (a.action = 'approve' AND e.remediation_status = 'PROPOSED') OR (a.action = 'apply' AND e.remediation_status = 'APPROVED')
  OR (a.action = 'verify' AND e.remediation_status = 'APPLIED'))""" + _FOLDED.format(actions="legal"))
def drift_lifecycle_strict(spark, sf):
    events = table(spark, sf, "drift_events").withColumns(
        {"approved_by": F.lit(None).cast("string"), "transformation_id": F.lit(None).cast("string")}
    )
    return _event_columns(lw.drift_lifecycle(events, _actions(spark, sf), strict=True))


@register("list_proposed", _WITH_DIFF + f""" SELECT {_PLACE}, change_type,
  '{{"table_schema":"' || table_schema || '","table_name":"' || table_name || '","column_name":"' || before_name || '","data_type":"' || before_type
    || '","ordinal_position":' || before_ordinal || ',"is_nullable":' || (SELECT p.is_nullable FROM d_prior p WHERE p.connection_id = diff.connection_id
      AND p.table_name = diff.table_name AND p.column_name = diff.before_name) || '}}' AS column_before,
  remediation_status FROM (SELECT *, 'PROPOSED' AS remediation_status FROM diff) diff""")
def list_proposed(spark, sf):
    from landwatch.plans.detect import drift_rows

    classified = lw.classify_changes(changes_of(spark, sf)).withColumns(
        {"from_snapshot_id": F.lit("a"), "to_snapshot_id": F.lit("b"), "detected_at": F.to_timestamp_ntz(F.lit(AS_OF))}
    )
    return lw.list_proposed(drift_rows(classified), ordered=False).select(
        "connection_id", "table_schema", "table_name", "change_type", "column_before", "remediation_status"
    )


@register("write_sync_log", ctes("sync_log") + """
SELECT connection_id, count(*) AS n_syncs, max(synced_at) AS last_synced_at FROM d_sync_log GROUP BY connection_id""")
def write_sync_log(spark, sf):
    """A replayed write leaves each sync once."""
    root = new_root(spark)
    lw.write_sync_log(table(spark, sf, "sync_log"), root)
    lw.write_sync_log(table(spark, sf, "sync_log"), root)
    return lw.read_state(spark, root, "sync_log").groupBy("connection_id").agg(
        F.count(F.lit(1)).alias("n_syncs"), F.max("synced_at").cast("timestamp_ntz").alias("last_synced_at")
    )


@register("write_sync_failure_log", ctes("failures") + " SELECT connection_id, error_code, count(*) AS n FROM d_failures GROUP BY ALL")
def write_sync_failure_log(spark, sf):
    root = new_root(spark)
    append_state(table(spark, sf, "failures"), root, "sync_failure_log")
    return lw.read_state(spark, root, "sync_failure_log").groupBy("connection_id", "error_code").agg(F.count(F.lit(1)).alias("n"))
