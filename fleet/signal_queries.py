"""Queries over syncs, failures, signals and grades."""

from __future__ import annotations

from pyspark.sql import functions as F

import landwatch as lw
from fleet.inputs import AS_OF, SLA_HOURS, ctes, table
from fleet.registry import register
from landwatch.plans.readiness import readiness_signals

_AS_OF = f"timestamp '{AS_OF}'"
_HOURS = f"date_sub('second', last_synced_at, {_AS_OF}) / 3600.0::DOUBLE"
_LAST = "last AS (SELECT connection_id, max(synced_at) AS last_synced_at FROM d_sync_log GROUP BY connection_id)"


def _status(sla):
    return f"CASE WHEN last_synced_at IS NULL THEN 'NEVER_SYNCED' WHEN {_HOURS} <= {sla} THEN 'OK' ELSE 'STALE' END"


@register("freshness_fleet", ctes("sync_log") + f""", {_LAST}
SELECT connection_id, last_synced_at, round({_HOURS}, 2) AS hours_since_sync, {SLA_HOURS}::DOUBLE AS sla_hours, {_status(SLA_HOURS)} AS status FROM last""")
def freshness_fleet(spark, sf):
    return lw.freshness_fleet(table(spark, sf, "sync_log"), AS_OF, SLA_HOURS)


_CHECK = ctes("sync_log", "connection_ids") + f""", {_LAST},
checked AS (SELECT connection_id, last_synced_at, round({_HOURS}, 2) AS hours_since_sync, {_status(SLA_HOURS)} AS status
  FROM d_connection_ids LEFT JOIN last USING (connection_id))"""


@register("freshness_check", _CHECK + f" SELECT *, {SLA_HOURS}::DOUBLE AS sla_hours FROM checked")
def freshness_check(spark, sf):
    return lw.freshness_check(table(spark, sf, "connection_ids"), table(spark, sf, "sync_log"), AS_OF, SLA_HOURS)


@register("freshness_signal", _CHECK + " SELECT connection_id, status, hours_since_sync FROM checked")
def freshness_signal(spark, sf):
    return lw.freshness_signal(table(spark, sf, "connection_ids"), table(spark, sf, "sync_log"), AS_OF, SLA_HOURS)


@register("receiver_latency", ctes("sync_log") + """
SELECT time_bucket(interval '1 hour', synced_at) AS window_start, count(*) AS n_events,
  round(avg(date_sub('millisecond', synced_at, received_at) / 1000.0::DOUBLE), 3) AS avg_latency_sec,
  max(date_sub('millisecond', synced_at, received_at) / 1000.0::DOUBLE) AS max_latency_sec
FROM d_sync_log GROUP BY ALL""")
def receiver_latency(spark, sf):
    return lw.receiver_latency(table(spark, sf, "sync_log"))


_BREAKING = "count(*) FILTER (change_type IN ('TYPE_PROMOTION', 'DEPRECATION', 'RENAME'))"
_DRIFT = f"""drift AS (SELECT connection_id, count(*) AS total_changes, {_BREAKING} AS breaking_changes
  FROM d_drift_events WHERE detected_at >= {_AS_OF} - interval '{{days}} days' GROUP BY connection_id)"""


@register("drift_stability", ctes("connection_ids", "drift_events") + ", " + _DRIFT.format(days=20) + """
SELECT connection_id, coalesce(total_changes, 0) AS total_changes, coalesce(breaking_changes, 0) AS breaking_changes
FROM d_connection_ids LEFT JOIN drift USING (connection_id)""")
def drift_stability(spark, sf):
    return lw.drift_stability(table(spark, sf, "connection_ids"), table(spark, sf, "drift_events"), AS_OF, 20)


_VOLATILITY = ctes("drift_events") + ", " + _DRIFT.format(days=30) + """,
volatility AS (SELECT *, round(total_changes / (30 / 7.0::DOUBLE), 2) AS changes_per_week FROM drift)"""


@register("drift_volatility", _VOLATILITY + " SELECT * FROM volatility")
def drift_volatility(spark, sf):
    return lw.drift_volatility(table(spark, sf, "drift_events"), AS_OF)


_CLASS = """CASE WHEN breaking_changes >= 5 THEN 'CRITICAL' WHEN changes_per_week >= 2 OR breaking_changes > 0 THEN 'VOLATILE' ELSE 'STABLE' END"""


@register("volatility_class", _VOLATILITY + f" SELECT *, {_CLASS} AS stability_class FROM volatility")
def volatility_class(spark, sf):
    return lw.analyze_drift_volatility(table(spark, sf, "drift_events"), AS_OF).drop("narrative", "recommendation")


@register("fleet_summary", _VOLATILITY + f""", c AS (SELECT {_CLASS} AS k FROM volatility)
SELECT count(*) AS n_connections, count(*) FILTER (k = 'STABLE') AS n_stable, count(*) FILTER (k = 'VOLATILE') AS n_volatile,
  count(*) FILTER (k = 'CRITICAL') AS n_critical, count(*) || ' connections drifted: ' || count(*) FILTER (k = 'CRITICAL') || ' critical, '
  || count(*) FILTER (k = 'VOLATILE') || ' volatile, ' || count(*) FILTER (k = 'STABLE') || ' stable.' AS fleet_summary FROM c""")
def fleet_summary(spark, sf):
    return lw.fleet_summary(lw.analyze_drift_volatility(table(spark, sf, "drift_events"), AS_OF))


_SEMI = "count(*) FILTER (upper(data_type) IN ('JSON', 'STRUCT'))"
_NAMES = "count(*) FILTER (length(column_name) <= 3 OR regexp_matches(column_name, '[0-9]+$'))"


@register("type_suitability", ctes("named") + f"""
SELECT connection_id, count(*) AS total_columns, {_SEMI} AS semi_structured_columns,
  round({_SEMI}::DOUBLE / count(*) * 100, 1) AS semi_structured_pct FROM d_named GROUP BY connection_id""")
def type_suitability(spark, sf):
    return lw.type_suitability(table(spark, sf, "named"))


@register("naming_coherence", ctes("named") + f"""
SELECT connection_id, count(*) AS total_columns, {_NAMES} AS incoherent_names,
  round({_NAMES}::DOUBLE / count(*) * 100, 1) AS incoherent_pct FROM d_named GROUP BY connection_id""")
def naming_coherence(spark, sf):
    return lw.naming_coherence(table(spark, sf, "named"))


_SIGNALS = ctes("sync_log", "drift_events", "named", "connection_ids") + f""", {_LAST}, {_DRIFT.format(days=30)},
shape AS (SELECT connection_id, count(*) AS total_columns, {_SEMI} AS semi_structured_columns, {_NAMES} AS incoherent_names
  FROM d_named GROUP BY connection_id),
signals AS (SELECT i.connection_id, {_status(SLA_HOURS)} AS freshness_status, round({_HOURS}, 2) AS hours_since_sync,
  coalesce(total_changes, 0) AS total_changes, coalesce(breaking_changes, 0) AS breaking_changes,
  coalesce(total_columns, 0) AS total_columns, coalesce(semi_structured_columns, 0) AS semi_structured_columns,
  coalesce(round(semi_structured_columns::DOUBLE / total_columns * 100, 1), 0) AS semi_structured_pct,
  coalesce(incoherent_names, 0) AS incoherent_names,
  coalesce(round(incoherent_names::DOUBLE / total_columns * 100, 1), 0) AS incoherent_pct
  FROM {{ids}} i LEFT JOIN last USING (connection_id) LEFT JOIN drift USING (connection_id) LEFT JOIN shape USING (connection_id)),
scored AS (SELECT *, round(100 - CASE freshness_status WHEN 'STALE' THEN 25 WHEN 'NEVER_SYNCED' THEN 40 ELSE 0 END
  - least(breaking_changes * 5.0::DOUBLE, 25.0::DOUBLE) - semi_structured_pct * 0.25::DOUBLE - incoherent_pct * 0.25::DOUBLE, 3) AS score FROM signals),
graded AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM scored)"""
_ACTIVE = "(SELECT DISTINCT connection_id FROM d_sync_log)"


def _inputs(spark, sf):
    return table(spark, sf, "sync_log"), table(spark, sf, "drift_events"), table(spark, sf, "named")


@register("readiness_signals", _SIGNALS.format(ids="d_connection_ids") + " SELECT * FROM signals")
def readiness_signals_query(spark, sf):
    return readiness_signals(table(spark, sf, "connection_ids"), *_inputs(spark, sf), AS_OF, SLA_HOURS)


@register("score_readiness", _SIGNALS.format(ids="d_connection_ids") + " SELECT * FROM graded")
def score_readiness(spark, sf):
    return lw.score_readiness(table(spark, sf, "connection_ids"), *_inputs(spark, sf), AS_OF, sla_hours=SLA_HOURS).drop(
        "narrative", "top_remediations"
    )


@register("readiness_fleet", _SIGNALS.format(ids=_ACTIVE) + """
SELECT connection_id, score, grade, len(list_filter([CASE freshness_status WHEN 'OK' THEN 0 ELSE 1 END, breaking_changes, semi_structured_pct, incoherent_pct], lambda x: x > 0)) AS n_deductions FROM graded""")
def readiness_fleet(spark, sf):
    graded = lw.readiness_fleet(*_inputs(spark, sf), AS_OF, sla_hours=SLA_HOURS)
    deductions = F.filter(
        F.array(
            F.when(F.col("freshness_status") == "OK", 0.0).otherwise(1.0), F.col("breaking_changes").cast("double"),
            F.col("semi_structured_pct"), F.col("incoherent_pct"),
        ),
        lambda x: x > 0,
    )
    return graded.select("connection_id", "score", "grade", F.size(deductions).cast("bigint").alias("n_deductions"))


# ---- failures ---------------------------------------------------------------------------

_WINDOW = f"win AS (SELECT * FROM d_failures WHERE failed_at >= {_AS_OF} - interval '7 days')"
_TOP = f"""{_WINDOW},
codes AS (SELECT connection_id, coalesce(nullif(error_code, ''), 'UNKNOWN') AS error_code, count(*) AS "count",
  arg_max(coalesce(error_message, ''), (failed_at, log_id)) AS sample_message, max(failed_at) AS last_failed_at FROM win GROUP BY ALL),
top AS (SELECT connection_id, error_code, "count", sample_message, row_number() OVER
  (PARTITION BY connection_id ORDER BY "count" DESC, last_failed_at DESC, error_code) AS rank FROM codes QUALIFY rank <= 5)"""


@register("failure_window_scan", ctes("failures") + f", {_WINDOW} SELECT * FROM win")
def failure_window_scan(spark, sf):
    return lw.failure_window_scan(table(spark, sf, "failures"), AS_OF)


@register("time_window_filter", ctes("drift_events") + f""" SELECT drift_id, detected_at FROM d_drift_events
WHERE detected_at >= {_AS_OF} - interval '10 days'""")
def time_window_filter(spark, sf):
    return lw.time_window_filter(table(spark, sf, "drift_events"), "detected_at", AS_OF, 10).select("drift_id", "detected_at")


@register("failure_top_errors", ctes("failures") + f", {_TOP} SELECT * FROM top")
def failure_top_errors(spark, sf):
    return lw.failure_top_errors(table(spark, sf, "failures"), AS_OF).withColumn("rank", F.col("rank").cast("bigint"))


@register("failure_count", ctes("failures") + f", {_WINDOW} SELECT connection_id, count(*) AS failure_count FROM win GROUP BY connection_id")
def failure_count(spark, sf):
    return lw.failure_count(table(spark, sf, "failures"), AS_OF)


_SEVERITY = "CASE WHEN {n} >= 10 THEN 'CRITICAL' WHEN {n} >= 5 THEN 'HIGH' WHEN {n} >= 2 THEN 'MEDIUM' ELSE 'LOW' END"


@register("severity_from_count", ctes("failures") + f""", {_WINDOW}, c AS (SELECT connection_id, count(*) AS failure_count FROM win GROUP BY connection_id)
SELECT *, {_SEVERITY.format(n='failure_count')} AS severity FROM c""")
def severity_from_count(spark, sf):
    counts = lw.failure_count(table(spark, sf, "failures"), AS_OF)
    return counts.withColumn("severity", lw.severity_from_count(F.col("failure_count")))


def _status_frame(spark, sf):
    tasks = F.transform(
        F.sequence(F.lit(1), F.greatest("n_tasks", F.lit(1)).cast("int")),
        lambda i: F.struct(F.when(i != 2, F.concat("task_code", i.cast("string"))).alias("code"), F.when(i != 3, F.lit("m")).alias("message")),
    )
    return table(spark, sf, "connector_status").select(
        "connection_id", "sync_state",
        F.when(F.col("n_tasks") > 0, tasks).otherwise(F.array().cast("array<struct<code:string,message:string>>")).alias("tasks"),
    )


_LIVE = """live AS (
SELECT connection_id, n_tasks::BIGINT AS total_errors, CASE i WHEN 2 THEN 'UNKNOWN' ELSE task_code || i END AS error_code, 1::BIGINT AS "count",
  CASE i WHEN 3 THEN '' ELSE 'm' END AS sample_message, i AS rank
FROM d_connector_status, unnest(range(1, least(n_tasks, 5) + 1)) t(i) WHERE n_tasks > 0
UNION ALL SELECT connection_id, 1, upper(sync_state), 1, 'Connection is in error state', 1
FROM d_connector_status WHERE n_tasks = 0 AND sync_state IN ('error', 'broken'))"""


@register("connector_status_errors", ctes("connector_status") + f", {_LIVE} SELECT * FROM live")
def connector_status_errors(spark, sf):
    return lw.connector_status_errors(_status_frame(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@register("diagnose_failures", ctes("failures", "connector_status", "connection_ids") + f""", {_TOP}, {_LIVE},
n AS (SELECT connection_id, count(*) AS failure_count FROM win GROUP BY connection_id),
errs AS (SELECT *, 0 AS total_errors, 'log' AS source FROM top
  UNION ALL BY NAME SELECT *, 'status' AS source FROM live WHERE connection_id NOT IN (SELECT connection_id FROM n)),
g AS (SELECT connection_id, string_agg(error_code || '=' || "count", ',' ORDER BY rank) AS top_errors, max(source) AS source, max(total_errors)::BIGINT AS listed FROM errs GROUP BY connection_id)
SELECT connection_id, CASE WHEN top_errors IS NULL THEN 'no_failures' ELSE 'failures' END AS status, coalesce(failure_count, listed, 0) AS failure_count,
  top_errors, source, CASE WHEN top_errors IS NOT NULL THEN {_SEVERITY.format(n='coalesce(failure_count, listed, 0)')} END AS severity
FROM d_connection_ids LEFT JOIN g USING (connection_id) LEFT JOIN n USING (connection_id)""")
def diagnose_failures(spark, sf):
    return lw.diagnose_failures(
        table(spark, sf, "connection_ids"), table(spark, sf, "failures"), AS_OF, connector_status=_status_frame(spark, sf)
    ).select(
        "connection_id", "status", "failure_count",
        F.array_join(F.transform("top_errors", lambda e: F.concat(e["error_code"], F.lit("="), e["count"].cast("string"))), ",").alias("top_errors"),
        "source", "severity",
    )
