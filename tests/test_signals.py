import pytest
from pyspark.sql import functions as F

import landwatch as lw
from landwatch.plans.readiness import NO_DRIFT, grade_rank, stability_class
from landwatch.schemas import LANDED_COLUMNS

AS_OF = "2024-01-31 00:00:00"


def log(spark, *rows):
    return spark.createDataFrame(rows, "connection_id string, t string").select("connection_id", F.col("t").cast("timestamp").alias("synced_at"))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "connection_id string")


def columns(spark, *cols, conn="c1"):
    return spark.createDataFrame([(conn, "public", "users", n, k, i + 1, True) for i, (n, k) in enumerate(cols)], LANDED_COLUMNS)


def events(spark, *rows):
    return spark.createDataFrame(rows, "connection_id string, change_type string, t string").select(
        "connection_id", "change_type", F.col("t").cast("timestamp").alias("detected_at")
    )


def test_freshness_status_and_rounding(spark):
    sync = log(spark, ("ok", "2024-01-30 22:00:00"), ("stale", "2024-01-24 00:00:00"), ("edge", "2024-01-30 00:00:00"), ("over", "2024-01-29 23:59:59"))
    got = {r.connection_id: (r.status, r.hours_since_sync) for r in lw.freshness_check(ids(spark, "ok", "stale", "edge", "over", "never"), sync, AS_OF).collect()}
    # 24 h 1 s shows as 24.0 but is stale: the unrounded hours decide.
    assert got == {"ok": ("OK", 2.0), "stale": ("STALE", 168.0), "edge": ("OK", 24.0), "over": ("STALE", 24.0), "never": ("NEVER_SYNCED", None)}
    fleet = lw.freshness_fleet(sync, AS_OF, 0.0, ordered=True).collect()
    assert [r.connection_id for r in fleet][0] == "stale" and {r.status for r in fleet} == {"STALE"} and fleet[0].sla_hours == 0.0


def test_fractions_of_a_second_are_cut(spark):
    got = lw.freshness_fleet(log(spark, ("a", "2024-01-30 23:59:58.500")), AS_OF).collect()[0]
    assert got.hours_since_sync == 0.0


def test_drift_counts_every_status_and_window_is_inclusive(spark):
    ev = events(spark, ("a", "RENAME", "2024-01-01 00:00:00"), ("a", "NEW_FIELD", "2024-01-20"), ("a", "DEPRECATION", "2023-12-31 23:59:59"))
    got = lw.drift_stability(ids(spark, "a", "b"), ev, AS_OF).collect()
    assert {(r.connection_id, r.total_changes, r.breaking_changes) for r in got} == {("a", 2, 1), ("b", 0, 0)}
    assert [(r.connection_id, r.changes_per_week) for r in lw.drift_volatility(ev, AS_OF).collect()] == [("a", 0.47)]


@pytest.mark.parametrize("rate, breaking, expected", [(1.9, 0, "STABLE"), (2.0, 0, "VOLATILE"), (0.1, 1, "VOLATILE"), (0.1, 5, "CRITICAL"), (9.0, 4, "VOLATILE")])
def test_stability_ladder(spark, rate, breaking, expected):
    row = spark.range(1).select(stability_class(F.lit(rate), F.lit(breaking)).alias("c")).collect()[0]
    assert row.c == expected


def test_empty_window_has_the_fixed_sentence(spark):
    assert lw.fleet_summary(lw.analyze_drift_volatility(events(spark, ("a", "RENAME", "2020-01-01")), AS_OF)).collect()[0].fleet_summary == NO_DRIFT


def test_type_and_naming_shares(spark):
    types = lw.type_suitability(columns(spark, ("id", "INT64"), ("meta", "json"), ("attrs", "STRUCT"), ("name", "STRING"))).collect()[0]
    assert (types.semi_structured_columns, types.semi_structured_pct) == (2, 50.0)
    nested = columns(spark, ("a", "STRUCT<x INT64>"), ("b", "STRING"))
    assert lw.type_suitability(nested).collect()[0].semi_structured_pct == 0.0
    assert lw.type_suitability(nested, prefix_match=True).collect()[0].semi_structured_pct == 50.0
    names = lw.naming_coherence(columns(spark, *[(n, "STRING") for n in ("id", "ab", "col1", "customer_name", "email_address")])).collect()[0]
    assert (names.incoherent_names, names.incoherent_pct) == (3, 60.0)


def test_grades_by_rule_and_worst_first(spark):
    sync = log(spark, ("good", "2024-01-30 23:00:00"), ("bad", "2024-01-01"))
    landed = columns(spark, ("customer_name", "STRING"), conn="good").union(columns(spark, ("id", "JSON"), conn="bad"))
    ev = events(spark, *[("bad", "RENAME", "2024-01-20")] * 9)
    got = lw.readiness_fleet(sync, ev, landed, AS_OF, ordered=True).collect()
    assert [(r.connection_id, r.grade, r.score) for r in got] == [("bad", "F", 0.0), ("good", "A", 100.0)]
    assert len(got[0].top_remediations) == 3 and list(got[1].top_remediations) == []
    ranks = spark.createDataFrame([("?",), ("F",), ("A",), ("x",)], "g string").select("g", grade_rank(F.col("g")).alias("r")).collect()
    assert {r.g: r.r for r in ranks} == {"?": 5, "F": 4, "A": 0, "x": 5}


def test_unreadable_model_grade_keeps_the_text(spark):
    got = lw.score_readiness(ids(spark, "a"), log(spark, ("a", "2024-01-30")), events(spark, ("a", "RENAME", "2024-01-20")), columns(spark, ("x", "JSON"), conn="a"), AS_OF, model_fn=lambda p: " not json ").collect()[0]
    assert (got.grade, got.narrative, list(got.top_remediations), got.breaking_changes) == ("?", "not json", [], 1)


def failures(spark, *rows):
    df = spark.createDataFrame([(f"l{i}", *r) for i, r in enumerate(rows)], "log_id string, connection_id string, error_code string, error_message string, t string")
    return df.withColumn("failed_at", F.col("t").cast("timestamp"))


def test_top_errors_sample_and_ties(spark):
    rows = [
        ("a", "SCHEMA_CHANGE_REQUIRED", "old", "2024-01-29"),
        ("a", "SCHEMA_CHANGE_REQUIRED", None, "2024-01-30"),
        ("a", "CONNECTION_FAILED", "m", "2024-01-28"),
        ("a", "", "blank", "2024-01-29"),
        ("a", None, "null", "2024-01-27"),
        ("a", "OLD", "x", "2024-01-01"),
    ]
    got = [(r.error_code, r["count"], r.sample_message) for r in lw.failure_top_errors(failures(spark, *rows), AS_OF).orderBy("rank").collect()]
    # The newest message counts even when it is NULL; ties go to the latest failure.
    assert got == [("SCHEMA_CHANGE_REQUIRED", 2, ""), ("UNKNOWN", 2, "blank"), ("CONNECTION_FAILED", 1, "m")]


@pytest.mark.parametrize("n, level", [(0, "LOW"), (1, "LOW"), (2, "MEDIUM"), (4, "MEDIUM"), (5, "HIGH"), (9, "HIGH"), (10, "CRITICAL"), (99, "CRITICAL")])
def test_severity(spark, n, level):
    assert spark.range(1).select(lw.severity_from_count(F.lit(n)).alias("s")).collect()[0].s == level


def test_diagnosis_counts_all_failures_and_uses_live_status(spark):
    rows = [("a", f"E{i}", "m", "2024-01-30") for i in range(6)] * 2
    status = spark.createDataFrame(
        [("a", "error", []), ("b", "broken", []), ("c", "scheduled", [("X", "down"), (None, None)]), ("d", "scheduled", []), ("f", "scheduled", None)],
        "connection_id string, sync_state string, tasks array<struct<code string, message string>>",
    )
    asked = ids(spark, "a", "b", "c", "d", "e", "f")
    got = {r.connection_id: r for r in lw.diagnose_failures(asked, failures(spark, *rows), AS_OF, connector_status=status).collect()}
    assert (got["a"].failure_count, len(got["a"].top_errors), got["a"].severity, got["a"].source) == (12, 5, "CRITICAL", "log")
    assert [e.error_code for e in got["b"].top_errors] == ["BROKEN"] and got["b"].source == "status"
    assert [(e.error_code, e.sample_message) for e in got["c"].top_errors] == [("X", "down"), ("UNKNOWN", "")] and got["c"].severity == "MEDIUM"
    assert {got[x].status for x in "def"} == {"no_failures"} and got["d"].severity is None


def test_all_open_tasks_count_and_five_are_listed(spark):
    status = spark.createDataFrame([("a", "error", [(f"T{i}", "m") for i in range(12)])], "connection_id string, sync_state string, tasks array<struct<code string, message string>>")
    rows = lw.connector_status_errors(status).collect()
    assert [r.total_errors for r in rows] == [12] * 5
    none = failures(spark, ("z", "E", "m", "2024-01-30"))
    row = lw.diagnose_failures(ids(spark, "a"), none, AS_OF, connector_status=status).collect()[0]
    assert (row.failure_count, row.severity, len(row.top_errors)) == (12, "CRITICAL", 5)


def test_model_is_asked_only_about_failures_and_its_level_is_checked(spark):
    reply = lambda level: lambda p: '{"diagnosis": "d", "recommended_actions": ["x"], "severity": "%s"}' % level
    frame = failures(spark, ("a", "E", "m", "2024-01-30"))
    good = {r.connection_id: r for r in lw.diagnose_failures(ids(spark, "a", "b"), frame, AS_OF, model_fn=reply("high")).collect()}
    assert good["a"].severity == "HIGH" and good["b"].severity is None and good["b"].diagnosis is None
    odd = lw.diagnose_failures(ids(spark, "a"), frame, AS_OF, model_fn=reply("awful")).collect()[0]
    assert odd.severity == "LOW"


def test_completeness_finds_soft_dropped_columns(spark):
    df = spark.createDataFrame([(1, None, ""), (2, None, "x")], "a int, b string, c string")
    got = {r.column_name: r for r in lw.column_completeness(df).collect()}
    assert got["b"].is_empty and got["b"].missing_pct == 100.0 and got["c"].blank_count == 1 and got["a"].approx_distinct == 2
