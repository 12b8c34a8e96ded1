"""Readiness grades and drift-volatility classes for the whole fleet."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.operators.freshness import DEFAULT_SLA_HOURS, freshness_signal
from landwatch.operators.model import build_prompts, run_model, with_fallbacks
from landwatch.operators.signals import drift_stability, drift_volatility, schema_signals
from landwatch.sources.metadata import active_connections

# -- fixed values: order of grades, volatility limits, text for an empty window ----------
GRADE_ORDER = ("A", "B", "C", "D", "F", "?")
CHANGES_PER_WEEK_LIMIT = 2
CRITICAL_BREAKING = 5
NO_DRIFT = "No drift events recorded in the specified window."

# Deductions of the default grade (ours) and the score each letter starts at.
_STALE, _NEVER, _PER_BREAKING, _MAX_BREAKING, _PER_PERCENT = 25.0, 40.0, 5.0, 25.0, 0.25
_LETTERS = {"A": 90, "B": 80, "C": 70, "D": 60}


def readiness_signals(
    ids: DataFrame,
    sync_log: DataFrame,
    events: DataFrame,
    landed: DataFrame,
    as_of: str | datetime,
    sla_hours: float = DEFAULT_SLA_HOURS,
    days: int = 30,
) -> DataFrame:
    """All signals of the given connections, one row each.

    Each input is read once and reduced to one row per connection before the joins, which
    then move only those small rows.
    """
    fresh = freshness_signal(ids, sync_log, as_of, sla_hours)
    drift = drift_stability(ids, events, as_of, days)
    schema = schema_signals(landed)
    zero = {
        "total_columns": 0,
        "semi_structured_columns": 0,
        "semi_structured_pct": 0.0,
        "incoherent_names": 0,
        "incoherent_pct": 0.0,
    }
    return (
        fresh.withColumnRenamed("status", "freshness_status")
        .join(drift, "connection_id")
        .join(schema, "connection_id", "left")
        .fillna(zero)
    )


def _score() -> tuple[dict[str, Column], Column]:
    parts = {
        "freshness": F.when(F.col("freshness_status") == "STALE", _STALE)
        .when(F.col("freshness_status") == "NEVER_SYNCED", _NEVER)
        .otherwise(F.lit(0.0)),
        "drift": F.least(F.col("breaking_changes") * F.lit(_PER_BREAKING), F.lit(_MAX_BREAKING)),
        "types": F.col("semi_structured_pct") * _PER_PERCENT,
        "naming": F.col("incoherent_pct") * _PER_PERCENT,
    }
    return parts, F.round(F.lit(100.0) - sum(parts.values(), F.lit(0.0)), 3)


_ADVICE = {
    "freshness": "Restore syncing so the data meets its freshness SLA",
    "drift": "Review the breaking schema changes with the source owner",
    "types": "Flatten semi-structured columns into typed ones",
    "naming": "Give short or numbered columns descriptive names",
}


def grade_by_rules(signals: DataFrame) -> DataFrame:
    """Add ``score``, ``grade``, ``narrative`` and up to three ``top_remediations``: the
    largest deductions first."""
    parts, score = _score()
    letter = F
    for name, floor in _LETTERS.items():
        letter = letter.when(F.col("score") >= floor, name)
    ranked = F.sort_array(
        F.array(*[F.struct(parts[p].alias("d"), F.lit(-i).alias("i"), F.lit(_ADVICE[p]).alias("t")) for i, p in enumerate(parts)]),
        asc=False,
    )
    advice = F.transform(F.slice(F.filter(ranked, lambda r: r["d"] > 0), 1, 3), lambda r: r["t"])
    narrative = F.format_string(
        "Freshness is %s; %d of %d recent schema changes were breaking; %s%% of columns are semi-structured and %s%% have unclear names.",
        "freshness_status", "breaking_changes", "total_changes",
        F.col("semi_structured_pct").cast("string"), F.col("incoherent_pct").cast("string"),
    )
    return (
        signals.withColumn("score", score)
        .withColumn("grade", letter.otherwise(F.lit("F")))
        .withColumns({"narrative": narrative, "top_remediations": advice})
    )


def score_readiness(
    ids: DataFrame,
    sync_log: DataFrame,
    events: DataFrame,
    landed: DataFrame,
    as_of: str | datetime,
    model_fn: Callable[[str], str] | None = None,
    sla_hours: float = DEFAULT_SLA_HOURS,
) -> DataFrame:
    """Grade, narrative and remediations of the given connections, with their signals.

    With a model there is one prompt per connection; an unreadable reply gives grade '?'
    and the raw text as narrative.
    """
    signals = readiness_signals(ids, sync_log, events, landed, as_of, sla_hours)
    if model_fn is None:
        return grade_by_rules(signals)
    replies = run_model(build_prompts(signals, "readiness"), model_fn)
    return with_fallbacks(replies, "readiness").drop("prompt", "raw")


def readiness_fleet(
    sync_log: DataFrame,
    events: DataFrame,
    landed: DataFrame,
    as_of: str | datetime,
    model_fn: Callable[[str], str] | None = None,
    sla_hours: float = DEFAULT_SLA_HOURS,
    ordered: bool = False,
) -> DataFrame:
    """Readiness of every connection that has synced, worst first when ``ordered``: an
    unknown grade sorts before F, equal grades by connection."""
    scored = score_readiness(
        active_connections(sync_log), sync_log, events, landed, as_of, model_fn, sla_hours
    )
    return scored.orderBy(F.desc(grade_rank(F.col("grade"))), "connection_id") if ordered else scored


def grade_rank(grade: Column) -> Column:
    ladder = F
    for rank, name in enumerate(GRADE_ORDER):
        ladder = ladder.when(grade == name, rank)
    return ladder.otherwise(F.lit(len(GRADE_ORDER) - 1))


def stability_class(total_per_week: Column, breaking: Column) -> Column:
    return (
        F.when(breaking >= CRITICAL_BREAKING, "CRITICAL")
        .when((total_per_week >= CHANGES_PER_WEEK_LIMIT) | (breaking > 0), "VOLATILE")
        .otherwise(F.lit("STABLE"))
    )


def volatility_class(
    volatility: DataFrame, model_fn: Callable[[str], str] | None = None, ordered: bool = False
) -> DataFrame:
    """Add stability_class, narrative and recommendation to each connection's volatility.

    With a model there is one prompt per connection; one it does not answer is UNKNOWN.
    """
    if model_fn is None:
        out = volatility.withColumn(
            "stability_class", stability_class(F.col("changes_per_week"), F.col("breaking_changes"))
        )
        out = out.withColumns(
            {
                "narrative": F.format_string(
                    "%d schema changes, %d of them breaking.", "total_changes", "breaking_changes"
                ),
                "recommendation": F.when(F.col("stability_class") == "CRITICAL", "Freeze the source schema until its breaking changes are resolved.")
                .when(F.col("stability_class") == "VOLATILE", "Agree on a change process with the source owner.")
                .otherwise(F.lit("No action needed.")),
            }
        )
    else:
        replies = run_model(build_prompts(volatility, "volatility"), model_fn)
        out = with_fallbacks(replies, "volatility").drop("prompt", "raw")
    return out.orderBy(F.desc("changes_per_week"), "connection_id") if ordered else out


def fleet_summary(classified: DataFrame) -> DataFrame:
    """One row: connections per class and a sentence; a fixed sentence without events."""
    counts = classified.agg(
        F.count(F.lit(1)).alias("n_connections"),
        *[F.count_if(F.col("stability_class") == c).alias(f"n_{c.lower()}") for c in ("STABLE", "VOLATILE", "CRITICAL")],
    )
    sentence = F.format_string(
        "%d connections drifted: %d critical, %d volatile, %d stable.",
        "n_connections", "n_critical", "n_volatile", "n_stable",
    )
    return counts.withColumn(
        "fleet_summary", F.when(F.col("n_connections") == 0, NO_DRIFT).otherwise(sentence)
    )


def analyze_drift_volatility(
    events: DataFrame,
    as_of: str | datetime,
    days: int = 30,
    model_fn: Callable[[str], str] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Volatility of every connection with events in the window, classified."""
    return volatility_class(drift_volatility(events, as_of, days), model_fn, ordered)
