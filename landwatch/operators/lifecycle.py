"""The review lifecycle of drift events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.sources.state import fold_drift_events, normalize_updates

# -- fixed values: status each action sets -------------------------------------------------
ACTIONS = {"approve": "APPROVED", "reject": "REJECTED", "apply": "APPLIED", "verify": "VERIFIED"}
# Status an event must have before each action in strict mode.
_FROM = {"approve": "PROPOSED", "reject": "PROPOSED", "apply": "APPROVED", "verify": "APPLIED"}


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def lifecycle_updates(transitions: DataFrame) -> DataFrame:
    """Field updates for a batch of reviewer actions.

    ``transitions`` has drift_id, action (approve, reject, apply, verify), actor (reviewer,
    for approve and reject), transformation_id (for apply) and updated_at.
    """
    action = F.lower("action")
    reviewed = action.isin("approve", "reject")
    return transitions.filter(action.isin(*ACTIONS)).select(
        "drift_id",
        F.when(reviewed, F.array(F.lit("remediation_status"), F.lit("approved_by")))
        .when(action == "apply", F.array(F.lit("remediation_status"), F.lit("transformation_id")))
        .otherwise(F.array(F.lit("remediation_status")))
        .alias("set_fields"),
        _mapped(ACTIONS, action).alias("remediation_status"),
        F.when(reviewed, F.col("actor")).alias("approved_by"),
        F.when(action == "apply", F.col("transformation_id")).alias("transformation_id"),
        "updated_at",
    )


def check_transitions(current: DataFrame, transitions: DataFrame) -> DataFrame:
    """Transitions with ``is_legal``: the action exists, the event exists, and its current
    status is the one the action starts from."""
    action = F.lower("action")
    status = current.select("drift_id", F.col("remediation_status").alias("_status"))
    legal = F.coalesce(F.col("_status") == _mapped(_FROM, action), F.lit(False))
    return transitions.join(status, "drift_id", "left").withColumn("is_legal", legal).drop("_status")


def drift_lifecycle(
    current: DataFrame, transitions: DataFrame, strict: bool = False
) -> DataFrame:
    """Drift events after a batch of reviewer actions.

    By default any action is taken from any status. ``strict`` drops actions that do not
    start from the event's current status; ``check_transitions`` lists those.
    """
    if strict:
        legal = check_transitions(current, transitions).filter("is_legal")
        transitions = legal.drop("is_legal")
    updates = normalize_updates(lifecycle_updates(transitions))
    return fold_drift_events(current, updates)
