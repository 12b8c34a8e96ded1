"""Schemas of the landed-metadata frame, the seven state tables and the sync event body.

Every state table is append-only parquet, partitioned by the date of its event time and
sorted inside each file by its cluster columns, so date filters prune directories and
connection filters skip row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(required: str, optional: str = "", order: str = "", **types) -> StructType:
    """Build a StructType from space-separated names; untyped names are strings."""
    req, opt = required.split(), optional.split()
    names = order.split() or req + opt
    return StructType(
        [StructField(n, types.get(n, StringType()), n not in req) for n in names]
    )


COLUMN_STRUCT = _struct(
    "",
    "table_schema table_name column_name data_type ordinal_position is_nullable",
    ordinal_position=LongType(),
    is_nullable=BooleanType(),
)

LANDED_COLUMNS = _struct(
    "connection_id table_schema table_name column_name data_type ordinal_position",
    "is_nullable",
    ordinal_position=LongType(),
    is_nullable=BooleanType(),
)

SYNC_EVENT_BODY = StructType(
    [
        StructField(n, StringType())
        for n in (
            "event created connector_type connector_id connector_name sync_id destination_group_id"
        ).split()
    ]
    + [StructField("data", StructType([StructField("status", StringType())]))]
)

RAW_SYNC_EVENT = _struct(
    "", "body signature received_at", received_at=TimestampType()
)

# -- fixed values: vocabularies of the data model ------------------------------------
CHANGE_TYPES = ("RENAME", "TYPE_PROMOTION", "REORDER", "NEW_FIELD", "DEPRECATION")
BREAKING_CHANGE_TYPES = ("TYPE_PROMOTION", "DEPRECATION", "RENAME")
REMEDIATION_STATUSES = ("PROPOSED", "APPROVED", "APPLIED", "REJECTED", "VERIFIED")
TRIGGER_EVENTS = ("sync_end", "manual", "scheduled")
SENSITIVITY_CLASSES = ("PII", "FINANCIAL", "HEALTH", "SAFE")
MASKING_STRATEGIES = ("HASH", "REDACT", "TOKENIZE", "GENERALIZE")
AUTONOMY_LEVELS = ("STRICT", "TRUSTED_ADDITIVE", "FULL_AUTO")


@dataclass(frozen=True)
class StateTable:
    """One state table: its columns, event-time column, cluster columns and row id."""

    schema: StructType
    time_column: str
    cluster_by: tuple[str, ...]
    row_id: tuple[str, ...]

    @property
    def date_column(self) -> str:
        return f"{self.time_column}_date"


STATE_TABLES: dict[str, StateTable] = {
    "schema_snapshots": StateTable(
        _struct(
            "snapshot_id connection_id destination_schema captured_at trigger_event content_hash",
            order="snapshot_id connection_id connection_name destination_schema captured_at "
            "trigger_event sync_id column_count content_hash",
            captured_at=TimestampType(),
            column_count=LongType(),
        ),
        "captured_at",
        ("connection_id",),
        ("snapshot_id",),
    ),
    "column_snapshots": StateTable(
        _struct(
            "snapshot_id connection_id table_schema table_name column_name data_type "
            "ordinal_position captured_at",
            order="snapshot_id connection_id table_schema table_name column_name data_type "
            "ordinal_position is_nullable captured_at",
            captured_at=TimestampType(),
            ordinal_position=LongType(),
            is_nullable=BooleanType(),
        ),
        "captured_at",
        ("connection_id", "table_name"),
        ("snapshot_id", "table_schema", "table_name", "column_name"),
    ),
    "drift_events": StateTable(
        StructType(
            _struct(
                "drift_id connection_id detected_at from_snapshot_id to_snapshot_id table_schema "
                "table_name change_type remediation_status updated_at",
                order="drift_id connection_id detected_at from_snapshot_id to_snapshot_id "
                "table_schema table_name change_type column_before column_after "
                "classification_conf rationale remediation_sql transformation_id "
                "remediation_status approved_by updated_at",
                detected_at=TimestampType(),
                updated_at=TimestampType(),
                classification_conf=DoubleType(),
                column_before=COLUMN_STRUCT,
                column_after=COLUMN_STRUCT,
            ).fields
        ),
        "detected_at",
        ("connection_id", "remediation_status"),
        ("drift_id",),
    ),
    "sync_log": StateTable(
        _struct(
            "log_id connection_id synced_at received_at",
            order="log_id connection_id sync_id synced_at received_at",
            synced_at=TimestampType(),
            received_at=TimestampType(),
        ),
        "synced_at",
        ("connection_id",),
        ("log_id",),
    ),
    "json_flattener_log": StateTable(
        _struct(
            "log_id connection_id table_name column_name view_name view_sql generated_at",
            "deployed",
            generated_at=TimestampType(),
            deployed=BooleanType(),
        ),
        "generated_at",
        ("connection_id",),
        ("log_id",),
    ),
    "entity_map": StateTable(
        _struct(
            "detection_id entity_name connection_id table_name detected_at",
            order="detection_id entity_name connection_id table_name join_key_col confidence "
            "conflicts detected_at",
            detected_at=TimestampType(),
            confidence=DoubleType(),
            conflicts=ArrayType(StringType()),
        ),
        "detected_at",
        ("entity_name",),
        ("detection_id", "entity_name", "connection_id", "table_name"),
    ),
    "sync_failure_log": StateTable(
        _struct(
            "log_id connection_id failed_at",
            order="log_id connection_id sync_id error_code error_message failed_at table_name",
            failed_at=TimestampType(),
        ),
        "failed_at",
        ("connection_id",),
        ("log_id",),
    ),
}

# Transitions of drift events are kept in their own append log; reading folds them over
# the inserted events. ``set_fields`` names the columns a row sets, so a field can be set
# to NULL on purpose.
DRIFT_UPDATE_FIELDS = tuple(
    f.name for f in STATE_TABLES["drift_events"].schema.fields if f.name != "drift_id"
)
DRIFT_UPDATES = StateTable(
    StructType(
        [
            StructField("drift_id", StringType(), False),
            StructField("set_fields", ArrayType(StringType()), False),
            *(
                StructField(f.name, f.dataType, True)
                for f in STATE_TABLES["drift_events"].schema.fields
                if f.name != "drift_id"
            ),
        ]
    ),
    "updated_at",
    ("drift_id",),
    ("drift_id", "updated_at", "set_fields"),
)

STATE_SCHEMAS: dict[str, StructType] = {n: t.schema for n, t in STATE_TABLES.items()}
