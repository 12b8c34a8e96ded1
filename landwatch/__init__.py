"""Is landed data still fit for analytics and AI use? Spark operators for whole fleets."""

from landwatch.operators.classify import apply_shim, classify_changes, create_shim_view, shim_sql
from landwatch.operators.coverage import coverage_pct, fuzzy_field_match
from landwatch.operators.docs import schema_docs
from landwatch.operators.drift import (
    attribute_collateral_reorder,
    autonomy_filter,
    changed_columns,
    content_hash,
    diff_columns,
    diff_deprecation,
    diff_kept,
    diff_new_field,
    diff_rename_candidates,
    hash_gate,
    list_proposed,
    match_columns,
    needs_human_review,
    ordinal_delta,
    rank_rename_candidates,
)
from landwatch.operators.entities import entity_occurrences, entity_overlap_pairs
from landwatch.operators.failures import (
    connector_status_errors,
    failure_count,
    failure_top_errors,
    severity_from_count,
)
from landwatch.operators.freshness import (
    freshness_check,
    freshness_fleet,
    freshness_signal,
    receiver_latency,
)
from landwatch.operators.jsonflat import (
    detect_json_columns,
    flatten_json,
    flatten_json_long,
    flatten_view,
    flatten_view_parts,
    infer_json_structure,
)
from landwatch.operators.lifecycle import drift_lifecycle
from landwatch.operators.model import (
    RememberedModel,
    build_prompts,
    merge_model_rows,
    run_model,
    validate_classification,
    with_fallbacks,
)
from landwatch.operators.sensitivity import (
    build_token_vault,
    classify_sensitivity,
    detokenize,
    mask_columns,
    sensitive_columns,
    sensitivity_tier_filter,
)
from landwatch.operators.signals import (
    column_completeness,
    column_profiles,
    completeness_of,
    drift_stability,
    drift_volatility,
    merge_profiles,
    naming_coherence,
    type_suitability,
)
from landwatch.plans.detect import detect_drift, plan_drift, retry_rejected
from landwatch.plans.diagnosis import diagnose_failures
from landwatch.plans.entity_map import entity_map_rows, entity_overlaps
from landwatch.plans.flattening import generate_flattener
from landwatch.plans.readiness import (
    analyze_drift_volatility,
    fleet_summary,
    readiness_fleet,
    score_readiness,
    volatility_class,
)
from landwatch.plans.use_case import coverage_summary, required_fields, use_case_coverage
from landwatch.schemas import STATE_SCHEMAS, STATE_TABLES
from landwatch.sources.footers import landed_columns_from_footers
from landwatch.sources.landed_store import read_landed, write_landed
from landwatch.sources.metadata import (
    active_connections,
    exclude_system_columns,
    landed_columns,
    landed_columns_from_rows,
    normalize_column_rows,
    resolve_destination,
    schema_by_table,
)
from landwatch.sources.rows import failure_window_scan, json_sample, time_window_filter
from landwatch.sources.snapshots import latest_snapshot, snapshot_columns, snapshot_pairs
from landwatch.sources.state import (
    compact_state,
    drift_events_current,
    entity_map_latest,
    head_snapshots,
    insert_drift_event,
    read_state,
    update_drift_event,
    write_entity_map,
    write_flattener_log,
    write_snapshot,
    write_sync_log,
)
from landwatch.sources.sync_events import (
    accepted_syncs,
    route_sync_events,
    sync_event_source,
)
from landwatch.streaming.detect import stream_detect_drift
from landwatch.streaming.sync_log import stream_receiver_latency, stream_sync_log

__all__ = [name for name in dir() if not name.startswith("_")]
