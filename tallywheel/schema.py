"""Tables of the usage ledger."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 1
BUCKETS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")
CONFIDENCE = ("exact", "derived", "estimated")  # best to worst
REPORTED, ESTIMATE, CREDIT, UNPRICED = "provider_reported", "api_equivalent_estimate", "subscription_credit", "unpriced"

COSTS = "array<struct<kind:string,usd_nanos:bigint,confidence:string>>"
RECORD = (
    "source_object_id string, event_id string, session_id string, client string, provider string, model string, occurred_at_unix_ms bigint, "
    + ", ".join(f"{b} bigint" for b in BUCKETS)
    + ", source_reported_total bigint, confidence string, native_id string, record_offset bigint, schema_variant string, timestamp_origin string, "
    + f"normalization_notes array<string>, costs {COSTS}"
)
#: What must not change when a source shows an event again; the place in the file may.
FACTS = (
    "session_id", "client", "provider", "model", "occurred_at_unix_ms", *BUCKETS, "source_reported_total", "confidence", "native_id",
    "schema_variant", "timestamp_origin", "normalization_notes",
)

TABLES = {
    "source_installations": "id string, adapter_id string, root_path string, platform string, discovery_method string, enabled boolean, permission_state string",
    "source_objects": "id string, installation_id string, native_path string, kind string, fingerprint string, parser_version int, byte_offset bigint, source_len bigint, "
    "prefix_fingerprint string, last_scan_unix_ms bigint, last_success_unix_ms bigint, last_error string, modified_ns bigint, parser_state string",
    "usage_events": "source_object_id string, event_id string, session_id string, client string, provider string, model string, occurred_at_unix_ms bigint, "
    + ", ".join(f"{b} bigint" for b in BUCKETS)
    + ", source_reported_total bigint, confidence string",
    "event_provenance": "source_object_id string, event_id string, native_id string, record_offset bigint, schema_variant string, timestamp_origin string, normalization_notes array<string>",
    "event_costs": "source_object_id string, event_id string, kind string, usd_nanos bigint, pricing_snapshot_id bigint, pricing_key string, pricing_rule string, confidence string",
    "ingest_runs": "id bigint, source_object_id string, mode string, status string, started_unix_ms bigint, finished_unix_ms bigint, seen bigint, inserted bigint, duplicates bigint, deleted bigint, "
    "warnings array<string>, error string",
    # Warnings of scans, a row each: a file may have as many as it has lines. Those that a caller names stand in their run.
    "ingest_warnings": "run_id bigint, source_object_id string, warning string",
    # Kept by each commit: what reading the events anew would give.
    "daily_usage_utc": "month string, day string, client string, provider string, model string, " + ", ".join(f"{b} bigint" for b in BUCKETS) + ", event_count bigint",
    "session_parts": "source_object_id string, session_id string, started_unix_ms bigint, ended_unix_ms bigint, last_event_id string, client string",
    "pricing_snapshots": "id bigint, source string, dataset_version string, content_hash string, fetched_at_unix_ms bigint",
}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
