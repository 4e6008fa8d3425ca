"""Explicit Spark schemas of the lake's tables; payload and meta are JSON text."""

from __future__ import annotations

OBSERVATIONS = """
append_seq bigint, id string, schema string, schema_version string, observer string, source_system string, actor string,
authority_model string, capture_model string, subject string, target string, payload string, attachments array<string>,
published timestamp, published_nanos bigint, recorded_at timestamp, consent string, idempotency_key string, meta string
"""
DRAFTS = """
schema string, schema_version string, observer string, source_system string, authority_model string, capture_model string,
subject string, target string, payload string, attachments array<string>, published timestamp, idempotency_key string, meta string
"""
SUPPLEMENTALS = """
seq bigint, id string, kind string, derived_from struct<observations: array<string>, blobs: array<string>, supplementals: array<string>>,
payload string, created_by string, created_at timestamp, mutability string, record_version string, model_version string,
consent_metadata struct<referenced_observation_id: string, retracted_at: timestamp, opt_out_strategy: string, opt_out_effective_at: timestamp>, lineage string
"""
OPERATIONAL_EVENTS = """
cursor bigint, event_id string, data_space_id string, stream_id string, stream_version bigint, event_type string, occurred_at timestamp,
actor_type string, actor_id string, correlation_id string, causation_id string, idempotency_key string, event_sha256 string, observation_id string
"""
CORPUS = """
record_id string, source_type string, anchor_url string, source_title string, source_location string, timestamp timestamp, ts_nanos bigint,
text string, normalized_text string, thread_ts string, container string, metadata string
"""
HISTORY_ENTRIES = """
cursor bigint, event_id string, session_ref string, source_message_ref string, source_kind string, source_instance_id string,
source_session_id string, source_message_id string, parent_message_id string, published_at timestamp, ordinal bigint, author string,
surface string, channel string, text string, record_kind string, record_key string, record_status string, raw_blob_ref string,
raw_sha256 string, raw_bytes bigint, metadata map<string, string>
"""
CHANNELS = """
id string, kind string, source_instance_id string, external_id string, connection_ref string, default_consent_scope string,
reply_slo_seconds bigint, freshness_threshold_seconds bigint, break_glass_channel boolean, break_glass_senders array<string>, enabled boolean
"""
