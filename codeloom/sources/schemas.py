"""Schemas of the model's relations and of the stored tables."""

from __future__ import annotations

RESPONSE = "response_id bigint, question string, content string, source string, meta map<string,string>"
SEGMENT = "segment_id string, response_id bigint, start int, end int, text string"
EVIDENCE_ITEM = "response_id bigint, quote string, span array<int>, verified boolean, score double"
CODE = f"id string, name string, description string, parent_id string, created_in_snapshot string, evidence array<struct<{EVIDENCE_ITEM.replace(' bigint', ':bigint').replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean').replace(' double', ':double')}>>, meta map<string,string>"
ASSIGNMENT = "response_id bigint, segment string, code string"
OPERATION = "type string, targets array<string>, payload string, rationale string"
FINDING = "check_id string, severity string, scope string, subject string, message string, data string"

#: Stored tables: columns, key, and whether rows may be replaced by later ones of the same key.
TABLES = {
    "meta": ("key string, value string", ["key"]),
    "runs": ("run_id string, created_at string, config_json string", ["run_id"]),
    "responses": (RESPONSE, ["response_id", "source"]),
    "snapshots": ("snapshot_id string, parent_id string, run_id string, reason string, created_at string, codebook_json string", ["snapshot_id"]),
    "codings": ("coding_id string, run_id string, response_id bigint, source string, coder string, snapshot_id string, prompt_version string", ["coding_id"]),
    "candidates": ("candidate_id string, coding_id string, name string, description string, ordinal int", ["candidate_id"]),
    "assignments": ("assignment_id string, run_id string, response_id bigint, source string, code_id string, code_name string, segment_text string, span_start int, span_end int, snapshot_id string", ["assignment_id"]),
    "findings": ("finding_id string, run_id string, " + FINDING, ["finding_id"]),
    "audit": ("run_id string, event_id bigint, created_at string, event string, scope string, subject string, snapshot_id string, payload string", ["run_id", "event_id"]),
    "llm_calls": ("call_id string, run_id string, task string, provider string, model string, input_tokens bigint, output_tokens bigint, latency_ms double, cached boolean", ["call_id"]),
    "checkpoints": ("checkpoint_id string, run_id string, at_response_count bigint, trigger string, base_snapshot_id string, status string, decided_json string", ["checkpoint_id", "status"]),
    "health_metrics": ("run_id string, batch bigint, metric string, value double", ["run_id", "batch", "metric"]),
}
