"""Schemas of the record contract, the answer package and the result tables."""

from __future__ import annotations

MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"

# Fixed values. Enumerations of the record contract.
ROLES = ("system", "user", "assistant")
DATA_TYPES = ("sft", "reasoning", "preference")
CONVERSATION_TYPES = ("single", "multi_turn")
MODES = (
    "tcu_offline", "cache_stale", "eligibility", "payment_webhook", "token_scope", "abstention",
    "knowledge", "differential", "distractor",
)
KEEP_AUDIT = ("approved",)

COMMON = (
    "id STRING, data_type STRING, mode STRING, persona STRING, source STRING, lang STRING, "
    "version STRING, audit_status STRING"
)

#: One wide, nullable row type for the three record shapes.
RECORD = (
    f"{COMMON}, conversation_type STRING, messages {MESSAGES}, situation STRING, "
    f"reasoning ARRAY<STRING>, response STRING, why STRING, bad_type STRING, "
    f"prompt {MESSAGES}, chosen {MESSAGES}, rejected {MESSAGES}"
)

#: The same message lists with open keys, to see keys the contract forbids.
RECORD_KEYS = ", ".join(
    f"{name} ARRAY<MAP<STRING, STRING>>" for name in ("messages", "prompt", "chosen", "rejected")
)

GOLD = (
    f"id STRING, mode STRING, leading_root_cause STRING, persona STRING, messages {MESSAGES}, "
    "prompt STRING, question STRING, situation STRING, input STRING, reference STRING, "
    "response STRING, answer STRING, gold STRING, expected STRING"
)

LADDER_STEP = (
    "STRUCT<tier: DOUBLE, action: STRING, addresses: STRING, expected_time: STRING, "
    "verify: STRING, if_fails: STRING>"
)

#: The answer package a model returns after its thinking block.
PACKAGE = (
    "diagnosis STRUCT<leading_root_cause: STRING, confidence: STRING, "
    "differential: ARRAY<STRUCT<rc: STRING, likelihood: STRING, why: STRING>>, "
    "evidence_in_ticket: ARRAY<STRING>, to_confirm: ARRAY<STRING>, sub_cause: STRING>, "
    "runbook_id STRING, why_plain STRING, why_technical STRING, owner_team STRING, "
    "support_contact STRING, escalation STRING, severity STRING, priority STRING, "
    "compensation STRUCT<offer: STRING, proactive: BOOLEAN, note: STRING>, "
    f"customer_self_service ARRAY<{LADDER_STEP}>, "
    "artifacts STRUCT<rca_md: STRING, work_order_md: STRING, customer_email: STRING, "
    "diagram_mermaid: STRING>"
)

# Fixed values. Fields a complete package must fill, and its four artifacts.
REQUIRED_FIELDS = (
    "runbook_id", "owner_team", "support_contact", "escalation", "fix_steps", "eta_ttr",
    "severity", "priority", "churn_risk", "compensation", "customer_self_service",
)
ARTIFACTS = ("rca_md", "work_order_md", "customer_email", "diagram_mermaid")

#: Per-answer evaluation row, the central fact table.
SAMPLE = (
    "id STRING, slice STRING, gold_rc STRING, pred_rc STRING, correct BOOLEAN, "
    "confidence DOUBLE, cue_grounded_frac DOUBLE, no_fabricated_telemetry BOOLEAN, "
    "runbook_complete BOOLEAN, runbook_fidelity BOOLEAN, artifacts_valid BOOLEAN, "
    "self_service_ok BOOLEAN, telemetry_hits STRING"
)

KPI_REPORT = (
    "n BIGINT, rc_accuracy DOUBLE, rc_accuracy_clear DOUBLE, cue_faithfulness DOUBLE, "
    "no_fabrication_rate DOUBLE, runbook_completeness DOUBLE, runbook_fidelity DOUBLE, "
    "artifact_valid_at_1 DOUBLE, self_service_present_rate DOUBLE, "
    "abstention_hallucination DOUBLE, ece DOUBLE, overconfident_wrong_rate DOUBLE, "
    "parse_fail_rate DOUBLE, latency STRUCT<n: BIGINT, p50: DOUBLE, p95: DOUBLE, mean: DOUBLE>, "
    "extras STRUCT<model: STRING>"
)

RUBRIC_SUMMARY = (
    "n: BIGINT, weighted_avg_5: DOUBLE, weighted_avg_10: DOUBLE, "
    "per_criterion_mean: MAP<STRING, DOUBLE>"
)
RUBRIC_REPORT = (
    f"overall STRUCT<{RUBRIC_SUMMARY}>, per_mode MAP<STRING, STRUCT<{RUBRIC_SUMMARY}>>, "
    "extras STRUCT<model: STRING, pairwise_vs_reference: STRUCT<win: DOUBLE, tie: DOUBLE, "
    "loss: DOUBLE, n: DOUBLE>>"
)

# Fixed values. Rubric criteria with their default weights.
WEIGHTS = {
    "factuality": 2.0,
    "safety": 2.0,
    "helpfulness": 1.5,
    "tone": 1.0,
    "completeness": 1.0,
    "format": 0.5,
    "language_quality": 1.0,
}

PRODUCT = (
    "series STRING, name STRING, storage_gb BIGINT, price BIGINT, color STRING, "
    "availability STRING, crawl_note STRING, chip STRING, screen_inch DOUBLE, "
    "camera_main_mp BIGINT, warranty_months BIGINT"
)

PARSE_FAIL = "PARSE_FAIL"
