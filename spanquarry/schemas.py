"""Table layouts and the names shared by several operators."""
# Evaluator names (who wrote a score row).
AUTO_EVAL = "auto.eval"
AUTO_AGENT = "auto.agent"
AUTO_SECURITY = "auto.security"
HUMAN_FEEDBACK = "human.feedback"
HUMAN_ANNOTATION = "human.annotation"
HUMAN_PREFIX = "human."

# The layer whose row carries the run-level score of an agentic evaluation.
RUN_LAYER = "deterministic"
LAYERS = ["deterministic", "tool_selection", "trajectory", "coordination"]

# The ten detections of a security scan, without their ``_detected`` suffix.
THREATS = [
    "injection", "jailbreak", "skeleton_key", "secrets", "indirect_injection",
    "rag_poisoning", "tool_exfiltration", "tool_policy_violation",
    "cross_agent_injection", "image_injection",
]

TRACE_KEY = ["organization_id", "trace_id"]
RUN_KEY = ["organization_id", "root_trace_id"]


# Layouts are DDL texts, which readers and ``createDataFrame`` take as they are.
TRACES = (
    "organization_id string, api_key_prefix string, trace_id string, root_trace_id string, "
    "parent_id string, event string, type string, integration string, model string, "
    "status string, success boolean, latency double, function string, name string, "
    "retention_days int, is_root int, agent_key string, agent_kind string, ingested_at timestamp"
)
TRACE_COSTS = (
    "organization_id string, api_key_prefix string, trace_id string, root_trace_id string, "
    "provider string, model string, modality string, input_tokens bigint, "
    "cached_input_tokens bigint, output_tokens bigint, input_cost decimal(18,10), "
    "cached_input_cost decimal(18,10), output_cost decimal(18,10), total_cost decimal(18,10), "
    "currency string, long_context int, ingested_at timestamp"
)
EVALUATIONS = (
    "organization_id string, api_key_prefix string, trace_id string, root_trace_id string, "
    "evaluator string, metric string, score double, judge_model string, "
    "judge_input_tokens bigint, judge_output_tokens bigint, judge_calls bigint, details string, "
    "layer string, step_id string, run_score double, run_passed boolean, ingested_at timestamp"
)
SECURITY_SCANS = (
    "organization_id string, api_key_prefix string, trace_id string, root_trace_id string, "
    "mode string, prompt_redacted string, response_redacted string, "
    "pii_entities_prompt array<string>, pii_entities_response array<string>, "
    "injection_detected int, injection_patterns array<string>, "
    "jailbreak_detected int, jailbreak_patterns array<string>, "
    "skeleton_key_detected int, skeleton_key_patterns array<string>, "
    "secrets_detected int, secret_types array<string>, "
    "indirect_injection_detected int, indirect_injection_sources array<string>, "
    "rag_poisoning_detected int, rag_poisoning_sources array<string>, rag_poisoning_score double, "
    "tool_exfiltration_detected int, tool_exfiltration_types array<string>, "
    "tool_exfiltration_sources array<string>, tool_policy_violation_detected int, "
    "tool_policy_violations array<string>, cross_agent_injection_detected int, "
    "image_injection_detected int, image_injection_sources array<string>, "
    "semantic_attack_score double, security_risk_level string, security_risk_score double, "
    "should_block int, scan_latency double, extra string, retention_days int, ingested_at timestamp"
)
TRACE_TAGS = (
    "organization_id string, trace_id string, root_trace_id string, tag string, source string, "
    "created_by string, deleted int, updated_at timestamp"
)
REVIEW_FLAGS = (
    "organization_id string, trace_id string, root_trace_id string, status string, reason string, "
    "note string, flagged_by string, resolved_by string, updated_at timestamp"
)
PINNED_SPANS = (
    "organization_id string, root_trace_id string, trace_id string, event string, "
    "captured_at timestamp"
)
AUDIT_LOG = (
    "event_id string, organization_id string, actor string, event_type string, "
    "http_method string, http_path string, http_status int, ip_address string, latency_ms int, "
    "metadata string, row_hash string, created_at timestamp"
)
MODEL_PRICES = (
    "id bigint, provider string, model string, modality string, "
    "input_token_cost_per_million decimal(20,8), cached_input_token_cost_per_million decimal(20,8), "
    "output_token_cost_per_million decimal(20,8), long_context_consider_token_greater_than int, "
    "long_context_input_per_million decimal(20,8), "
    "long_context_cached_input_per_million decimal(20,8), "
    "long_context_output_per_million decimal(20,8)"
)
SCORING_RULES = (
    "organization_id string, rule_id string, name string, enabled boolean, metrics array<string>, "
    "custom_judges map<string,double>, sample_rate double, span_scope string, "
    "integrations array<string>, models array<string>, created_at timestamp"
)
GUARDRAIL_POLICIES = (
    "organization_id string, slug string, block_threshold string, block_categories array<string>, "
    "custom_allow_list array<string>, custom_deny_list array<string>, pii_ignore array<string>, "
    "allowed_tools array<string>, alert_on array<string>, scan_responses boolean"
)
ALERT_SETTINGS = (
    "organization_id string, webhook string, digest string, eval_enabled boolean, "
    "eval_metrics array<string>, eval_score_below double, eval_failure_rate_above double, "
    "security_enabled boolean, security_alert_on array<string>, "
    "security_categories array<string>, security_blocked_only boolean"
)
DATASET_EXAMPLES = (
    "organization_id string, dataset_id string, example_id string, input string, "
    "expected_output string, metadata map<string,string>, created_at timestamp"
)
DATASET_RUN_ITEMS = (
    "organization_id string, run_id string, example_id string, trace_id string, source string, "
    "output string, gen_error string, latency_ms bigint, input_tokens bigint, "
    "output_tokens bigint, cost_usd double, created_at timestamp"
)
