"""Explicit schemas of every table that is read from files."""

from __future__ import annotations

QUESTIONS = "id string, year int, `group` string, points double, problem_number string, problem_statement string, answer string, multimodal boolean, language string, sol_A string, sol_B string, sol_C string, sol_D string, sol_E string"
RESULTS = (
    "id string, year string, `group` string, problem_number string, language string, multimodal boolean, points double, answer string, predicted string, is_correct boolean, points_earned double, "
    "reasoning_mode string, latency_ms double, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, reasoning_tokens bigint, explicit_reasoning_tokens bigint, cached_prompt_tokens bigint, "
    "audio_prompt_tokens bigint, cost_usd double, rationale string, raw_text_response string, generation_id string, error string, warnings array<string>"
)
METRICS = "answered_count bigint, failed_count bigint, skipped_count bigint, accuracy double, points_weighted_accuracy double, total_points_earned double, mean_latency_ms double, mean_completion_tokens double, warning_row_count bigint"
CONFIG = "model_id string, dataset_path string, reasoning_mode string, seed bigint, `limit` bigint"
FAILURES = "id string, error string, status_code int, attempts int"
RANGE = "struct<min:double,max:double,inclusive:string>"
BASELINE = (
    "schema_version string, year int, locale string, grades array<struct<id:string,label:string,members:array<int>,max_points:double>>, "
    f"bins array<struct<id:string,label_pdf:string,range_default:{RANGE},ranges_by_grade:map<string,{RANGE}>>>, "
    "counts_by_grade map<string,array<bigint>>, totals_by_grade map<string,bigint>, avg_score_by_grade map<string,double>, ui_groups map<string,array<int>>"
)
MODELS = "models array<struct<id:string,label:string,supports_vision:boolean,rate_limit:struct<min_interval_seconds:double,requests_per_second:double,requests_per_minute:double>>>"
EVENTS = "seq bigint, ts timestamp, type string, model string, prompt_tokens bigint, completion_tokens bigint, given_tokens bigint, cost_usd double, latency_ms double, attempts int, warnings array<string>"
