"""Explicit schemas of the artefacts; keys in them are dynamic, so none is inferred."""

from __future__ import annotations

LATENCIES = ("ttft", "tpot", "itl", "e2el")
STATISTICS = ("mean", "median", "std", "p50", "p90", "p99")
LATENCY_FIELDS = [f"{s}_{m}_ms" for m in LATENCIES for s in STATISTICS]

# Parts of an evaluation result file that are read. Values stay strings until
# they are cast one by one, since "N/A" appears in numeric places.
EVAL_RESULT = """
  results MAP<STRING, MAP<STRING, STRING>>,
  configs MAP<STRING, STRUCT<generation_kwargs: MAP<STRING, STRING>, num_fewshot: STRING>>,
  `n-samples` MAP<STRING, STRUCT<original: BIGINT, effective: BIGINT>>,
  config STRUCT<model_args: STRING, gen_kwargs: STRING>,
  date STRING,
  lm_eval_version STRING,
  task_hashes MAP<STRING, STRING>,
  model_name STRING,
  total_evaluation_time_seconds STRING
"""

BENCH_LEVEL = ", ".join(
    [
        "model_id STRING, num_prompts INT, max_concurrency INT, duration DOUBLE",
        "completed INT, failed INT, total_input_tokens BIGINT, total_output_tokens BIGINT",
        "request_throughput DOUBLE, request_goodput DOUBLE, output_throughput DOUBLE",
        "total_token_throughput DOUBLE, max_output_tokens_per_s DOUBLE",
        "max_concurrent_requests INT",
    ]
    + [f"{c} DOUBLE" for c in LATENCY_FIELDS]
)
BENCH_RENAMES = {
    "model_id": "model",
    "max_concurrency": "concurrency",
    "duration": "duration_s",
    "request_throughput": "req_s",
    "output_throughput": "out_tok_s",
    "total_token_throughput": "total_tok_s",
    "max_output_tokens_per_s": "max_out_tok_s",
    "max_concurrent_requests": "max_concurrent",
}

SWEEP_CSV = (
    "concurrency INT, num_prompts INT, duration_s DOUBLE, out_tok_s DOUBLE, total_tok_s DOUBLE, "
    "req_s DOUBLE, mean_ttft_ms DOUBLE, median_ttft_ms DOUBLE, p99_ttft_ms DOUBLE, "
    "mean_tpot_ms DOUBLE, mean_itl_ms DOUBLE"
)

# Labels of a sweep log's metric lines and the columns they fill.
SWEEP_LABELS = {
    "Successful requests": "completed",
    "Failed requests": "failed",
    "Benchmark duration (s)": "duration_s",
    "Request throughput (req/s)": "req_s",
    "Output token throughput (tok/s)": "out_tok_s",
    "Peak output token throughput (tok/s)": "max_out_tok_s",
    "Peak concurrent requests": "max_concurrent",
    "Total token throughput (tok/s)": "total_tok_s",
    "Mean TTFT (ms)": "mean_ttft_ms",
    "Median TTFT (ms)": "median_ttft_ms",
    "P99 TTFT (ms)": "p99_ttft_ms",
    "Mean TPOT (ms)": "mean_tpot_ms",
    "Median TPOT (ms)": "median_tpot_ms",
    "P99 TPOT (ms)": "p99_tpot_ms",
    "Mean ITL (ms)": "mean_itl_ms",
    "Median ITL (ms)": "median_itl_ms",
    "P99 ITL (ms)": "p99_itl_ms",
}

GRADER_REPORT = """
  total_instances BIGINT, submitted_instances BIGINT, completed_instances BIGINT,
  resolved_instances BIGINT, unresolved_instances BIGINT, empty_patch_instances BIGINT,
  error_instances BIGINT, completed_ids ARRAY<STRING>, incomplete_ids ARRAY<STRING>,
  empty_patch_ids ARRAY<STRING>, submitted_ids ARRAY<STRING>, resolved_ids ARRAY<STRING>,
  unresolved_ids ARRAY<STRING>, error_ids ARRAY<STRING>
"""

REPLAY = "doc BIGINT, fr STRING, ct BIGINT, pred STRING, gold STRING, correct BOOLEAN"

DIAGNOSIS = """
  run STRING, model STRING, counts MAP<STRING, BIGINT>,
  median_successful_command_execs_before_abort DOUBLE,
  examples ARRAY<STRUCT<instance: STRING, successful_command_execs: BIGINT, sample_error: STRING>>
"""
