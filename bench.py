"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS. Every query runs to completion into the
no-op sink, so that all columns of all rows are computed and none passes through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docfields.catalog.registry import all_queries  # noqa: E402
from docfields.functions.materialize import release  # noqa: E402
from docfields.session import build_session  # noqa: E402

HEADLINES = [
    "confidence_report", "template_analysis", "field_analysis_by_correction_rate", "low_confidence_fields",
    "confidence_distribution", "image_quality_impact", "training_stats", "training_export", "evaluation_overall",
    "evaluation_per_template", "rollup_entry", "standardize_schema", "standardize_ocr", "standardize_post",
    "standardize_bnr", "repair_confidence", "summarize_lines", "form_type_score", "extract_template_map",
    "extract_by_label_position", "extract_naive", "extract_patterns_validated", "group_rows", "classify_regions",
    "map_checkboxes", "match_visual_boxes", "merge_primary_fallback", "merge_multi_pass", "parse_flat_responses",
    "repair_truncated_json", "resolution_requests", "apply_verifications_fields", "classify_errors",
    "reuse_results_hits", "progress_changes", "stream_state_changes", "extract_forms",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("docfields-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="docfields-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINES
    queries = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in wanted:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        release(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
