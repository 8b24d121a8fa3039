"""Registered queries against their SQL on the smallest data. DOCFIELDS_ALL=1 runs every query."""

import os

import duckdb
import pytest

from docfields.catalog.registry import all_oracles, all_queries
from docfields.catalog.views import BASE_TABLES
from tools.compare import normal

SF = "/root/testdata/sf0.001"
CORE = ["confidence_report", "template_analysis", "field_analysis_by_correction_rate", "confidence_distribution", "evaluation_overall",
        "training_export", "standardize_schema", "standardize_ocr", "standardize_post", "standardize_bnr", "extract_template_map",
        "extract_naive", "match_visual_boxes", "merge_multi_pass", "parse_flat_responses", "apply_verifications_fields", "classify_errors",
        "line_items_read", "apply_verifications_entries", "reuse_results_hits", "merge_ai_into_deterministic", "parse_wrapped_responses",
        "resolution_requests", "rollup_entry", "classify_regions", "group_rows", "page_membership", "similar_labels", "stream_state_changes",
        "stream_latest_status", "stream_field_windows", "stream_late_rows", "read_tables", "read_detections", "export_training_data"]
NAMES = sorted(all_oracles()) if os.environ.get("DOCFIELDS_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    left = sorted(tuple(normal(v) for v in r) for r in df.select(*columns).collect())
    cursor = con.execute(all_oracles()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert left == sorted(tuple(normal(r[i]) for i in order) for r in cursor.fetchall())
