"""What the physical plans must and must not hold."""

from __future__ import annotations

import re

import pytest

from jumptrail.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


NARROW = [
    "path_split", "env_form", "known_folder_form", "path_class", "candidates", "appid_candidates",
    "jumplist_names", "parse_ids", "crc64_values", "invariant_upper", "hexdump", "reverse_bytes",
    "bytes_from_hex", "lnks_xml_roundtrip",
]


@pytest.mark.parametrize("name", NARROW)
def test_no_shuffle_where_rows_stand_alone(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["guid_containment", "identify_apps", "candidate_matches", "index_join", "timeline_gaps"])
def test_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["recent_docs_top", "frequent_docs"])
def test_groups_are_cut_before_they_shuffle(spark, name):
    text = plan(spark, name)
    assert re.search(r"WindowGroupLimit .*Partial", text)


@pytest.mark.parametrize("name", ["recent_docs", "timeline_gaps", "sort_by_path", "sort_all_by_path"])
def test_windows_run_over_ranges(spark, name):
    lines = [line for line in plan(spark, name).splitlines() if "Window [" in line]
    over_rows = [line for line in lines if "row_number()" in line or "_near" in line]
    assert over_rows and all("windowspecdefinition(_range#" in line for line in over_rows)


def test_only_needed_columns_are_read(spark):
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan(spark, "activity_by_day"))
    assert schemas == ["struct<event_id:bigint,ts:timestamp_ntz>"]


def test_dump_is_one_generated_loop(spark):
    lines = plan(spark, "hexdump").splitlines()
    assert any(re.search(r"\*\(1\) Generate explode", line) for line in lines)


def test_hash_runs_once_per_candidate(spark):
    assert plan(spark, "appid_candidates").count("ArrowEvalPython") == 1
