"""Registered queries against DuckDB on the smallest tables; ``ORACLE_ALL=1`` runs every query."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SOME = (
    "usage_rollup call_site_build ancestors subtype_tree call_graph_both2 recursive_callers search_strings search_numbers "
    "fuzzy_rank member_listing entropy_windowed byte_diff class_diff method_diff mapping_compose mapping_invert mapping_write "
    "pattern_nested_none detector_scores encrypted_call_sites illegal_names enum_names opaque_predicates dead_code last60_stream "
    "status_changes_stream archive_scan decoded_code"
).split()
NAMES = list(entry.queries()) if os.environ.get("ORACLE_ALL") else SOME


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    ok, note, _ = compare(spark, duck(SF), name, SF)
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
