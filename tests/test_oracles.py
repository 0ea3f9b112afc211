"""Registered queries against their SQL; ``SPANQUARRY_ALL=1`` runs every one of them."""
import os

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.compare import compare

SF = "/root/testdata/sf0.001"
CORE = ["d10_agent_summary", "c01_trace_list", "c02_trace_list_by_cost", "d07_monitor_traffic", "d24_run_rollups",
        "d34_compare_runs", "d40_estimate_cost", "c19_select_rule", "e04_failure_rate", "k04_trajectory_steps",
        "i05_output_leaks", "a06_spans_to_events", "j01_route_events", "d37_composites", "c06_review_queue"]
NAMES = sorted(oracle_sql()) if os.environ.get("SPANQUARRY_ALL") else CORE


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    problems, n, *_ = compare(spark, SF, name, queries()[name], oracle_sql()[name])
    assert not problems and n > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_examples_of_every_turn(spark):
    name = "h20_event_to_example_all"
    problems, n, *_ = compare(spark, SF, name, queries()[name], oracle_sql()[name])
    texts = spark.read.parquet(f"{SF}/conversations.parquet")
    assert not problems and n == texts.count() and texts.filter("text rlike '[^ -~]'").count() > 0
