"""Queries on the search for words sort and exchange a row a document, not a row a posting."""

import pytest

import __spark_entry__

NAMES = "excluded_candidates query_signal golden_metrics candidate_union recall_bm25 adaptive_rerank_flag rrf_hybrid rrf_with_kinds".split()


@pytest.mark.parametrize("name", NAMES)
def test_rows_before_the_exchange(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(row" in plan and ", part," not in plan and " tf#" not in plan
