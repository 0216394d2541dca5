"""Plans hold what the engine promises: no join of all pairs, pruned scans, pushed filters."""

import re

import pytest

from larkspur.plans import catalog, cleaning, more, search

QUERIES = {k: v for m in (cleaning, search, catalog, more) for k, v in m.QUERIES.items()}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_join_of_all_pairs(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned_and_filters_pushed(spark, data):
    text = plan(catalog.QUERIES["flt03_window"](spark, data))
    assert "PushedFilters: [" in text and "GreaterThan(created_at" in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,created_at:timestamp[_a-z]*>", text)
    text = plan(catalog.QUERIES["agg_pricing_summary"](spark, data))
    assert "l_comment" not in text and "LessThanOrEqual(l_shipdate" in text and "partial_sum" in text
    text = plan(cleaning.QUERIES["p7_found"](spark, data))
    assert "total_yes" not in text and "sponsor_name" not in text
