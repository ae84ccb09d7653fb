"""Physical-plan properties the scale design relies on (read from ``explain``)."""

import contextlib
import io
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def q(spark, name):
    return entry.queries()[name](spark, SF)


def test_predicate_reaches_scan_and_topk_is_limited_before_shuffle(spark):
    p = plan(q(spark, "lease_pick"))
    assert "EqualTo(o_orderstatus,O)" in p and "EqualTo(o_orderpriority,1-URGENT)" in p
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "BroadcastHashJoin" in p  # the size-checked customer lookup


def test_inline_rules_need_no_join(spark):
    p = plan(q(spark, "first_match_policy"))
    assert "Join" not in p and "CASE WHEN" in p


def test_prefix_join_is_broadcast_only(spark):
    p = plan(q(spark, "prefix_enrich"))
    assert p.count("BroadcastHashJoin") >= 4  # one per prefix length present
    assert "SortMergeJoin" not in p and "NestedLoop" not in p


def test_pattern_filters_prune_triple_branches(spark):
    p = plan(q(spark, "node_ip"))
    assert "customer.parquet" in p
    assert "supplier.parquet" not in p and "nation.parquet" not in p


def test_drift_is_one_aggregation(spark):
    p = plan(q(spark, "line_drift"))
    assert "Except" not in p
    assert p.count("Arguments: hashpartitioning(") == 1


def test_second_last_uses_group_limit(spark):
    p = plan(q(spark, "second_last"))
    assert "WindowGroupLimit" in p


def test_merges_are_aggregations_not_joins(spark):
    assert "Join" not in plan(q(spark, "merge_newer"))
    assert "Join" not in plan(q(spark, "merge_force"))


def test_column_pruning_on_wide_scan(spark):
    p = plan(q(spark, "threshold_band"))
    read = [ln for ln in p.splitlines() if "ReadSchema" in ln][0]
    assert "l_tax" not in read and "l_shipdate" not in read
