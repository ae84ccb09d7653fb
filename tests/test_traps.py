"""Queries whose rows must reach every branch of their operator at sf0.01."""

from pyspark.sql import functions as F

from fleetspark.plans import q_audit, q_leases, q_policy, q_scan, q_streaming

SF = "/root/testdata/sf0.01"


def test_prefix_winners_of_every_length_and_none(spark):
    got = {r[0] for r in q_policy.prefix_enrich(spark, SF).select("prefix_len").distinct().collect()}
    assert got == {16, 24, 29, 32, None}


def test_deadlines_met_and_missed(spark):
    got = {r[0]: r[1] for r in q_streaming.deadline(spark, SF).groupBy("status").agg(F.count("*")).collect()}
    assert got["done"] > 0 and got["timeout"] > 0


def _count(df, condition):
    return df.where(condition).count()


def test_every_verdict_and_rule(spark):
    ranks = {r[0] for r in q_policy.first_match_joined(spark, SF).select("rule_rank").distinct().collect()}
    verdicts = {r[0] for r in q_policy.first_match_joined(spark, SF).select("verdict").distinct().collect()}
    assert {1, 2, 3, 4, 5, 6, 7, 8, 9} - ranks <= {6} and verdicts == {"ACCEPT", "DROP", "REJECT"}


def test_lookups_and_configs_with_repeated_keys(spark):
    assert q_scan.kv_comments(spark, SF).count() > q_scan.kv_last_wins(spark, SF).count()
    assert spark.read.parquet(f"{SF}/orders.parquet").groupBy("o_custkey").count().where("count > 1").count() > 0
    assert _count(q_leases.sink_append(spark, SF), "n_listed = 2") > 0


def test_default_secrets_flagged_and_not(spark):
    out = q_audit.secret_audit(spark, SF)
    assert _count(out, "is_default") > 0 and _count(out, "not is_default") > 0


def test_second_last_of_one_row_groups(spark):
    sizes = spark.read.parquet(f"{SF}/orders.parquet").groupBy("o_custkey", "o_orderpriority").count()
    assert _count(sizes, "count = 1") > 0 and _count(sizes, "count > 1") > 0
