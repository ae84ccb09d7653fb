import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetspark.functions import ip, jsonx, predicate, text, timefx


def one(spark, col, value=None, schema="s string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col.alias("r")).first()["r"]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=2**32 - 1), min_size=50, max_size=50))
def test_ip_roundtrip_property(spark, nums):
    df = spark.createDataFrame([(n,) for n in nums], "n bigint")
    out = df.select("n", ip.ip_to_num(ip.num_to_ip("n")).alias("back")).collect()
    assert all(r["n"] == r["back"] for r in out)


def test_ip_parse_and_cidr(spark):
    df = spark.createDataFrame([("172.16.1.100",), ("999.1.1.1",), ("1.2.3",), ("10.0.0.1",)], "s string")
    out = [r["n"] for r in df.select(ip.ip_to_num("s").alias("n")).collect()]
    assert out == [2886729728 + 256 + 100, None, None, 167772161]
    assert ip.parse_cidr("152.54.0.0/16") == (2553675776, 16)
    assert ip.netmask_to_len("255.255.255.0") == 24
    df = spark.createDataFrame([(2553675776 + 5,), (2553675776 + 65536,)], "n bigint")
    assert [r[0] for r in df.select(ip.in_cidr(F.col("n"), "152.54.0.0/16")).collect()] == [True, False]


def test_replace_first_literal(spark):
    assert one(spark, text.replace_first(F.col("s"), "/b", ""), "a/b/a/b") == "a/a/b"
    assert one(spark, text.replace_first(F.col("s"), "$1", "x"), "a$1b$1") == "axb$1"
    assert one(spark, text.regex_replace_first(F.col("s"), "[0-9]", "#"), "ab12c3") == "ab#2c3"


def test_addressed_replace_first_only(spark):
    df = spark.createDataFrame([("broker.id=0 x0",), ("other=0",)], "s string")
    out = df.select(text.addressed("s", "broker\\.id=0", lambda c: text.regex_replace_first(c, "0", "1"))).collect()
    assert [r[0] for r in out] == ["broker.id=1 x0", "other=0"]


def test_capture_groups(spark):
    assert one(spark, text.capture_replace(F.col("s"), "^(APP_MODULE=.*)", r"#\1"), "APP_MODULE=x") == "#APP_MODULE=x"
    assert one(spark, text.capture_replace(F.col("s"), '(^.*&& INTERNET=)"UP"', r'\1"DOWN"', global_=True),
               'a && INTERNET="UP"') == 'a && INTERNET="DOWN"'
    with pytest.raises(ValueError):
        text.sed_to_java_replacement(r"\10")


def test_shell_expansions(spark):
    assert one(spark, text.strip_to_first_space(F.col("s")), "link link x") == "link x"
    assert one(spark, text.strip_to_first_space(F.col("s")), "x") == "x"
    assert one(spark, text.basename(F.col("s"), ".tar.gz"), "http://h/p/bro-2.5.tar.gz") == "bro-2.5"
    assert one(spark, text.basename(F.col("s"), ".tar.gz"), "/p/.tar.gz") == ".tar.gz"
    assert one(spark, text.basename(F.col("s")), "/a/b/") == "b"
    assert one(spark, text.strip_last_dotted(F.col("s")), "172.16.1.100") == "172.16.1"
    assert one(spark, text.uri_fragment(F.col("s")), "u#Hadoop+2.7.1+%28Centos7%29") == "Hadoop 2.7.1 (Centos7)"
    assert one(spark, text.split_get(F.col("s"), " ", 2), "a b") is None
    assert one(spark, text.awk_field(F.col("s"), 4), "| id | segmentation_id | 42 |") == "segmentation_id"


def test_double_encoded_json(spark):
    js = '{"reservations":"{\\"id\\":\\"r1\\"}"}'
    assert one(spark, jsonx.decode_inner(F.col("s"), "$.reservations", "id string")["id"], js) == "r1"


def test_lease_window_and_term(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 30, 59),)], "t timestamp_ntz")
    r = df.select(timefx.lease_start("t").alias("a"), timefx.lease_end("t", 7).alias("b"),
                  timefx.utc_stamp("t").alias("c"),
                  timefx.plus_decimal_days("t", F.lit("1.5")).alias("d")).first()
    assert r["a"] == dt.datetime(2024, 1, 1, 10, 31)
    assert r["b"] == dt.datetime(2024, 1, 8, 10, 30)
    assert r["c"] == "20240101-1030UTC"
    assert r["d"] == dt.datetime(2024, 1, 2, 22, 30, 59)  # + 36 h


def test_prefix_predicate(spark):
    df = spark.createDataFrame(
        [("h1", "gpu_large", {"1": {"enabled": "True"}}), ("h2", "gpu_large", {"1": {"enabled": "False"}})],
        "id string, node_type string, network_adapters map<string,map<string,string>>")
    pred = '["and",["==","$network_adapters.1.enabled","True"],["==","$node_type","gpu_large"]]'
    assert [r["id"] for r in df.where(predicate.compile_predicate(pred, df)).collect()] == ["h1"]
    with pytest.raises(predicate.PredicateError):
        predicate.compile_predicate('["~","$node_type","x"]', df)
    assert predicate.unresolved_names('["==","$PHYSICAL","x"]', df) == ["$PHYSICAL"]


def test_glob_first_true_band(spark):
    df = spark.createDataFrame([("Workers/0",), ("Workers-1",), ("MyWorkers",), ("NameNode",), ("Other",)], "r string")
    assert [r[0] for r in df.where(predicate.matches_glob("r", "Workers*")).collect()] == ["Workers/0", "Workers-1"]
    port = predicate.first_true([(F.col("r") == "NameNode", 50070), (predicate.matches_glob("r", "Workers*"), 0)])
    got = {r[0]: r[1] for r in df.select("r", port).collect()}
    assert got["NameNode"] == 50070 and got["Other"] is None and got["Workers/0"] == 0
    b = spark.createDataFrame([(79,), (80,), (90,), (None,)], "p int")
    assert [r[0] for r in b.select(predicate.threshold_band("p")).collect()] == ["ok", "warn", "critical", None]


def test_number_range_like_seq(spark):
    from fleetspark.functions.ranges import number_range
    r = spark.range(1).select(number_range(1, 3).alias("a"), number_range(10, 8, -1).alias("b"),
                              number_range(1, 0).alias("c"), number_range(10, 11, -1).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ([1, 2, 3], [10, 9, 8], [], [])
