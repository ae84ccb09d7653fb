import pytest
from pyspark.sql import functions as F

from fleetspark.operators.graph import (address_conflicts, expand_groups, fanout_sizes, match_patterns,
                                        node_link_ips, ordered_list)
from fleetspark.sources.rdf import local_name, read_rdf
from tests.conftest import rows

TRIPLE_SCHEMA = "request_id string, subject string, predicate string, object string"

RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    xmlns:topology="http://example.org/topology#" xmlns:layer="http://example.org/layer#"
    xmlns:time="http://www.w3.org/2006/time#">
  <rdf:Description rdf:about="http://example.org/r1#VLAN0">
    <topology:hasInterface rdf:resource="http://example.org/r1#VLAN0-a"/>
    <topology:hasInterface rdf:resource="http://example.org/r1#VLAN0-b"/>
    <layer:bandwidth rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">2500</layer:bandwidth>
    <topology:hasGUID>g &amp; h</topology:hasGUID>
  </rdf:Description>
  <rdf:Description rdf:about="http://example.org/r1#Kiwi+3.1+%28Lab%29">
    <time:days rdf:datatype="http://www.w3.org/2001/XMLSchema#decimal">1.5</time:days>
  </rdf:Description>
</rdf:RDF>
"""


def topo(spark):
    t = [
        ("r", "n1", "type", "Node"), ("r", "n2", "type", "Node"),
        ("r", "L0", "type", "BroadcastConnection"), ("r", "L1", "type", "BroadcastConnection"),
        ("r", "n1", "hasInterface", "L0-n1"), ("r", "L0", "hasInterface", "L0-n1"),
        ("r", "n2", "hasInterface", "L0-n2"), ("r", "L0", "hasInterface", "L0-n2"),
        ("r", "n1", "hasInterface", "L1-n1"), ("r", "L1", "hasInterface", "L1-n1"),
        ("r", "L0-n1", "localIPAddress", "a1"), ("r", "a1", "label_ID", "172.16.0.1"),
        ("r", "L0-n2", "localIPAddress", "a2"), ("r", "a2", "label_ID", "172.16.0.2"),
        ("r", "L1-n1", "localIPAddress", "a3"), ("r", "a3", "label_ID", "10.0.0.1"),
    ]
    return spark.createDataFrame(t, TRIPLE_SCHEMA)


def test_node_ip_one_address_per_node_and_link(spark):
    out = node_link_ips(topo(spark))
    assert rows(out, "node", "link", "ip") == [("n1", "L0", "172.16.0.1"), ("n1", "L1", "10.0.0.1"),
                                                ("n2", "L0", "172.16.0.2")]


def test_disconnected_pattern_is_rejected(spark):
    with pytest.raises(ValueError):
        match_patterns(topo(spark), [("?a", "type", "Node"), ("?b", "type", "BroadcastConnection")])


def test_optional_pattern_is_left_join(spark):
    t = topo(spark).unionByName(spark.createDataFrame([("r", "n1", "inDomain", "d1")], TRIPLE_SCHEMA))
    out = match_patterns(t, [("?n", "type", "Node")], optional=[("?n", "inDomain", "?dom")])
    assert rows(out, "n", "dom") == [("n1", "d1"), ("n2", None)]


def test_group_expand_and_overlap(spark):
    g = spark.createDataFrame([("r", "grp", 3, "192.168.1.2")], "request_id string, g string, n int, base string")
    ex = expand_groups(g, "g", "n", "base")
    assert rows(ex, "member_idx", "ip") == [(0, "192.168.1.2"), (1, "192.168.1.3"), (2, "192.168.1.4")]
    single = spark.createDataFrame([("r", 3232235780, "solo")], "request_id string, ip_num bigint, owner string")
    owners = ex.select("request_id", "ip_num", F.col("g").alias("owner")).unionByName(single)
    out = address_conflicts(owners)
    assert rows(out, "ip", "n_owners") == [("192.168.1.4", 2)]
    wide = expand_groups(g, "g", "n", "base", stride=2)
    assert rows(wide, "ip") == [("192.168.1.2",), ("192.168.1.4",), ("192.168.1.6",)]
    empty = spark.createDataFrame([("r", "none", 0, "10.0.0.1")], "request_id string, g string, n int, base string")
    assert expand_groups(empty, "g", "n", "base").count() == 0


def test_full_mesh_and_link_pair_counts(spark):
    m = spark.createDataFrame([("c", "h1"), ("c", "h2"), ("c", "h3")], "cluster string, host string")
    assert rows(fanout_sizes(m, ["cluster"], "host", include_self=True), "n_hosts", "n_pairs") == [(3, 9)]
    assert rows(fanout_sizes(m, ["cluster"], "host", include_self=False), "n_hosts", "n_pairs") == [(3, 3)]


def test_member_list_is_ordered(spark):
    df = spark.createDataFrame([("infra1", "10.0.0.2"), ("infra0", "10.0.0.1")], "name string, ip string")
    out = ordered_list(df.withColumn("k", F.lit(1)), ["k"], F.concat("name", F.lit("=http://"), "ip", F.lit(":2380")),
                       F.col("name"))
    assert out.first()["members"] == "infra0=http://10.0.0.1:2380,infra1=http://10.0.0.2:2380"


def test_rdf_scan(spark, tmp_path):
    (tmp_path / "req1.rdf").write_text(RDF)
    t = read_rdf(spark, str(tmp_path / "*.rdf"))
    got = rows(t, "request_id", "predicate", "object", "object_kind")
    assert ("req1", "topology:hasInterface", "http://example.org/r1#VLAN0-a", "uri") in got
    assert ("req1", "topology:hasInterface", "http://example.org/r1#VLAN0-b", "uri") in got
    assert ("req1", "topology:hasGUID", "g & h", "literal") in got
    assert ("req1", "time:days", "1.5", "literal") in got
    dt = t.where("predicate = 'layer:bandwidth'").first()["datatype"]
    assert dt.endswith("#integer")
    names = {r[0] for r in t.select(local_name("subject")).collect()}
    assert "Kiwi 3.1 (Lab)" in names


def test_filtering_patterns_and_order_do_not_change_solutions(spark):
    t = spark.createDataFrame([("r", "n1", "type", "Node"), ("r", "n1", "hasInterface", "i1"), ("r", "n2", "hasInterface", "i2"),
                               ("r", "n1", "hasInterface", "i3"), ("q", "n2", "type", "Node")],
                              "request_id string, subject string, predicate string, object string")
    pats = [("?n", "type", "Node"), ("?n", "hasInterface", "?i")]
    for order in (pats, pats[::-1]):
        assert rows(match_patterns(t, order), "request_id", "n", "i") == [("r", "n1", "i1"), ("r", "n1", "i3")]
