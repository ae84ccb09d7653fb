
import json

from pyspark.sql import functions as F

from fleetspark.functions.predicate import compile_predicate
from fleetspark.operators.audit import (fill_placeholders, normalize_priority, start_order,
                                        unresolved_placeholders)
from fleetspark.operators.graph import (address_conflicts, expand_groups, host_table, match_patterns,
                                        node_link_ips, ordered_list)
from fleetspark.operators.leases import keep_per_match, lookup_last, nth_rows
from fleetspark.operators.lines import to_lines
from fleetspark.sources.kv import parse_kv_lines
from fleetspark.sources.listings import ALLOCATIONS_SCHEMA, read_listing
from fleetspark.sources.rdf import local_triples, read_rdf
from tests.conftest import rows

NS = ('xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:t="http://ex.org/topology#" '
      'xmlns:ip4="http://ex.org/ip4#" xmlns:layer="http://ex.org/layer#" xmlns:c="http://ex.org/compute#"')


def _desc(about, body):
    return f'  <rdf:Description rdf:about="http://ex.org/req1#{about}">{body}</rdf:Description>\n'


def _res(pred, target):
    return f'<{pred} rdf:resource="http://ex.org/req1#{target}"/>'


REQUEST = (f"<rdf:RDF {NS}>\n"
           + _desc("infra1", '<rdf:type rdf:resource="http://ex.org/topology#Node"/>' + _res("t:hasInterface", "VLAN0-infra1"))
           + _desc("infra0", '<rdf:type rdf:resource="http://ex.org/topology#Node"/>' + _res("t:hasInterface", "VLAN0-infra0"))
           + _desc("VLAN0", '<rdf:type rdf:resource="http://ex.org/topology#BroadcastConnection"/>'
                   + _res("t:hasInterface", "VLAN0-infra0") + _res("t:hasInterface", "VLAN0-infra1"))
           + _desc("VLAN0-infra0", _res("ip4:localIPAddress", "ip-0"))
           + _desc("VLAN0-infra1", _res("ip4:localIPAddress", "ip-1"))
           + _desc("ip-0", "<layer:label_ID>172.16.100.1</layer:label_ID>")
           + _desc("ip-1", "<layer:label_ID>172.16.100.5</layer:label_ID>")
           + _desc("Workers", '<rdf:type rdf:resource="http://ex.org/topology#NodeGroup"/>'
                   '<layer:numCE rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">3</layer:numCE>'
                   '<layer:baseIP>172.16.100.3</layer:baseIP>')
           + "</rdf:RDF>\n")


def test_topology_request_to_host_table(spark, tmp_path):
    (tmp_path / "req1.rdf").write_text(REQUEST)
    t = local_triples(read_rdf(spark, str(tmp_path / "req1.rdf")))
    ips = node_link_ips(t)
    assert rows(ips, "node", "link", "ip") == [("infra0", "VLAN0", "172.16.100.1"), ("infra1", "VLAN0", "172.16.100.5")]
    groups = match_patterns(t, [("?g", "type", "NodeGroup"), ("?g", "numCE", "?n"), ("?g", "baseIP", "?base")])
    members = expand_groups(groups, "g", "n", "base")
    hosts = host_table([("single", ips.select("request_id", "ip", F.col("node").alias("hostname"))),
                        ("group", members.select("request_id", "ip", F.col("member").alias("hostname")))])
    assert hosts.count() == 5
    lst = ordered_list(ips, ["request_id", "link"], F.concat("node", F.lit("=http://"), "ip", F.lit(":2380")),
                       F.col("node"))
    assert lst.first()["members"] == "infra0=http://172.16.100.1:2380,infra1=http://172.16.100.5:2380"
    owners = (ips.select("request_id", "ip_num", F.col("node").alias("owner"))
              .unionByName(members.select("request_id", "ip_num", F.col("g").alias("owner"))))
    # group .3-.5 overlaps infra1 at .5
    assert rows(address_conflicts(owners), "ip", "n_owners") == [("172.16.100.5", 2)]


def test_lease_query(spark, tmp_path):
    hosts = spark.createDataFrame(
        [("h1", "c01", "gpu_large", {"1": {"enabled": "True"}}, 1),
         ("h2", "c02", "gpu_large", {"1": {"enabled": "False"}}, 2),
         ("h3", "c03", "gpu_large", {"1": {"enabled": "True"}}, 3),
         ("h1", "c01-new", "gpu_large", {"1": {"enabled": "True"}}, 4)],
        "id string, hypervisor_hostname string, node_type string, "
        "network_adapters map<string,map<string,string>>, ord int")
    pred = '["and",["==","$network_adapters.1.enabled","True"],["==","$node_type","gpu_large"]]'
    eligible = hosts.where(compile_predicate(pred, hosts))
    (tmp_path / "alloc.json").write_text(json.dumps([
        {"resource_id": "h1", "reservations": [{"id": "r1", "lease_id": "L"}]},
        {"resource_id": "h3", "reservations": [{"id": "r2", "lease_id": "L"}]},
        {"resource_id": "h9", "reservations": [{"id": "r3", "lease_id": "L"}]},
        {"resource_id": "h2", "reservations": [{"id": "r4", "lease_id": "M"}]}]))
    allocs = read_listing(spark, str(tmp_path / "alloc.json"), ALLOCATIONS_SCHEMA)
    mine = keep_per_match(allocs, "reservations", lambda r: r["lease_id"] == "L")
    named = lookup_last(mine, eligible, "resource_id", "id", ["hypervisor_hostname"], "ord")
    picks = nth_rows(named.withColumn("lease", F.lit("L")), ["lease"], ["ord"], [0, 1, 2],
                     ["resource_id", "hypervisor_hostname"])
    assert rows(picks, "idx", "resource_id", "hypervisor_hostname") == [
        (0, "h1", "c01-new"), (1, "h3", "c03"), (2, "h9", None)]


def test_config_fill_and_schedule(spark):
    template = "listen <PORT>\nupstream <PEER_NAME> weight <WEIGHT>\nticket <SHARED_TICKET>"
    t = spark.createDataFrame([("edge.conf", template)], "file string, text string")
    filled = t.select("file", fill_placeholders("text", [("PORT", "7001"), ("PEER_NAME", "kiwi"),
                                                          ("WEIGHT", "12")]).alias("text"))
    assert rows(unresolved_placeholders(filled, "text", ["file"]), "placeholder") == [("SHARED_TICKET",)]
    daemons_file = spark.createDataFrame([("host1", "zebra=yes\nbgpd=yes\nospfd=no\nripd=no\n")], "file string, text string")
    cfg = parse_kv_lines(to_lines(daemons_file, "text", ["file"]))
    d = cfg.select(F.col("file").alias("host"), F.col("key").alias("daemon"), "line_no",
                   normalize_priority("key", "value").alias("prio"))
    assert rows(start_order(d, "host", "daemon", "line_no", "prio"), "start_seq", "daemon") == [(1, "zebra"), (2, "bgpd")]
