"""Many at once: predicates as a table (P4), overlapping ranges (J8), elementary intervals (J7) and rule bit
vectors (P11) over ``orders``, ``customer``, ``supplier`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions.ip import ip_to_num, num_to_ip
from fleetspark.operators.graph import NODE_IP_PATTERNS, match_patterns, node_link_ips
from fleetspark.operators.intervals import deepest_prefix
from fleetspark.operators.policy import rank_rules
from fleetspark.operators.predicate_table import match_predicates, split_predicates
from fleetspark.operators.rule_bits import first_match_bits
from fleetspark.operators.sizing import write_once
from fleetspark.operators.sweep import range_overlaps
from fleetspark.plans.q_policy import (_FIRST_MATCH_SQL, _PREFIX_Q, FLOWS_SQL, policies_frame, prefix_points, prefixes_frame,
                                       rules_frame)
from fleetspark.plans.q_topology import _DOT, _MEMBERS, _SINGLES, GROUP_PATTERNS, triples_for
from fleetspark.plans.tables import BASE_ADDRESS, PORTS, flows, table

# The segments of the driver's customers.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
RACKS = 50


def _hosts(spark, d):
    """A host per customer with nested placement and a list of tags."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("host"), F.col("c_mktsegment").alias("segment"),
        F.struct(F.col("c_nationkey").alias("nation"), F.pmod("c_custkey", F.lit(RACKS)).alias("rack")).alias("placement"),
        F.array(F.lower("c_mktsegment"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("paid")).alias("tags"),
        F.pmod(F.col("c_custkey") * 7, F.lit(25)).alias("owner_nation"))


def _leases(spark, d):
    """A predicate per order, of eight kinds by order key: nested ``and``, turned operands, two paths, a list element,
    an unknown operator, literals that differ, a path that no host has."""
    o = table(spark, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    segment = F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (F.pmod(key, F.lit(5)) + 1).cast("int"))
    nation, rack, host = F.pmod(cust, F.lit(25)).cast("string"), F.pmod(key, F.lit(RACKS)).cast("string"), cust.cast("string")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    three = text('["and", ["==", "$segment", "', segment, '"], ["and", ["=", "$placement.nation", "', nation, '"], ["==", "',
                 rack, '", "$placement.rack"]]]')
    kinds = [three, text('["==","$host",', host, "]"),
             text('["and",["==","$placement.nation","$owner_nation"],["==","$placement.rack","', rack, '"],["==","$segment","',
                  segment, '"]]'),
             text('["and",["==","$tags.1","debt"],["==","$placement.nation","', nation, '"],["==","$placement.rack",', rack, "]]"),
             text('["or",["==","$host","', host, '"]]'), text('["and",["==","x","y"],["==","$host","', host, '"]]'),
             text('["and",["==","$nowhere","1"],["==","$host","', host, '"]]'), three]
    kind = F.pmod(key, F.lit(8))
    predicate = F.when(kind == 0, kinds[0])
    for i, k in enumerate(kinds[1:], 1):
        predicate = predicate.when(kind == i, k)
    return o.select(key.alias("lease"), predicate.alias("predicate"))


def predicate_table(spark, d):
    """Every order's own predicate against all hosts, matches only (P4 as a table)."""
    matches, _ = match_predicates(_leases(spark, d), "predicate", _hosts(spark, d), "host")
    return matches.select("lease", "host")


def predicate_rejects(spark, d):
    """Orders whose predicate uses an operator that is none (P4 as a table)."""
    _, rejects = split_predicates(_leases(spark, d), "predicate")
    return rejects.select("lease", "predicate")


def range_conflicts(spark, d):
    """Stretches of addresses that two or more owners of a request claim, no address listed."""
    t = triples_for(spark, d, NODE_IP_PATTERNS + GROUP_PATTERNS)
    singles = node_link_ips(t).select("request_id", F.col("ip_num").alias("lo"), F.col("ip_num").alias("hi"),
                                      F.col("node").alias("owner"))
    base = F.col("base_num")
    groups = match_patterns(t, GROUP_PATTERNS).withColumn("base_num", ip_to_num("base")).select(
        "request_id", base.alias("lo"), (base + F.col("n").cast("bigint") - 1).alias("hi"), F.col("g").alias("owner"))
    # written with numbers: a filter on the ranges would be pushed below the patterns' joins and read every address again
    claims = write_once(singles.unionByName(groups), "claims")
    out = range_overlaps(claims, ["request_id"], "lo", "hi", "owner")
    return out.select("request_id", num_to_ip("first").alias("first_ip"), num_to_ip("last").alias("last_ip"), "n_owners")


def claim_overlaps(spark, d):
    """Wide claims, one an order: a third of them in one request, some with swapped ends."""
    o = table(spark, d, "orders")
    request = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("o_custkey") % 25)
    lo = F.lit(BASE_ADDRESS) + (F.col("o_orderkey") * 37) % 100_000
    size = F.when(F.col("o_orderkey") % 11 == 0, F.lit(-1).cast("bigint")).otherwise(F.floor("o_totalprice") % 3000)
    claims = o.select(request.alias("request"), lo.alias("lo"), (lo + size).alias("hi"), (F.col("o_custkey") % 400).alias("owner"))
    return range_overlaps(claims, ["request"], "lo", "hi", "owner")


def prefix_intervals(spark, d):
    """J7 by elementary intervals and one as-of lookup; the rows of ``prefix_enrich``."""
    out = deepest_prefix(prefix_points(spark, d), "src", prefixes_frame(spark, d))
    return out.select("event_id", num_to_ip("src").alias("src_ip"), "attr", "prefix_len")


def first_match_by_bits(spark, d):
    """P11 by rule bit vectors; the rows of ``first_match_policy``."""
    return first_match_bits(flows(spark, d), rules_frame(spark), policies_frame(spark)).select("flow_id", "verdict", "rule_rank")


def _fleet_rules(spark, d):
    """Five rules a supplier, one per port: an address range, and by key an interface, states, flags or no port."""
    s, key = table(spark, d, "supplier"), F.col("s_suppkey")
    ports = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("port")) for i, p in enumerate(PORTS)])
    r = s.select("s_suppkey", F.explode(ports).alias("p"))
    lo = F.lit(BASE_ADDRESS) + (key * 13) % 2000
    return rank_rules(r.select(
        F.lit("INPUT").alias("chain"), (key * 5 + F.col("p.i")).cast("int").alias("seq"), F.lit("A").alias("op"),
        F.when(key % 4 == 1, "eth0").alias("iface"), F.lit("tcp").alias("proto"), lo.alias("dst_lo"),
        (lo + key % 40 - 1).alias("dst_hi"), F.when((key + F.col("p.i")) % 7 != 0, F.col("p.port")).alias("dport"),
        F.when(key % 5 == 0, F.array(F.lit("NEW"), F.lit("RELATED"))).alias("state"),
        F.when(key % 6 == 0, "ACK").alias("tcp_flags"), F.when(key % 9 == 0, False).alias("syn"),
        F.when(key % 3 == 0, "DROP").otherwise("ACCEPT").alias("verdict")))


def fleet_rules(spark, d):
    """A rule list that grows with the fleet, by rule bit vectors."""
    return first_match_bits(flows(spark, d), _fleet_rules(spark, d), policies_frame(spark)).select(
        "flow_id", "verdict", "rule_rank")


QUERIES = {f.__name__: f for f in (predicate_table, predicate_rejects, range_conflicts, claim_overlaps, prefix_intervals,
                                   first_match_by_bits, fleet_rules)}

_LEASES_SQL = """h AS (
  SELECT c_custkey AS host, c_mktsegment AS segment, c_nationkey AS nation, c_custkey % 50 AS rack, c_acctbal < 0 AS debt,
         c_custkey * 7 % 25 AS owner_nation FROM customer),
l AS (
  SELECT o_orderkey AS lease, o_custkey AS cust, o_orderkey % 8 AS kind, o_custkey % 25 AS nation, o_orderkey % 50 AS rack,
         ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][o_orderkey % 5 + 1] AS segment FROM orders)"""

ORACLE = {
    "predicate_table": f"""WITH {_LEASES_SQL}
SELECT lease, host FROM l JOIN h ON h.segment = l.segment AND h.nation = l.nation AND h.rack = l.rack WHERE kind IN (0, 7)
UNION ALL SELECT lease, host FROM l JOIN h ON host = cust WHERE kind = 1
UNION ALL SELECT lease, host FROM l JOIN h ON h.segment = l.segment AND h.rack = l.rack AND h.nation = owner_nation WHERE kind = 2
UNION ALL SELECT lease, host FROM l JOIN h ON h.nation = l.nation AND h.rack = l.rack AND debt WHERE kind = 3""",
    "predicate_rejects": f"""WITH {_LEASES_SQL}
SELECT lease, '["or",["==","$host","' || CAST(cust AS VARCHAR) || '"]]' AS predicate FROM l WHERE kind = 4""",
    "range_conflicts": f"""WITH {_SINGLES}, {_MEMBERS},
o AS (SELECT DISTINCT request_id, ip_num, owner FROM (SELECT request_id, ip_num, node AS owner FROM singles
                                         UNION ALL SELECT request_id, ip_num, g FROM members)),
n AS (SELECT request_id, ip_num, count(*) AS n_owners FROM o GROUP BY request_id, ip_num HAVING count(*) >= 2),
i AS (SELECT *, ip_num - row_number() OVER (PARTITION BY request_id, n_owners ORDER BY ip_num) AS island FROM n),
f AS (SELECT request_id, n_owners, min(ip_num) AS a, max(ip_num) AS b FROM i GROUP BY request_id, n_owners, island)
SELECT request_id, {_DOT.format(x='a')} AS first_ip, {_DOT.format(x='b')} AS last_ip, n_owners FROM f""",
    "claim_overlaps": """
WITH c AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 25 END AS request, o_custkey % 400 AS owner,
                  2886729728 + o_orderkey * 37 % 100000 AS lo,
                  CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE CAST(floor(o_totalprice) AS BIGINT) % 3000 END AS size FROM orders),
e AS (SELECT request, owner, lo AS pos, 1 AS delta FROM c WHERE size >= 0
      UNION ALL SELECT request, owner, lo + size + 1, -1 FROM c WHERE size >= 0),
s AS (SELECT request, owner, pos, sum(delta) AS delta FROM e GROUP BY ALL HAVING sum(delta) <> 0),
w AS (SELECT *, sum(delta) OVER (PARTITION BY request, owner ORDER BY pos) AS depth FROM s),
x AS (SELECT request, pos, sum(CASE WHEN depth > 0 THEN 1 ELSE -1 END) AS delta FROM w
      WHERE depth = 0 OR depth = delta GROUP BY request, pos HAVING sum(CASE WHEN depth > 0 THEN 1 ELSE -1 END) <> 0),
y AS (SELECT request, pos, lead(pos) OVER (PARTITION BY request ORDER BY pos) AS next_pos,
             sum(delta) OVER (PARTITION BY request ORDER BY pos) AS n_owners FROM x)
SELECT request, pos AS first, next_pos - 1 AS last, CAST(n_owners AS BIGINT) AS n_owners FROM y WHERE n_owners >= 2""",
    "prefix_intervals": _PREFIX_Q,
    "first_match_by_bits": _FIRST_MATCH_SQL,
    "fleet_rules": f"""
WITH {FLOWS_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY seq) AS rnk FROM (
        SELECT s_suppkey * 5 + i AS seq, CASE WHEN s_suppkey % 4 = 1 THEN 'eth0' END AS iface,
               2886729728 + s_suppkey * 13 % 2000 AS lo, 2886729728 + s_suppkey * 13 % 2000 + s_suppkey % 40 - 1 AS hi,
               CASE WHEN (s_suppkey + i) % 7 <> 0 THEN [22, 80, 443, 8080, 50070][i + 1] END AS dport,
               s_suppkey % 5 = 0 AS only_new, CASE WHEN s_suppkey % 6 = 0 THEN 'ACK' END AS tcp_flags,
               s_suppkey % 9 = 0 AS not_syn, CASE WHEN s_suppkey % 3 = 0 THEN 'DROP' ELSE 'ACCEPT' END AS verdict
        FROM supplier, range(5) t(i))),
m AS (SELECT f.flow_id, arg_min(r.verdict, r.rnk) AS v, min(r.rnk) AS k
      FROM flows2 f JOIN r ON f.dst BETWEEN r.lo AND r.hi AND (r.iface IS NULL OR r.iface = f.iface)
       AND (r.dport IS NULL OR r.dport = f.dport) AND (NOT only_new OR f.state = 'NEW')
       AND (r.tcp_flags IS NULL OR r.tcp_flags = f.tcp_flags) AND (NOT not_syn OR NOT f.syn)
      GROUP BY f.flow_id)
SELECT f.flow_id, coalesce(m.v, 'DROP') AS verdict, CAST(m.k AS INTEGER) AS rule_rank
FROM flows2 f LEFT JOIN m ON m.flow_id = f.flow_id""",
}
