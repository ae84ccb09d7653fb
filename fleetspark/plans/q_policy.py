"""Build-plan step 3: policy queries (P5, P6, P9-P12, J7) over ``events`` / ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.functions.ip import in_cidr, ip_to_num, num_to_ip, parse_cidr, prefix_mask, netmask_to_len
from fleetspark.functions.predicate import first_true, matches_glob, threshold_band
from fleetspark.operators.policy import first_match, most_specific_prefix, rank_rules, range_membership
from fleetspark.plans.tables import BASE_ADDRESS, flows, table

# The INPUT chain of the NameNode host in command order
# (seq, op, iface, proto, destination, dport, state, tcp flags, syn, verdict),
# and the chain policies.
NAMENODE_COMMANDS = [
    (1, "A", "lo", None, None, None, None, None, None, "ACCEPT"),
    (2, "A", None, None, "127.0.0.0/8", None, None, None, None, "REJECT"),
    (3, "A", None, "tcp", None, None, ["NEW"], None, False, "DROP"),
    (4, "A", None, "tcp", None, None, None, "NONE", None, "DROP"),
    (5, "A", None, "tcp", None, None, None, "ALL", None, "DROP"),
    (6, "A", None, None, None, None, ["ESTABLISHED", "RELATED"], None, None, "ACCEPT"),
    (7, "A", None, "tcp", None, 22, None, None, None, "ACCEPT"),
    (8, "I", "eth1", "tcp", None, None, None, None, None, "ACCEPT"),
    (9, "A", None, "tcp", None, 50070, None, None, None, "ACCEPT"),
]
POLICIES = [("INPUT", "DROP"), ("OUTPUT", "ACCEPT"), ("FORWARD", "DROP")]
# The allow rule's ports; our campus block; the subnet mask.
ALLOW_PORTS = [443, 22, 7734]
ALLOW_CIDR = "172.16.0.0/25"
SUBNET_MASK = "255.255.255.0"

RULE_SCHEMA = T.StructType([
    T.StructField("chain", T.StringType()), T.StructField("seq", T.IntegerType()),
    T.StructField("op", T.StringType()), T.StructField("iface", T.StringType()),
    T.StructField("proto", T.StringType()), T.StructField("dst_lo", T.LongType()),
    T.StructField("dst_hi", T.LongType()), T.StructField("dport", T.IntegerType()),
    T.StructField("state", T.ArrayType(T.StringType())), T.StructField("tcp_flags", T.StringType()),
    T.StructField("syn", T.BooleanType()), T.StructField("verdict", T.StringType()),
])


def rules_frame(spark, commands=NAMENODE_COMMANDS, chain="INPUT"):
    rows = []
    for seq, op, iface, proto, dst, dport, state, flags, syn, verdict in commands:
        lo = hi = None
        if dst:
            net, plen = parse_cidr(dst)
            lo, hi = net, net + (1 << (32 - plen)) - 1
        rows.append((chain, seq, op, iface, proto, lo, hi, dport, state, flags, syn, verdict))
    return rank_rules(spark.createDataFrame(rows, RULE_SCHEMA))


def policies_frame(spark):
    return spark.createDataFrame(POLICIES, "chain string, verdict string")


def first_match_policy(spark, d):
    """First matching rule per connection record, chain default otherwise (P11, inline CASE plan)."""
    out = first_match(flows(spark, d), rules_frame(spark), policies_frame(spark), strategy="inline")
    return out.select("flow_id", "verdict", "rule_rank")


def first_match_joined(spark, d):
    """P11 through the keyed joins (one equality join per shape of rule); same answer as the inline plan."""
    out = first_match(flows(spark, d), rules_frame(spark), policies_frame(spark), strategy="join")
    return out.select("flow_id", "verdict", "rule_rank")


def cidr_allow(spark, d):
    """``allow proto tcp from CIDR to any port 443,22,7734`` and same-/24 test."""
    f = flows(spark, d)
    mlen = netmask_to_len(SUBNET_MASK)
    same = F.col("src").bitwiseAND(prefix_mask(mlen)) == F.col("dst").bitwiseAND(prefix_mask(mlen))
    return f.select("flow_id", num_to_ip("src").alias("src_ip"), "dport",
                    (in_cidr(F.col("src"), ALLOW_CIDR) & F.col("dport").isin(ALLOW_PORTS)).alias("allowed"),
                    same.alias("same_subnet"))


# Address pools (name, first, last), both ends included.
POOLS = [("pool-a", "172.16.0.51", "172.16.0.90"),
         ("pool-b", "172.16.0.91", "172.16.0.120"),
         ("pool-c", "172.16.0.100", "172.16.3.255")]


def pool_range(spark, d):
    """Every pool containing each source address, null when none (P10)."""
    pools = spark.createDataFrame(POOLS, "network string, first string, last string").select(
        "network", ip_to_num("first").alias("lo"), ip_to_num("last").alias("hi"))
    f = flows(spark, d).select("flow_id", "src")
    out = range_membership(f, "src", pools)
    return out.select("flow_id", num_to_ip("src").alias("src_ip"), "network")


def prefixes_frame(spark, d):
    """Prefix table: a campus /16, a /24 per nation, a /29 per supplier, a /32 per customer (every third address)."""
    base = F.lit(BASE_ADDRESS)
    campus = spark.createDataFrame([(BASE_ADDRESS, 16, "campus")], "net bigint, prefix_len int, attr string")
    nat = table(spark, d, "nation").select((base + F.col("n_nationkey") * 256).alias("net"),
                                           F.lit(24).alias("prefix_len"), F.col("n_name").alias("attr"))
    sup = table(spark, d, "supplier").select((base + F.col("s_suppkey") * 8).alias("net"),
                                             F.lit(29).alias("prefix_len"), F.col("s_name").alias("attr"))
    cus = table(spark, d, "customer").select(
        (base + F.col("c_custkey") * 3).alias("net"), F.lit(32).alias("prefix_len"), F.col("c_name").alias("attr"))
    return campus.unionByName(nat).unionByName(sup).unionByName(cus)


def prefix_points(spark, d):
    """An address per event, spread over the campus and as much again outside it."""
    address = F.lit(BASE_ADDRESS) + F.pmod(F.col("user_id") * 1009, F.lit(131072))
    return table(spark, d, "events").select("event_id", address.alias("src"))


def prefix_enrich(spark, d):
    """Most specific containing network per event source address."""
    out = most_specific_prefix(prefix_points(spark, d), "src", prefixes_frame(spark, d))
    return out.select("event_id", num_to_ip("src").alias("src_ip"), "attr", "prefix_len")


def prefix_enrich_shuffled(spark, d):
    """J7 without explicit broadcasts (prefix tables of any size): one keyed join per length."""
    out = most_specific_prefix(prefix_points(spark, d), "src", prefixes_frame(spark, d), max_broadcast_rows=0)
    return out.select("event_id", num_to_ip("src").alias("src_ip"), "attr", "prefix_len")


def threshold_bands(spark, d):
    """ok / warn >= 80 / critical >= 90 on a percent read off each line item."""
    li = table(spark, d, "lineitem")
    pct = F.floor(F.col("l_quantity") * 2).cast("int")
    return li.select("l_orderkey", "l_linenumber", pct.alias("pct"), threshold_band(pct, 80, 90).alias("band"))


def role_map(spark, d):
    """Role name glob (P5) and if/elif role -> port without default."""
    c = table(spark, d, "customer")
    role = (F.when(F.col("c_mktsegment") == "BUILDING", F.lit("NameNode"))
            .when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("ResourceManager"))
            .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("Workers/"), F.col("c_custkey").cast("string")))
            .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("MonitorMaster"))
            .otherwise(F.concat(F.lit("MyWorkers"), F.col("c_custkey").cast("string"))))
    c = c.select("c_custkey", role.alias("role"))
    port = first_true([
        (F.col("role") == "NameNode", 50070),
        (F.col("role") == "ResourceManager", 8088),
        (matches_glob("role", "Workers*"), F.lit(None).cast("int")),
        (F.col("role") == "MonitorMaster", 9995),
    ])
    return c.select("c_custkey", "role", port.cast("int").alias("port"),
                    matches_glob("role", "Workers*").alias("is_worker"))


QUERIES = {
    "first_match_policy": first_match_policy,
    "first_match_joined": first_match_joined,
    "cidr_allow": cidr_allow,
    "pool_range": pool_range,
    "prefix_enrich": prefix_enrich,
    "prefix_enrich_shuffled": prefix_enrich_shuffled,
    "threshold_band": threshold_bands,
    "role_map": role_map,
}

FLOWS_SQL = """flows AS (
  SELECT event_id AS flow_id, ts, 'INPUT' AS chain,
         CASE WHEN event_type = 'signup' THEN 'eth1' WHEN event_type = 'error' AND value < 25 THEN 'lo' ELSE 'eth0' END AS iface,
         'tcp' AS proto, 2886729728 + user_id AS src,
         CASE WHEN event_type = 'error' THEN 2130706433 ELSE 2886729728 + user_id END AS dst,
         [22, 80, 443, 8080, 50070][event_id % 5 + 1] AS dport,
         CASE WHEN event_type = 'purchase' THEN 'ESTABLISHED' ELSE 'NEW' END AS state,
         CASE WHEN value < 1 THEN 'NONE' WHEN value > 49 THEN 'ALL' WHEN value > 25 THEN 'SYN' ELSE 'ACK' END AS tcp_flags
  FROM events),
flows2 AS (SELECT *, tcp_flags = 'SYN' AS syn FROM flows)"""

DOTTED = "concat_ws('.', ({x} >> 24) & 255, ({x} >> 16) & 255, ({x} >> 8) & 255, {x} & 255)"

RULES_SQL = """cmds AS (
  SELECT seq, op, CAST(iface AS VARCHAR) AS iface, CAST(proto AS VARCHAR) AS proto,
         CAST(dst_lo AS BIGINT) AS dst_lo, CAST(dst_hi AS BIGINT) AS dst_hi, CAST(dport AS INTEGER) AS dport,
         CAST(state AS VARCHAR[]) AS state, CAST(tcp_flags AS VARCHAR) AS tcp_flags, CAST(syn AS BOOLEAN) AS syn, verdict
  FROM (VALUES
    (1, 'A', 'lo', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ACCEPT'),
    (2, 'A', NULL, NULL, 2130706432, 2147483647, NULL, NULL, NULL, NULL, 'REJECT'),
    (3, 'A', NULL, 'tcp', NULL, NULL, NULL, ['NEW'], NULL, false, 'DROP'),
    (4, 'A', NULL, 'tcp', NULL, NULL, NULL, NULL, 'NONE', NULL, 'DROP'),
    (5, 'A', NULL, 'tcp', NULL, NULL, NULL, NULL, 'ALL', NULL, 'DROP'),
    (6, 'A', NULL, NULL, NULL, NULL, NULL, ['ESTABLISHED', 'RELATED'], NULL, NULL, 'ACCEPT'),
    (7, 'A', NULL, 'tcp', NULL, NULL, 22, NULL, NULL, NULL, 'ACCEPT'),
    (8, 'I', 'eth1', 'tcp', NULL, NULL, NULL, NULL, NULL, NULL, 'ACCEPT'),
    (9, 'A', NULL, 'tcp', NULL, NULL, 50070, NULL, NULL, NULL, 'ACCEPT')
  ) v(seq, op, iface, proto, dst_lo, dst_hi, dport, state, tcp_flags, syn, verdict)),
rules AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN op = 'I' THEN -seq ELSE seq END) AS rnk FROM cmds)"""

_FIRST_MATCH_SQL = f"""
WITH {FLOWS_SQL}, {RULES_SQL},
m AS (SELECT f.flow_id, arg_min(r.verdict, r.rnk) AS v, min(r.rnk) AS k
      FROM flows2 f JOIN rules r
        ON (r.iface IS NULL OR r.iface = f.iface) AND (r.proto IS NULL OR r.proto = f.proto)
       AND (r.dst_lo IS NULL OR f.dst BETWEEN r.dst_lo AND r.dst_hi) AND (r.dport IS NULL OR r.dport = f.dport)
       AND (r.state IS NULL OR list_contains(r.state, f.state)) AND (r.tcp_flags IS NULL OR r.tcp_flags = f.tcp_flags)
       AND (r.syn IS NULL OR r.syn = f.syn)
      GROUP BY f.flow_id)
SELECT f.flow_id, coalesce(m.v, 'DROP') AS verdict, CAST(m.k AS INTEGER) AS rule_rank
FROM flows2 f LEFT JOIN m ON m.flow_id = f.flow_id
"""

def prefix_sql(src: str) -> str:
    return """p AS (
  SELECT 2886729728 AS net, 16 AS prefix_len, 'campus' AS attr
  UNION ALL SELECT 2886729728 + n_nationkey * 256, 24, n_name FROM nation
  UNION ALL SELECT 2886729728 + s_suppkey * 8, 29, s_name FROM supplier
  UNION ALL SELECT 2886729728 + c_custkey * 3, 32, c_name FROM customer),
pn AS (SELECT net // CAST(pow(2, 32 - prefix_len) AS BIGINT) AS blk, prefix_len, min(attr) AS attr FROM p GROUP BY ALL),
e AS (SELECT event_id, 2886729728 + """ + src + """ AS src FROM events),
hits AS (SELECT e.event_id, pn.attr, pn.prefix_len FROM e JOIN pn
         ON e.src // CAST(pow(2, 32 - pn.prefix_len) AS BIGINT) = pn.blk),
best AS (SELECT event_id, arg_max(attr, prefix_len) AS attr, max(prefix_len) AS prefix_len FROM hits GROUP BY event_id)"""

_PREFIX_Q = f"""
WITH {prefix_sql("(user_id * 1009) % 131072")}
SELECT e.event_id, {DOTTED.format(x='e.src')} AS src_ip, best.attr, CAST(best.prefix_len AS INTEGER) AS prefix_len
FROM e LEFT JOIN best ON best.event_id = e.event_id
"""

ORACLE = {
    "first_match_policy": _FIRST_MATCH_SQL,
    "first_match_joined": _FIRST_MATCH_SQL,
    "cidr_allow": f"""
WITH {FLOWS_SQL}
SELECT flow_id, {DOTTED.format(x='src')} AS src_ip, dport,
       (src // 128 = 2886729728 // 128) AND dport IN (443, 22, 7734) AS allowed,
       (src // 256) = (dst // 256) AS same_subnet
FROM flows
""",
    "pool_range": f"""
WITH {FLOWS_SQL},
pools(network, lo, hi) AS (VALUES ('pool-a', 2886729728 + 51, 2886729728 + 90),
                                  ('pool-b', 2886729728 + 91, 2886729728 + 120),
                                  ('pool-c', 2886729728 + 100, 2886729728 + 3 * 256 + 255))
SELECT f.flow_id, {DOTTED.format(x='f.src')} AS src_ip, p.network
FROM flows f LEFT JOIN pools p ON f.src BETWEEN p.lo AND p.hi
""",
    "prefix_enrich": _PREFIX_Q,
    "prefix_enrich_shuffled": _PREFIX_Q,
    "threshold_band": """
SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * 2) AS INTEGER) AS pct,
       CASE WHEN floor(l_quantity * 2) >= 90 THEN 'critical' WHEN floor(l_quantity * 2) >= 80 THEN 'warn' ELSE 'ok' END AS band
FROM lineitem
""",
    "role_map": """
WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'NameNode' WHEN 'AUTOMOBILE' THEN 'ResourceManager'
             WHEN 'MACHINERY' THEN 'Workers/' || CAST(c_custkey AS VARCHAR) WHEN 'HOUSEHOLD' THEN 'MonitorMaster'
             ELSE 'MyWorkers' || CAST(c_custkey AS VARCHAR) END AS role FROM customer)
SELECT c_custkey, role,
       CAST(CASE WHEN role = 'NameNode' THEN 50070 WHEN role = 'ResourceManager' THEN 8088
                 WHEN role LIKE 'Workers%' THEN NULL WHEN role = 'MonitorMaster' THEN 9995 END AS INTEGER) AS port,
       role LIKE 'Workers%' AS is_worker
FROM c
""",
}
