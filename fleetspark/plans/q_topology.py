"""Build-plan step 2: topology queries over a triples graph reshaped from
``customer`` / ``nation`` / ``region`` / ``supplier`` (J2-J6, J8, G1, A1, A2, U1).

Stand-in graph: a request per nation; each customer is a single node with one
interface on the broadcast link of its market segment; each supplier is a node
group of ``numCE`` machines from a base address.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions.ip import num_to_ip
from fleetspark.operators.graph import (NODE_IP_PATTERNS, address_conflicts, expand_groups, fanout_sizes,
                                        group_sizes, host_table, match_patterns, node_link_ips, ordered_list_pages)
from fleetspark.plans.tables import BASE_ADDRESS, table

MEMBERS_PER_PAGE = 8
GROUP_PATTERNS = [("?g", "type", "NodeGroup"), ("?g", "numCE", "?n"), ("?g", "baseIP", "?base")]


class _branch:
    """One predicate's triples from one table, built only when asked for.  The
    predicate is a literal, so a pattern filter on another predicate would also
    prune this branch at planning time."""

    def __init__(self, df, req, s, p, o, kind="uri", dt=None):
        self._pred = p
        self._args = (df, req, s, o, kind, dt)

    def build(self):
        df, req, s, o, kind, dt = self._args
        return df.select(req.alias("request_id"), s.alias("subject"), F.lit(self._pred).alias("predicate"),
                         o.cast("string").alias("object"), F.lit(kind).alias("object_kind"),
                         F.lit(dt).cast("string").alias("datatype"))


def fleet_triples(spark, d, predicates=None):
    """The stand-in graph; ``predicates`` keeps only the branches a pattern set can
    match (the same pruning Catalyst does on the literal predicate column, done
    before analysis so the plan stays small)."""
    want = None if predicates is None else set(predicates)
    base = F.lit(BASE_ADDRESS)
    c = table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    req = F.concat(F.lit("req-"), F.col("c_nationkey").cast("string"))
    node, iface, addr = (F.concat(F.lit(p), key) for p in ("node-", "if-", "ip-"))
    link = F.concat(F.lit("link-"), F.col("c_nationkey").cast("string"), F.lit("-"), F.lower("c_mktsegment"))
    img = F.concat(F.lit("img-"), F.lower("c_mktsegment"))
    dom = F.concat(F.lit("dom-"), F.col("c_nationkey").cast("string"))
    parts = [
        _branch(c, req, node, "type", F.lit("Node")),
        _branch(c, req, node, "name", F.col("c_name"), "literal", "xsd:string"),
        _branch(c, req, node, "hasInterface", iface),
        _branch(c, req, link, "hasInterface", iface),
        _branch(c, req, iface, "localIPAddress", addr),
        _branch(c, req, addr, "label_ID", num_to_ip(base + F.col("c_custkey")), "literal"),
        _branch(c, req, addr, "netmask", F.lit("255.255.0.0"), "literal"),
        _branch(c, req, node, "diskImage", img),
        _branch(c.where(F.col("c_acctbal") >= 0), req, node, "inDomain", dom),
    ]
    links = _Lazy(lambda: c.select(req.alias("request_id"), link.alias("link"), img.alias("img"),
                                   F.lower("c_mktsegment").alias("seg")).distinct())
    lreq = F.col("request_id")
    parts += [
        _branch(links, lreq, F.col("link"), "type", F.lit("BroadcastConnection")),
        _branch(links, lreq, F.col("link"), "bandwidth", F.lit("10000000"), "literal", "xsd:integer"),
        _branch(links, lreq, F.col("img"), "url",
                F.concat(F.lit("http://images.example/"), F.col("seg"), F.lit(".tgz")), "literal"),
    ]
    nr = _Lazy(lambda: table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    nreq = F.concat(F.lit("req-"), F.col("n_nationkey").cast("string"))
    reg = F.concat(F.lit("region-"), F.col("n_regionkey").cast("string"))
    parts += [
        _branch(nr, nreq, F.concat(F.lit("dom-"), F.col("n_nationkey").cast("string")), "inRegion", reg),
        _branch(nr, nreq, reg, "label", F.col("r_name"), "literal"),
    ]
    s = _Lazy(lambda: table(spark, d, "supplier"))
    g = F.concat(F.lit("group-"), F.col("s_suppkey").cast("string"))
    sreq = F.concat(F.lit("req-"), F.col("s_nationkey").cast("string"))
    parts += [
        _branch(s, sreq, g, "type", F.lit("NodeGroup")),
        _branch(s, sreq, g, "numCE", F.lit(1) + F.pmod(F.col("s_suppkey"), F.lit(4)), "literal", "xsd:integer"),
        _branch(s, sreq, g, "baseIP", num_to_ip(base + F.pmod(F.floor("s_acctbal"), F.lit(1500))), "literal"),
    ]
    if want is not None:
        parts = [p for p in parts if p._pred in want]
    built = [p.build() for p in parts]
    out = built[0]
    for p in built[1:]:
        out = out.unionByName(p)
    return out


class _Lazy:
    """A DataFrame made on first use (so unused stand-in branches cost nothing)."""

    def __init__(self, make):
        self._make, self._df = make, None

    def __getattr__(self, name):
        if self._df is None:
            self._df = self._make()
        return getattr(self._df, name)


def triples_for(spark, d, patterns, optional=()):
    return fleet_triples(spark, d, {p for _, p, _ in [*patterns, *optional]})


def bgp_customer_region(spark, d):
    """General basic graph pattern: node -> domain -> region -> label."""
    pats = [("?node", "type", "Node"), ("?node", "inDomain", "?dom"), ("?dom", "inRegion", "?reg"),
            ("?reg", "label", "?rname")]
    return match_patterns(triples_for(spark, d, pats), pats).select("request_id", "node", "dom", "reg", "rname")


def node_ip(spark, d):
    """``$Node.IP("Link")`` for every node."""
    return node_link_ips(triples_for(spark, d, NODE_IP_PATTERNS))


def node_attrs(spark, d):
    """Node -> image -> URL, domain optional."""
    pats = [("?node", "type", "Node"), ("?node", "diskImage", "?image"), ("?image", "url", "?url")]
    opt = [("?node", "inDomain", "?domain")]
    m = match_patterns(triples_for(spark, d, pats, opt), pats, optional=opt)
    return m.select("request_id", "node", "image", "url", "domain")


def _groups(triples):
    return match_patterns(triples, GROUP_PATTERNS)


def group_expand(spark, d):
    """Node groups expanded to members 0..n-1 with base + k addresses (G1)."""
    ex = expand_groups(_groups(triples_for(spark, d, GROUP_PATTERNS)), "g", "n", "base")
    return ex.select("request_id", F.col("g").alias("grp"), "member_idx", "member", "ip")


def group_size(spark, d):
    """Machines per request: singles + sum of numCE (A1)."""
    t = triples_for(spark, d, GROUP_PATTERNS)
    singles = match_patterns(t, [("?node", "type", "Node")])
    groups = _groups(t).withColumn("num_ce", F.col("n").cast("bigint"))
    return group_sizes(singles, groups)


def hosts(spark, d):
    """Hosts table from singles, group members and name aliases, duplicates kept."""
    t = triples_for(spark, d, NODE_IP_PATTERNS + GROUP_PATTERNS + [("?node", "name", "?alias")])
    singles = node_link_ips(t)
    names = match_patterns(t, [("?node", "name", "?alias")])
    aliases = singles.join(names, ["request_id", "node"]).select("request_id", "ip", F.col("alias").alias("hostname"))
    members = expand_groups(_groups(t), "g", "n", "base").select("request_id", "ip", F.col("member").alias("hostname"))
    return host_table([("single", singles.select("request_id", "ip", F.col("node").alias("hostname"))),
                       ("alias", aliases), ("group", members)])


def conflicts(spark, d):
    """Addresses claimed twice inside a request: groups vs singles vs groups."""
    t = triples_for(spark, d, NODE_IP_PATTERNS + GROUP_PATTERNS)
    singles = node_link_ips(t).select("request_id", "ip_num", F.col("node").alias("owner"))
    members = expand_groups(_groups(t), "g", "n", "base").select("request_id", "ip_num", F.col("g").alias("owner"))
    return address_conflicts(singles.unionByName(members)).select(
        "request_id", "ip", "n_owners", "first_owner", "last_owner")


def member_list(spark, d):
    """``name=http://ip:2380`` members of each link joined by ',' in name order, in pages (A2)."""
    ips = node_link_ips(triples_for(spark, d, NODE_IP_PATTERNS))
    value = F.concat(F.col("node"), F.lit("=http://"), F.col("ip"), F.lit(":2380"))
    return ordered_list_pages(ips, ["request_id", "link"], value, [F.col("node"), F.col("ip_num")], MEMBERS_PER_PAGE)


def link_peers(spark, d):
    """Hosts sharing each broadcast link: host and pair counts, pairs not emitted."""
    ips = node_link_ips(triples_for(spark, d, NODE_IP_PATTERNS))
    return fanout_sizes(ips, ["request_id", "link"], "node", include_self=False)


def mesh_size(spark, d):
    """Full mesh per request, self included: host and pair counts, pairs not emitted."""
    t = triples_for(spark, d, GROUP_PATTERNS)
    singles = match_patterns(t, [("?node", "type", "Node")]).select("request_id", F.col("node").alias("host"))
    members = expand_groups(_groups(t), "g", "n", "base").select("request_id", F.col("member").alias("host"))
    return fanout_sizes(singles.unionByName(members), ["request_id"], "host", include_self=True)


QUERIES = {
    "bgp_customer_region": bgp_customer_region,
    "node_ip": node_ip,
    "node_attrs": node_attrs,
    "group_expand": group_expand,
    "group_size": group_size,
    "host_table": hosts,
    "address_conflicts": conflicts,
    "member_list": member_list,
    "link_peers": link_peers,
    "mesh_size": mesh_size,
}

_DOT = "concat_ws('.', ({x} >> 24) & 255, ({x} >> 16) & 255, ({x} >> 8) & 255, {x} & 255)"
_SINGLES = f"""singles AS (
  SELECT 'req-' || CAST(c_nationkey AS VARCHAR) AS request_id, 'node-' || CAST(c_custkey AS VARCHAR) AS node,
         'link-' || CAST(c_nationkey AS VARCHAR) || '-' || lower(c_mktsegment) AS link,
         {_DOT.format(x='(2886729728 + c_custkey)')} AS ip, 2886729728 + c_custkey AS ip_num, c_name
  FROM customer)"""
_MEMBERS = """grp AS (
  SELECT 'req-' || CAST(s_nationkey AS VARCHAR) AS request_id, 'group-' || CAST(s_suppkey AS VARCHAR) AS g,
         1 + s_suppkey % 4 AS n, 2886729728 + ((CAST(floor(s_acctbal) AS BIGINT) % 1500) + 1500) % 1500 AS base_num
  FROM supplier),
members AS (
  SELECT request_id, g, CAST(k AS INTEGER) AS member_idx, g || '/' || CAST(k AS VARCHAR) AS member, base_num + k AS ip_num
  FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM grp))"""

ORACLE = {
    "bgp_customer_region": """
SELECT 'req-' || CAST(c_nationkey AS VARCHAR) AS request_id, 'node-' || CAST(c_custkey AS VARCHAR) AS node,
       'dom-' || CAST(c_nationkey AS VARCHAR) AS dom, 'region-' || CAST(n_regionkey AS VARCHAR) AS reg, r_name AS rname
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE c_acctbal >= 0""",
    "node_ip": f"WITH {_SINGLES} SELECT request_id, node, link, ip, ip_num FROM singles",
    "node_attrs": """
SELECT 'req-' || CAST(c_nationkey AS VARCHAR) AS request_id, 'node-' || CAST(c_custkey AS VARCHAR) AS node,
       'img-' || lower(c_mktsegment) AS image, 'http://images.example/' || lower(c_mktsegment) || '.tgz' AS url,
       CASE WHEN c_acctbal >= 0 THEN 'dom-' || CAST(c_nationkey AS VARCHAR) END AS domain
FROM customer""",
    "group_expand": f"""WITH {_MEMBERS}
SELECT request_id, g AS grp, member_idx, member, {_DOT.format(x='ip_num')} AS ip FROM members""",
    "group_size": f"""WITH {_MEMBERS},
s AS (SELECT 'req-' || CAST(c_nationkey AS VARCHAR) AS request_id, count(*) AS n_single FROM customer GROUP BY 1),
g AS (SELECT request_id, CAST(sum(n) AS BIGINT) AS n_group_members FROM grp GROUP BY 1)
SELECT coalesce(s.request_id, g.request_id) AS request_id, coalesce(n_single, 0) AS n_single,
       coalesce(n_group_members, 0) AS n_group_members, coalesce(n_single, 0) + coalesce(n_group_members, 0) AS n_machines
FROM s FULL JOIN g ON s.request_id = g.request_id""",
    "host_table": f"""WITH {_SINGLES}, {_MEMBERS}
SELECT request_id, ip, node AS hostname, 'single' AS source FROM singles
UNION ALL SELECT request_id, ip, c_name, 'alias' FROM singles
UNION ALL SELECT request_id, {_DOT.format(x='ip_num')}, member, 'group' FROM members""",
    "address_conflicts": f"""WITH {_SINGLES}, {_MEMBERS},
o AS (SELECT DISTINCT request_id, ip_num, owner FROM (SELECT request_id, ip_num, node AS owner FROM singles
                                         UNION ALL SELECT request_id, ip_num, g FROM members))
SELECT request_id, {_DOT.format(x='ip_num')} AS ip, count(*) AS n_owners, min(owner) AS first_owner, max(owner) AS last_owner
FROM o GROUP BY request_id, ip_num HAVING count(*) >= 2""",
    "member_list": f"""WITH {_SINGLES}
, n AS (SELECT *, (row_number() OVER (PARTITION BY request_id, link ORDER BY node) - 1) // 8 AS page FROM singles)
SELECT request_id, link, page, string_agg(node || '=http://' || ip || ':2380', ',' ORDER BY node) AS members
FROM n GROUP BY request_id, link, page""",
    "link_peers": f"""WITH {_SINGLES}
SELECT request_id, link, count(*) AS n_hosts, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_pairs
FROM singles GROUP BY request_id, link""",
    "mesh_size": f"""WITH {_SINGLES}, {_MEMBERS},
h AS (SELECT DISTINCT request_id, host FROM (SELECT request_id, node AS host FROM singles
                                             UNION ALL SELECT request_id, member FROM members))
SELECT request_id, count(*) AS n_hosts, CAST(count(*) * count(*) AS BIGINT) AS n_pairs FROM h GROUP BY request_id""",
}
