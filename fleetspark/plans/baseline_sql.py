"""

Each entry registers the same input the library query reads (driver tables,
or the same stand-in rows) as temp views and answers with the direct SQL
formulation: range joins as join conditions, first-match as join + group by,
``EXCEPT ALL``, one window per host.  ``bench.py`` times these next to the
library plans; ``tests/test_baseline.py`` checks both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.plans.q_lines import _embedded_copy
from fleetspark.plans.q_policy import policies_frame, prefix_points, prefixes_frame, rules_frame
from fleetspark.plans.q_retention import _logs
from fleetspark.plans.q_scan import _log_lines
from fleetspark.plans.tables import doc_lines, flows, table

_DOT = "concat_ws('.', shiftright({x}, 24) & 255, shiftright({x}, 16) & 255, shiftright({x}, 8) & 255, {x} & 255)"


def _views(spark, **dfs):
    for name, df in dfs.items():
        df.createOrReplaceTempView(name)


def lease_pick(spark, d):
    _views(spark, b_orders=table(spark, d, "orders"), b_customer=table(spark, d, "customer"))
    return spark.sql("""
WITH cand AS (SELECT o_custkey, o_orderkey, o_orderdate FROM b_orders
              WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rn FROM cand),
want AS (SELECT o_custkey, explode(array(0, 1, 2)) AS idx FROM (SELECT DISTINCT o_custkey FROM cand)),
cust AS (SELECT c_custkey, max_by(c_name, c_acctbal) AS c_name FROM b_customer GROUP BY c_custkey)
SELECT w.o_custkey, cu.c_name, w.idx, r.o_orderkey, r.o_orderdate
FROM want w LEFT JOIN ranked r ON r.o_custkey = w.o_custkey AND r.rn = w.idx
LEFT JOIN cust cu ON cu.c_custkey = w.o_custkey""")


def first_match_policy(spark, d):
    _views(spark, b_flows=flows(spark, d), b_rules=rules_frame(spark), b_pol=policies_frame(spark))
    return spark.sql("""
WITH m AS (SELECT f.flow_id, min_by(r.verdict, r.rank) AS v, min(r.rank) AS k
           FROM b_flows f JOIN b_rules r ON r.chain = f.chain
            AND (r.iface IS NULL OR r.iface = f.iface) AND (r.proto IS NULL OR r.proto = f.proto)
            AND (r.dst_lo IS NULL OR f.dst BETWEEN r.dst_lo AND r.dst_hi) AND (r.dport IS NULL OR r.dport = f.dport)
            AND (r.state IS NULL OR array_contains(r.state, f.state))
            AND (r.tcp_flags IS NULL OR r.tcp_flags = f.tcp_flags) AND (r.syn IS NULL OR r.syn = f.syn)
           GROUP BY f.flow_id)
SELECT f.flow_id, coalesce(m.v, p.verdict) AS verdict, m.k AS rule_rank
FROM b_flows f LEFT JOIN m ON m.flow_id = f.flow_id LEFT JOIN b_pol p ON p.chain = f.chain""")


def prefix_enrich(spark, d):
    _views(spark, b_points=prefix_points(spark, d), b_prefixes=prefixes_frame(spark, d))
    mask = "(4294967296 - CAST(pow(2, 32 - {l}) AS BIGINT))"
    return spark.sql(f"""
WITH pn AS (SELECT net & {mask.format(l='prefix_len')} AS net, prefix_len, min(attr) AS attr
            FROM b_prefixes GROUP BY 1, 2),
hits AS (SELECT e.event_id, pn.attr, pn.prefix_len FROM b_points e
         JOIN pn ON (e.src & {mask.format(l='pn.prefix_len')}) = pn.net),
best AS (SELECT event_id, max_by(attr, prefix_len) AS attr, max(prefix_len) AS prefix_len FROM hits GROUP BY event_id)
SELECT e.event_id, {_DOT.format(x='e.src')} AS src_ip, best.attr, best.prefix_len
FROM b_points e LEFT JOIN best ON best.event_id = e.event_id""")


def deadline(spark, d):
    _views(spark, b_events=table(spark, d, "events"))
    return spark.sql("""
SELECT s.user_id, s.event_id, s.ts AS started, min(p.ts) AS done_at,
       CASE WHEN min(p.ts) IS NULL THEN 'timeout' ELSE 'done' END AS status
FROM (SELECT user_id, event_id, ts FROM b_events WHERE event_type = 'click') s
LEFT JOIN (SELECT user_id, ts FROM b_events WHERE event_type = 'purchase') p
  ON p.user_id = s.user_id AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 120 SECONDS
GROUP BY s.user_id, s.event_id, s.ts""")


def line_drift(spark, d):
    lines = doc_lines(spark, d)
    _views(spark, b_lines=lines, b_emb=_embedded_copy(lines))
    return spark.sql("""
SELECT doc_id, line, 'only_standalone' AS side FROM
  (SELECT doc_id, line FROM b_lines EXCEPT ALL SELECT doc_id, line FROM b_emb)
UNION ALL
SELECT doc_id, line, 'only_embedded' AS side FROM
  (SELECT doc_id, line FROM b_emb EXCEPT ALL SELECT doc_id, line FROM b_lines)""")


def size_budget(spark, d):
    _views(spark, b_logs=_logs(spark, d))
    return spark.sql("""
SELECT host, event_id, ts, bytes, cum_bytes FROM (
  SELECT *, sum(bytes) OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_bytes FROM b_logs)
WHERE cum_bytes <= 4194304""")


def map_lookup(spark, d):
    _views(spark, b_lineitem=table(spark, d, "lineitem"))
    return spark.sql("""
WITH dd AS (SELECT l_orderkey, l_returnflag, max_by(l_partkey, struct(l_linenumber, l_partkey)) AS pk
            FROM b_lineitem GROUP BY l_orderkey, l_returnflag)
SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN pk END) AS r_partkey, CAST(count(*) AS INT) AS n_keys
FROM dd GROUP BY l_orderkey""")


def second_last(spark, d):
    _views(spark, b_orders=table(spark, d, "orders"))
    return spark.sql("""
SELECT o_custkey, o_orderpriority, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
         count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM b_orders)
WHERE rn = least(2, n)""")


def access_log(spark, d):
    _views(spark, b_log=_log_lines(spark, d))
    rx = r'^(\\S+) - (\\S+) \\[([^\\]]+)\\] "([^"]*)" (\\d{3}) (\\d+|-) "([^"]*)" "([^"]*)" "([^"]*)"$'
    g = lambda i: f"regexp_extract(value, '{rx}', {i})"
    return spark.sql(f"""
SELECT {g(1)} AS remote_addr, {g(2)} AS remote_user,
       to_timestamp_ntz(substring_index({g(3)}, ' ', 1), 'dd/MMM/yyyy:HH:mm:ss') AS time_local,
       {g(4)} AS request, CAST({g(5)} AS INT) AS status, CAST({g(6)} AS BIGINT) AS body_bytes_sent,
       {g(7)} AS referer, {g(8)} AS user_agent, {g(9)} AS x_forwarded_for
FROM b_log WHERE value RLIKE '{rx}'""")


def merge_newer(spark, d):
    from fleetspark.plans.q_audit import _dirs
    src, dst = _dirs(spark, d)
    _views(spark, b_src=src, b_dst=dst)
    return spark.sql("""
WITH u AS (SELECT name, mtime, content, 'source' AS side, 0 AS t FROM b_src
           UNION ALL SELECT name, mtime, content, 'target' AS side, 1 AS t FROM b_dst),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY mtime DESC, t DESC) AS rn FROM u)
SELECT name, mtime, content, side FROM r WHERE rn = 1""")


BASELINES = {
    "lease_pick": lease_pick,
    "first_match_policy": first_match_policy,
    "prefix_enrich": prefix_enrich,
    "deadline": deadline,
    "line_drift": line_drift,
    "size_budget": size_budget,
    "map_lookup": map_lookup,
    "second_last": second_last,
    "access_log": access_log,
    "merge_newer": merge_newer,
}
