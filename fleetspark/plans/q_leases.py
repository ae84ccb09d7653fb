"""Build-plan steps 0 and 1: lease queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions.jsonx import decode_inner, map_get
from fleetspark.functions.predicate import compile_predicate
from fleetspark.operators.leases import (bounded_allocation, keep_per_match, lookup_last,
                                         map_from_rows, nth_rows)
from fleetspark.plans.tables import table
from fleetspark.streaming.sources import shared_path, write_table

# The lease predicates of the build plan.
LEASE_PREDICATE = '["and",["==","$o_orderstatus","O"],["==","$o_orderpriority","1-URGENT"]]'
PROP_PREDICATE = '["and",["==","$event_type","purchase"],["=","$props.k","7"]]'


def lease_pick(spark, d):
    """Prefix predicate on orders (P4), 1st-3rd pick per customer (W1, empty when
    short), last-wins left lookup of the customer name (J1, P1, P2)."""
    orders = table(spark, d, "orders")
    cand = orders.where(compile_predicate(LEASE_PREDICATE, orders))
    picks = nth_rows(cand, ["o_custkey"], ["o_orderdate", "o_orderkey"], [0, 1, 2],
                     ["o_orderkey", "o_orderdate"])
    cust = table(spark, d, "customer")
    out = lookup_last(picks, cust, "o_custkey", "c_custkey", ["c_name"], "c_acctbal")
    return out.select("o_custkey", "c_name", "idx", "o_orderkey", "o_orderdate")


def lookup_repeated(spark, d):
    """Every customer with the priority of its last order: a lookup whose keys repeat (J1); null without orders."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return lookup_last(c, table(spark, d, "orders"), "c_custkey", "o_custkey", ["o_orderpriority"], "o_orderkey")


def sink_append(spark, d):
    """Orders written over an older listing, then the open ones appended again; read back, repeats counted."""
    path = shared_path(spark, "order-listing")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    write_table(o.where(F.col("o_orderstatus") == "F"), path, "overwrite")
    write_table(o, path, "overwrite")
    write_table(o.where(F.col("o_orderstatus") == "O"), path, "append")
    back = spark.read.schema(o.schema).parquet(path)
    return back.groupBy("o_orderkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_listed"))


def _orders_with_lines(spark, d):
    li = table(spark, d, "lineitem")
    nested = li.groupBy("l_orderkey").agg(
        F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey")).alias("lines"))
    o = table(spark, d, "orders")
    return o.join(nested, o.o_orderkey == nested.l_orderkey, "inner").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "lines")


def explode_dup(spark, d):
    """Parent once per matching nested element."""
    parents = _orders_with_lines(spark, d)
    return keep_per_match(parents, "lines", lambda r: r["l_returnflag"] == "R").drop("lines")


def nested_exists(spark, d):
    """Set form of P3: parent once if any nested element matches."""
    parents = _orders_with_lines(spark, d)
    return keep_per_match(parents, "lines", lambda r: r["l_returnflag"] == "R", set_form=True).drop("lines")


def bounded_alloc(spark, d):
    """Orders per customer and priority: valid with at least 2, take at most 3 (A5)."""
    o = table(spark, d, "orders")
    out = bounded_allocation(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], 2, 3)
    return out.select("o_custkey", "o_orderpriority", "o_orderkey", "pick", "n_candidates")


def double_json(spark, d):
    """A JSON field holding JSON text, decoded twice."""
    e = table(spark, d, "events", spread_rows=True)
    payload = F.to_json(F.struct(F.col("props").alias("reservations")))
    return e.select("event_id", decode_inner(payload, "$.reservations", "k bigint")["k"].alias("k"))


def map_lookup(spark, d):
    """Per order: map return flag -> part (last line wins, A3), looked up for 'R' (F15)."""
    li = table(spark, d, "lineitem", spread_rows=True)  # sort-based dedupe: spread the CPU work
    m = map_from_rows(li, ["l_orderkey"], "l_returnflag", "l_partkey", "l_linenumber")
    return m.select("l_orderkey", map_get("m", "R").alias("r_partkey"), F.size("m").alias("n_keys"))


def prop_predicate(spark, d):
    """Prefix predicate with a nested path into parsed properties."""
    e = table(spark, d, "events", spread_rows=True).withColumn("props", F.from_json("props", "map<string,string>"))
    return e.where(compile_predicate(PROP_PREDICATE, e)).select("event_id", "user_id", "ts")


QUERIES = {
    "lease_pick": lease_pick,
    "lookup_repeated": lookup_repeated,
    "sink_append": sink_append,
    "explode_dup": explode_dup,
    "nested_exists": nested_exists,
    "bounded_alloc": bounded_alloc,
    "double_json": double_json,
    "map_lookup": map_lookup,
    "prop_predicate": prop_predicate,
}

ORACLE = {
    "lease_pick": """
WITH cand AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders
              WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rn FROM cand),
want AS (SELECT o_custkey, unnest([0, 1, 2]) AS idx FROM (SELECT DISTINCT o_custkey FROM cand)),
cust AS (SELECT c_custkey, arg_max(c_name, c_acctbal) AS c_name FROM customer GROUP BY c_custkey)
SELECT w.o_custkey, cu.c_name, CAST(w.idx AS INTEGER) AS idx, r.o_orderkey, r.o_orderdate
FROM want w LEFT JOIN ranked r ON r.o_custkey = w.o_custkey AND r.rn = w.idx
LEFT JOIN cust cu ON cu.c_custkey = w.o_custkey
""",
    "lookup_repeated": """
WITH l AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, o_orderpriority FROM customer LEFT JOIN l ON o_custkey = c_custkey""",
    "sink_append": """
SELECT o_orderkey, o_orderstatus, sum(CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END)::BIGINT AS n_listed
FROM orders GROUP BY o_orderkey, o_orderstatus""",
    "explode_dup": """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE l.l_returnflag = 'R'
""",
    "nested_exists": """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
""",
    "bounded_alloc": """
WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey,
             CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS pick,
             COUNT(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n_candidates FROM orders)
SELECT o_custkey, o_orderpriority, o_orderkey, pick, n_candidates FROM r WHERE n_candidates >= 2 AND pick <= 3
""",
    "double_json": """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""",
    "map_lookup": """
WITH d AS (SELECT l_orderkey, l_returnflag, arg_max(l_partkey, [l_linenumber, l_partkey]) AS pk
           FROM lineitem GROUP BY l_orderkey, l_returnflag)
SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN pk END) AS r_partkey,
       CAST(count(*) AS INTEGER) AS n_keys
FROM d GROUP BY l_orderkey
""",
    "prop_predicate": """
SELECT event_id, user_id, ts FROM events
WHERE event_type = 'purchase' AND json_extract_string(props, '$.k') = '7'
""",
}
