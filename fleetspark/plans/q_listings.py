"""Build-plan step 1 (scan part): host and allocation listings written as JSON
array files from ``customer`` / ``orders``, scanned back (S4) and run through
the lease query: predicate (P4), parent once per matching reservation (P3),
last-wins host name lookup (J1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions.predicate import compile_predicate
from fleetspark.operators.leases import keep_per_match, lookup_last
from fleetspark.operators.sizing import collect_bounded
from fleetspark.plans.tables import table
from fleetspark.session import documents_for
from fleetspark.sources.listings import ALLOCATIONS_SCHEMA, HOSTS_SCHEMA, LEASE_SCHEMA, read_listing, write_listing_documents
from fleetspark.streaming.sources import shared_path

# The host predicate and the lease looked up.
HOST_PREDICATE = '["and",["==","$network_adapters.1.enabled","True"],["==","$node_type","BUILDING"]]'
LEASE_NAME = "lease-1-urgent"


def _write_listings(spark, d):
    c = table(spark, d, "customer")
    hosts = c.select(F.col("c_custkey").alias("k"), F.to_json(F.struct(
        F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("hypervisor_hostname"), F.col("c_mktsegment").alias("node_type"),
        F.array(F.struct(F.lit("eth0").alias("interface"), F.lit("True").alias("enabled")),
                F.struct(F.lit("eth1").alias("interface"), F.when(F.col("c_acctbal") >= 0, "True").otherwise("False").alias("enabled"))
                ).alias("network_adapters"))).alias("value"))
    hosts_path = shared_path(spark, "hosts-listing")
    write_listing_documents(hosts, hosts_path, documents_for(hosts), F.col("k"))
    o = table(spark, d, "orders")
    # one object per host and month of reservations: no array holds all of a host's
    allocs = o.groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sort_array(F.collect_list(F.struct(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderpriority").alias("lease_id")))).alias("reservations"))
    allocs = allocs.select(F.col("o_custkey").alias("k"), F.to_json(F.struct(
        F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("resource_id"), "reservations")).alias("value"))
    allocs_path = shared_path(spark, "allocations-listing")
    write_listing_documents(allocs, allocs_path, documents_for(allocs), F.col("k"))
    leases = o.select("o_orderpriority").distinct().select(F.col("o_orderpriority").alias("k"), F.to_json(F.struct(
        F.col("o_orderpriority").alias("id"), F.concat(F.lit("lease-"), F.lower("o_orderpriority")).alias("name"),
        F.to_json(F.struct(F.concat(F.lit("res-"), F.col("o_orderpriority")).alias("id"))).alias("reservations"))).alias("value"))
    leases_path = shared_path(spark, "lease-listing")
    write_listing_documents(leases, leases_path, documents_for(leases), F.col("k"))
    return hosts_path, allocs_path, leases_path


def listing_lease(spark, d):
    """Listings scanned (S4) and queried: the named lease's id and the reservation id inside its JSON text (F14),
    eligible hosts by a nested property (P4, F16), allocations once per reservation of the lease (P3), host name
    by last-wins lookup (J1)."""
    hosts_path, allocs_path, leases_path = _write_listings(spark, d)
    hosts = read_listing(spark, hosts_path, HOSTS_SCHEMA, recursive=True)
    eligible = hosts.where(compile_predicate(HOST_PREDICATE, hosts))
    allocs = read_listing(spark, allocs_path, ALLOCATIONS_SCHEMA, recursive=True)
    lease = read_listing(spark, leases_path, LEASE_SCHEMA, recursive=True).where(F.col("name") == LEASE_NAME)
    found = collect_bounded(lease.select("id", F.from_json("reservations", "id string")["id"].alias("reservation")), 1,
                            "lease of that name")
    lease_id, reservation = (found[0]["id"], found[0]["reservation"]) if found else (None, None)
    mine = keep_per_match(allocs, "reservations", lambda r: r["lease_id"] == F.lit(lease_id))
    named = lookup_last(mine, eligible, "resource_id", "id", ["hypervisor_hostname"], "place")
    return named.select("resource_id", "hypervisor_hostname", F.lit(reservation).cast("string").alias("reservation_id"))


QUERIES = {"listing_lease": listing_lease}

ORACLE = {
    "listing_lease": """
SELECT 'h' || CAST(o.o_custkey AS VARCHAR) AS resource_id,
       CASE WHEN c.c_mktsegment = 'BUILDING' AND c.c_acctbal >= 0 THEN c.c_name END AS hypervisor_hostname,
       'res-' || o.o_orderpriority AS reservation_id
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderpriority = '1-URGENT'""",
}
