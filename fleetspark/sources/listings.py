"""JSON listings from cloud CLIs (S4): a file holding one JSON array of objects
(``host-list -f json``, ``host-allocation-list``, ``lease-show``).

Read with ``multiLine`` and an explicit schema (no inference pass, stable
types across files); each array element becomes a row, nested arrays stay
``ARRAY<STRUCT>`` for P3 / G2, and JSON text inside a field is decoded with
``functions.jsonx.decode_inner`` (F14).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOSTS_SCHEMA = ("id string, hypervisor_hostname string, node_type string, "
                "network_adapters array<struct<interface:string,enabled:string>>")
ALLOCATIONS_SCHEMA = "resource_id string, reservations array<struct<id:string,lease_id:string>>"
LEASE_SCHEMA = "id string, name string, reservations string, start_date string, end_date string"


def read_listing(spark: SparkSession, paths: str | Sequence[str], schema: str,
                 recursive: bool = False) -> DataFrame:
    """Rows of JSON-array listing files, with the file, the element's position in
    it (``ord``) and both together (``place``): "last duplicate wins" orders by
    ``place``, files by name as a shell lists them.  ``null`` elements are skipped.  Each listing file is one row while it is parsed, as a
    CLI listing is; many files are spread over tasks."""
    reader = spark.read.option("recursiveFileLookup", "true") if recursive else spark.read
    raw = reader.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("js"))
    elems = raw.select("file", F.posexplode(F.from_json("js", f"array<struct<{_struct_fields(schema)}>>")).alias(
        "ord", "e"))
    return elems.where(F.col("e").isNotNull()).select("file", "ord", F.struct("file", "ord").alias("place"), "e.*")


def rejected_listings(spark: SparkSession, paths: str | Sequence[str], schema: str, recursive: bool = False) -> DataFrame:
    """Files (``file``, ``js``) that are no JSON array of ``schema``, such as truncated ones: ``read_listing``
    has no row of them."""
    reader = spark.read.option("recursiveFileLookup", "true") if recursive else spark.read
    raw = reader.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("js"))
    return raw.where(F.from_json("js", f"array<struct<{_struct_fields(schema)}>>").isNull())


def write_listing_documents(objects: DataFrame, path: str, n_docs: int, key) -> None:
    """Write JSON objects (column ``value``) as ``n_docs`` JSON-array files.

    Elements are hashed to a file by ``key`` and written in parallel, so no
    element knows it is the last: each is followed by a comma and a ``null``
    closes the array (``read_listing`` skips nulls)."""
    spark = objects.sparkSession
    body = objects.select(F.pmod(F.xxhash64(key), F.lit(n_docs)).cast("int").alias("doc"), F.lit(1).alias("seq"),
                          F.concat(F.col("value"), F.lit(",")).alias("value"))
    docs = spark.range(n_docs).select(F.col("id").cast("int").alias("doc"))
    head = docs.select("doc", F.lit(0).alias("seq"), F.lit("[").alias("value"))
    foot = docs.select("doc", F.lit(2).alias("seq"), F.lit("null]").alias("value"))
    out = (body.unionByName(head).unionByName(foot)
           .repartition(n_docs, "doc").sortWithinPartitions("doc", "seq").select("doc", "value"))
    out.write.mode("overwrite").partitionBy("doc").text(path)


def _struct_fields(ddl: str) -> str:
    # "a string, b array<...>" -> "a:string,b:array<...>" for a struct<> type string
    out, depth, cur = [], 0, ""
    for ch in ddl:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    if cur.strip():
        out.append(cur.strip())
    fields = []
    for f in out:
        name, _, typ = f.partition(" ")
        fields.append(f"{name}:{typ.strip()}")
    return ",".join(fields)


def host_map(hosts: DataFrame, key_col: str = "id", value_col: str = "hypervisor_hostname",
             order_col: str = "place") -> DataFrame:
    """``map({"key": .id, "value": .hypervisor_hostname}) | from_entries`` as a
    two-column lookup table (P2, A3): one row per key, the last listed wins."""
    from fleetspark.operators.leases import last_wins
    return last_wins(hosts.select(F.col(key_col).alias("key"), F.col(value_col).alias("value"), order_col),
                     ["key"], ["value"], order_col)
