"""Build-plan step 2 (scan part): RDF/XML requests written from ``customer``
into the shared folder and scanned back into triples (S1)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.session import documents_for

from fleetspark.functions.ip import num_to_ip
from fleetspark.plans.tables import BASE_ADDRESS, table
from fleetspark.operators.graph import host_table, node_link_ips
from fleetspark.sources.rdf import local_triples, read_rdf, write_rdf_documents, xml_escape
from fleetspark.streaming.sources import shared_path, write_table

# Namespaces of the written requests.
NS = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
      "topology": "http://fleet.example/topology#",
      "layer": "http://fleet.example/layer#"}
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"

_RES = T.StructType([T.StructField("_rdf:resource", T.StringType())])
DESCRIPTION_SCHEMA = T.StructType([
    T.StructField("_rdf:about", T.StringType()),
    T.StructField("rdf:type", _RES),
    T.StructField("topology:hasInterface", T.ArrayType(_RES)),
    T.StructField("layer:label_ID", T.StringType()),
    T.StructField("topology:hasName", T.StructType([T.StructField("_VALUE", T.StringType()),
                                                    T.StructField("_rdf:datatype", T.StringType())])),
])


def _descriptions(spark, d):
    """One ``rdf:Description`` per customer node: its type, one or two interfaces
    (a repeated predicate), its address and a typed, escaped name."""
    c = table(spark, d, "customer")
    base = F.concat(F.lit("http://fleet.example/req-"), F.col("c_nationkey").cast("string"), F.lit("#"))
    key = F.col("c_custkey").cast("string")
    xmlns = " ".join(f'xmlns:{k}="{v}"' for k, v in NS.items())
    iface = lambda suffix: F.concat(F.lit('<topology:hasInterface rdf:resource="'), base, F.lit("if-"), key,
                                    F.lit(suffix + '"/>'))
    return c.select(F.concat(
        F.lit(f"<rdf:Description {xmlns} rdf:about=\""), base, F.lit("node-"), key, F.lit('">'),
        F.lit(f'<rdf:type rdf:resource="{NS["topology"]}Node"/>'),
        iface("-a"),
        F.when(F.col("c_acctbal") >= 0, iface("-b")).otherwise(F.lit("")),
        F.lit("<layer:label_ID>"), num_to_ip(F.lit(BASE_ADDRESS) + F.col("c_custkey")), F.lit("</layer:label_ID>"),
        F.lit(f'<topology:hasName rdf:datatype="{XSD_STRING}">'), xml_escape(F.concat(F.col("c_name"), F.lit(" & co"))),
        F.lit("</topology:hasName></rdf:Description>")).alias("value"))


def rdf_scan(spark, d):
    """Requests written as RDF/XML documents and scanned back into long triples."""
    path = shared_path(spark, "rdf-requests")
    nodes = _descriptions(spark, d)
    write_rdf_documents(nodes, path, documents_for(nodes), F.col("value"), NS)
    return read_rdf(spark, path, schema=DESCRIPTION_SCHEMA, request_from="subject", recursive=True)


TOPOLOGY_SCHEMA = T.StructType([
    T.StructField("_rdf:about", T.StringType()),
    T.StructField("rdf:type", _RES),
    T.StructField("topology:hasInterface", T.ArrayType(_RES)),
    T.StructField("layer:localIPAddress", _RES),
    T.StructField("layer:label_ID", T.StringType()),
])


def _topology_descriptions(spark, d):
    """Each customer a node with an interface on its segment's link, and a second one on the nation's backup
    link where its balance is not negative; each link described once by its type, then per interface."""
    c = table(spark, d, "customer")
    base = F.concat(F.lit("http://fleet.example/req-"), F.col("c_nationkey").cast("string"), F.lit("#"))
    key = F.col("c_custkey").cast("string")
    xmlns = " ".join(f'xmlns:{k}="{v}"' for k, v in NS.items())

    def about(name, *body):
        return F.concat(F.lit(f'<rdf:Description {xmlns} rdf:about="'), base, name, F.lit('">'), *body,
                        F.lit("</rdf:Description>"))

    def refer(predicate, name):
        return F.concat(F.lit(f'<{predicate} rdf:resource="'), base, name, F.lit('"/>'))

    def of_type(name):
        return F.lit(f'<rdf:type rdf:resource="{NS["topology"]}{name}"/>')

    def interface(side, link, address):
        iface, addr = F.concat(F.lit(f"if-{side}-"), key), F.concat(F.lit(f"ip-{side}-"), key)
        return F.concat(about(F.concat(F.lit("node-"), key), refer("topology:hasInterface", iface)),
                        about(link, refer("topology:hasInterface", iface)),
                        about(iface, refer("layer:localIPAddress", addr)),
                        about(addr, F.lit("<layer:label_ID>"), num_to_ip(address), F.lit("</layer:label_ID>")))

    front = F.concat(F.lit("link-"), F.lower("c_mktsegment"))
    second = interface("b", F.lit("link-backup"), F.lit(BASE_ADDRESS + 65536) + F.col("c_custkey"))
    nodes = c.select(F.concat(about(F.concat(F.lit("node-"), key), of_type("Node")),
                              interface("a", front, F.lit(BASE_ADDRESS) + F.col("c_custkey")),
                              F.when(F.col("c_acctbal") >= 0, second).otherwise(F.lit(""))).alias("value"))
    links = (c.select("c_nationkey", front.alias("link")).unionByName(c.select("c_nationkey", F.lit("link-backup").alias("link")))
             .distinct().select(about(F.col("link"), of_type("BroadcastConnection")).alias("value")))
    return nodes.unionByName(links)


def _scanned_ips(spark, d):
    """Requests written as RDF/XML, scanned (S1) once into a table of local triples, and its addresses per node and link."""
    path = shared_path(spark, "rdf-topology")
    described = _topology_descriptions(spark, d)
    write_rdf_documents(described, path, documents_for(described), F.col("value"), NS)
    triples = local_triples(read_rdf(spark, path, schema=TOPOLOGY_SCHEMA, request_from="subject", recursive=True))
    stored = shared_path(spark, "triples")
    write_table(triples, stored)
    return node_link_ips(spark.read.schema(triples.schema).parquet(stored))


def scanned_node_ip(spark, d):
    """Scanned requests to the address of every node on every link it has an interface on."""
    return _scanned_ips(spark, d).select("request_id", "node", "link", "ip")


def scanned_hosts(spark, d):
    """Scanned requests to a hosts table: each address under its node's name and under node.link."""
    ips = _scanned_ips(spark, d)
    return host_table([("node", ips.select("request_id", "ip", F.col("node").alias("hostname"))),
                       ("link", ips.select("request_id", "ip", F.concat_ws(".", "node", "link").alias("hostname")))])


QUERIES = {"rdf_scan": rdf_scan, "scanned_node_ip": scanned_node_ip, "scanned_hosts": scanned_hosts}

_SCANNED = """ifs AS (
  SELECT 'req-' || CAST(c_nationkey AS VARCHAR) AS request_id, 'node-' || CAST(c_custkey AS VARCHAR) AS node,
         'link-' || lower(c_mktsegment) AS link, 2886729728 + c_custkey AS n FROM customer
  UNION ALL
  SELECT 'req-' || CAST(c_nationkey AS VARCHAR), 'node-' || CAST(c_custkey AS VARCHAR), 'link-backup',
         2886729728 + 65536 + c_custkey FROM customer WHERE c_acctbal >= 0),
ips AS (SELECT request_id, node, link, concat_ws('.', (n >> 24) & 255, (n >> 16) & 255, (n >> 8) & 255, n & 255) AS ip FROM ifs)"""

ORACLE = {
    "scanned_node_ip": f"WITH {_SCANNED} SELECT request_id, node, link, ip FROM ips",
    "scanned_hosts": f"""WITH {_SCANNED}
SELECT request_id, ip, node AS hostname, 'node' AS source FROM ips
UNION ALL SELECT request_id, ip, node || '.' || link, 'link' FROM ips""",
    "rdf_scan": """
WITH c AS (SELECT c_custkey, c_acctbal, c_name, 'req-' || CAST(c_nationkey AS VARCHAR) AS req,
                  'http://fleet.example/req-' || CAST(c_nationkey AS VARCHAR) || '#' AS base FROM customer)
SELECT req AS request_id, base || 'node-' || CAST(c_custkey AS VARCHAR) AS subject, 'rdf:type' AS predicate,
       'http://fleet.example/topology#Node' AS object, 'uri' AS object_kind, CAST(NULL AS VARCHAR) AS datatype FROM c
UNION ALL
SELECT req, base || 'node-' || CAST(c_custkey AS VARCHAR), 'topology:hasInterface',
       base || 'if-' || CAST(c_custkey AS VARCHAR) || '-a', 'uri', NULL FROM c
UNION ALL
SELECT req, base || 'node-' || CAST(c_custkey AS VARCHAR), 'topology:hasInterface',
       base || 'if-' || CAST(c_custkey AS VARCHAR) || '-b', 'uri', NULL FROM c WHERE c_acctbal >= 0
UNION ALL
SELECT req, base || 'node-' || CAST(c_custkey AS VARCHAR), 'layer:label_ID',
       concat_ws('.', ((2886729728 + c_custkey) >> 24) & 255, ((2886729728 + c_custkey) >> 16) & 255,
                 ((2886729728 + c_custkey) >> 8) & 255, (2886729728 + c_custkey) & 255), 'literal', NULL FROM c
UNION ALL
SELECT req, base || 'node-' || CAST(c_custkey AS VARCHAR), 'topology:hasName', c_name || ' & co', 'literal',
       'http://www.w3.org/2001/XMLSchema#string' FROM c""",
}
