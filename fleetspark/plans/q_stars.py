"""Graph patterns over scanned requests as joined stars (J2-J4): the requests of ``customer`` / ``nation`` /
``region`` are written as RDF/XML, scanned into triples (S1) stored once, and matched star by star."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.functions.ip import num_to_ip
from fleetspark.operators.graph import NODE_IP_PATTERNS
from fleetspark.operators.sizing import write_once
from fleetspark.operators.stars import match_stars
from fleetspark.plans.q_rdf import NS, _SCANNED, _RES, _topology_descriptions, TOPOLOGY_SCHEMA
from fleetspark.plans.tables import BASE_ADDRESS, table
from fleetspark.session import documents_for
from fleetspark.sources.rdf import local_triples, read_rdf, write_rdf_documents
from fleetspark.streaming.sources import shared_path

REGION_PATTERNS = [("?node", "type", "Node"), ("?node", "inDomain", "?dom"), ("?dom", "inRegion", "?reg"),
                   ("?reg", "label_ID", "?rname")]
IMAGE_PATTERNS = [("?node", "type", "Node"), ("?node", "diskImage", "?image"), ("?image", "hasURL", "?url")]
IMAGE_OPTIONAL = [("?node", "inDomain", "?domain"), ("?node", "label_ID", "?ip")]

PLACES_SCHEMA = T.StructType([
    T.StructField("_rdf:about", T.StringType()),
    T.StructField("rdf:type", _RES),
    T.StructField("topology:inDomain", T.ArrayType(_RES)),
    T.StructField("topology:inRegion", _RES),
    T.StructField("topology:diskImage", T.ArrayType(_RES)),
    T.StructField("topology:hasURL", T.StringType()),
    T.StructField("layer:label_ID", T.StringType()),
])


def _place_descriptions(spark, d):
    """Nodes with an image (two, if the key is a multiple of 10), a domain where the balance is not negative
    and an address where the key is even; each nation's domain in its region; each image with its URL."""
    xmlns = " ".join(f'xmlns:{k}="{v}"' for k, v in NS.items())

    def request(nation):
        return F.concat(F.lit("http://fleet.example/req-"), nation.cast("string"), F.lit("#"))

    def about(base, name, *body):
        return F.concat(F.lit(f'<rdf:Description {xmlns} rdf:about="'), base, name, F.lit('">'), *body,
                        F.lit("</rdf:Description>"))

    def refer(predicate, base, name):
        return F.concat(F.lit(f'<{predicate} rdf:resource="'), base, name, F.lit('"/>'))

    c = table(spark, d, "customer")
    base, nation = request(F.col("c_nationkey")), F.col("c_nationkey").cast("string")
    segment = F.lower("c_mktsegment")
    nodes = c.select(about(
        base, F.concat(F.lit("node-"), F.col("c_custkey").cast("string")),
        F.lit(f'<rdf:type rdf:resource="{NS["topology"]}Node"/>'),
        F.when(F.col("c_acctbal") >= 0, refer("topology:inDomain", base, F.concat(F.lit("dom-"), nation))).otherwise(""),
        refer("topology:diskImage", base, F.concat(F.lit("img-"), segment)),
        F.when(F.col("c_custkey") % 10 == 0, refer("topology:diskImage", base, F.lit("img-spare"))).otherwise(""),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(
            F.lit("<layer:label_ID>"), num_to_ip(F.lit(BASE_ADDRESS) + F.col("c_custkey")), F.lit("</layer:label_ID>"))).otherwise(""),
    ).alias("value"))
    segments = c.select("c_nationkey", segment.alias("seg")).unionByName(
        c.select("c_nationkey", F.lit("spare").alias("seg"))).distinct()
    images = segments.select(about(
        base, F.concat(F.lit("img-"), F.col("seg")),
        F.concat(F.lit("<topology:hasURL>http://images.example/"), F.col("seg"), F.lit(".tgz</topology:hasURL>"))).alias("value"))
    nr = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at, region = request(F.col("n_nationkey")), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string"))
    places = nr.select(F.concat(
        about(at, F.concat(F.lit("dom-"), F.col("n_nationkey").cast("string")), refer("topology:inRegion", at, region)),
        about(at, region, F.lit("<layer:label_ID>"), F.col("r_name"), F.lit("</layer:label_ID>"))).alias("value"))
    return nodes.unionByName(images).unionByName(places)


def _scanned(spark, d, describe, schema):
    """Requests written as RDF/XML and scanned (S1) into a stored table of local triples."""
    path = shared_path(spark, "rdf-stars")
    described = describe(spark, d)
    write_rdf_documents(described, path, documents_for(described), F.col("value"), NS)
    return write_once(local_triples(read_rdf(spark, path, schema=schema, request_from="subject", recursive=True)), "triples")


def star_regions(spark, d):
    """Node -> domain -> region -> label as three stars over scanned triples."""
    return match_stars(_scanned(spark, d, _place_descriptions, PLACES_SCHEMA), REGION_PATTERNS).select(
        "request_id", "node", "dom", "reg", "rname")


def star_images(spark, d):
    """Node -> image -> URL with domain and address optional, as two stars over scanned triples."""
    return match_stars(_scanned(spark, d, _place_descriptions, PLACES_SCHEMA), IMAGE_PATTERNS, IMAGE_OPTIONAL).select(
        "request_id", "node", "image", "url", "domain", "ip")


def star_node_ip(spark, d):
    """The address of every node on every link it has an interface on, by stars (S1, J2); a link's interfaces
    may be many, so they are joined rather than gathered."""
    return match_stars(_scanned(spark, d, _topology_descriptions, TOPOLOGY_SCHEMA), NODE_IP_PATTERNS).select(
        "request_id", "node", "link", "ip")


QUERIES = {"star_regions": star_regions, "star_images": star_images, "star_node_ip": star_node_ip}

ORACLE = {
    "star_regions": """
SELECT 'req-' || CAST(c_nationkey AS VARCHAR) AS request_id, 'node-' || CAST(c_custkey AS VARCHAR) AS node,
       'dom-' || CAST(c_nationkey AS VARCHAR) AS dom, 'region-' || CAST(n_regionkey AS VARCHAR) AS reg, r_name AS rname
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE c_acctbal >= 0""",
    "star_images": """
WITH i AS (SELECT *, lower(c_mktsegment) AS seg FROM customer
           UNION ALL SELECT *, 'spare' FROM customer WHERE c_custkey % 10 = 0)
SELECT 'req-' || CAST(c_nationkey AS VARCHAR) AS request_id, 'node-' || CAST(c_custkey AS VARCHAR) AS node,
       'img-' || seg AS image, 'http://images.example/' || seg || '.tgz' AS url,
       CASE WHEN c_acctbal >= 0 THEN 'dom-' || CAST(c_nationkey AS VARCHAR) END AS domain,
       CASE WHEN c_custkey % 2 = 0 THEN concat_ws('.', ((2886729728 + c_custkey) >> 24) & 255, ((2886729728 + c_custkey) >> 16) & 255,
            ((2886729728 + c_custkey) >> 8) & 255, (2886729728 + c_custkey) & 255) END AS ip
FROM i""",
    "star_node_ip": f"WITH {_SCANNED} SELECT request_id, node, link, ip FROM ips",
}
