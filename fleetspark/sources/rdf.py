"""RDF/XML request scan into a long ``triples`` table.

Spark's XML source reads one row per ``rdf:Description`` with every value kept
as text (``inferSchema=false``); the schema walk below runs on the driver over
*metadata only* and builds one ``inline`` expression that turns each
description into (predicate, object) rows: repeated predicates give several
rows, ``rdf:resource`` objects are kind ``uri``, text objects kind ``literal``
with their ``rdf:datatype``.  XML entities are already unescaped by the parser.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABOUT = "_rdf:about"
RESOURCE = "_rdf:resource"
DATATYPE = "_rdf:datatype"
VALUE = "_VALUE"

TRIPLE_FIELDS = ["predicate", "object", "object_kind", "datatype"]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _entry(pred: str, c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        names = {f.name for f in dtype.fields}
        res = c.getField(RESOURCE) if RESOURCE in names else F.lit(None).cast("string")
        val = c.getField(VALUE).cast("string") if VALUE in names else F.lit(None).cast("string")
        dt = c.getField(DATATYPE) if DATATYPE in names else F.lit(None).cast("string")
        return F.struct(F.lit(pred).alias("predicate"), F.coalesce(res, val).alias("object"),
                        F.when(res.isNotNull(), "uri").otherwise("literal").alias("object_kind"),
                        F.when(res.isNull(), dt).alias("datatype"))
    return F.struct(F.lit(pred).alias("predicate"), c.cast("string").alias("object"),
                    F.lit("literal").alias("object_kind"), F.lit(None).cast("string").alias("datatype"))


def descriptions_to_triples(df: DataFrame, request_col: str = "request_id") -> DataFrame:
    """Rows of ``rdf:Description`` (as the XML source gives them) -> triples."""
    arrays = []
    for f in df.schema.fields:
        if f.name in (ABOUT, request_col) or f.name.startswith("_"):
            continue
        c = F.col(_q(f.name))
        if isinstance(f.dataType, T.ArrayType):
            et = f.dataType.elementType
            arr = F.transform(c, _make_entry(f.name, et))
        else:
            arr = F.when(c.isNotNull(), F.array(_entry(f.name, c, f.dataType)))
        arrays.append(F.coalesce(arr, F.array().cast(T.ArrayType(_ENTRY_TYPE))))
    if not arrays:
        return df.sparkSession.createDataFrame([], TRIPLES_SCHEMA)
    out = df.select(F.col(request_col), F.col(_q(ABOUT)).alias("subject"),
                    F.inline(F.flatten(F.array(*arrays))))
    return out.where(F.col("object").isNotNull()).select(request_col, "subject", *TRIPLE_FIELDS)


def _make_entry(name: str, et: T.DataType):
    return lambda e: _entry(name, e, et)


_ENTRY_TYPE = T.StructType([T.StructField("predicate", T.StringType()), T.StructField("object", T.StringType()),
                            T.StructField("object_kind", T.StringType()), T.StructField("datatype", T.StringType())])

TRIPLES_SCHEMA = T.StructType([T.StructField("request_id", T.StringType()),
                              T.StructField("subject", T.StringType())] + list(_ENTRY_TYPE.fields))


def read_rdf(spark: SparkSession, paths: str | Sequence[str], request_col: str = "request_id",
             schema: T.StructType | None = None, request_from: str = "file",
             recursive: bool = False) -> DataFrame:
    """Scan RDF/XML request files into ``triples(request_id, subject, predicate,
    object, object_kind, datatype)``.

    ``schema``: the description layout (``_rdf:about`` plus one field per
    predicate); give it for large inputs, otherwise the XML source infers it
    with a full pass.  ``request_from``: ``"file"`` takes the request id from
    the file's base name, ``"subject"`` from the subject URI before ``#``.
    ``recursive`` reads every file under the folders (no partition columns).
    """
    reader = spark.read.format("xml").option("rowTag", "rdf:Description")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", False).option("samplingRatio", 1.0)
    df = reader.load(paths)
    if request_from == "subject":
        rid = F.regexp_extract(F.substring_index(F.col(_q(ABOUT)), "#", 1), r"([^/]+)$", 1)
    else:
        rid = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.rdf)?$", 1)
    return descriptions_to_triples(df.withColumn(request_col, rid), request_col)


def xml_escape(c) -> Column:
    """Text for an XML element body or attribute value."""
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def local_name(uri) -> Column:
    """Fragment of a URI, percent / plus decoded (F12): ``…#Hadoop+2.7.1+%28Centos7%29`` -> ``Hadoop 2.7.1 (Centos7)``."""
    c = F.col(uri) if isinstance(uri, str) else uri
    return F.when(F.instr(c, "#") > 0, F.try_url_decode(F.substring_index(c, "#", -1))).otherwise(c)


def write_rdf_documents(descriptions: DataFrame, path: str, n_docs: int, key: Column,
                        namespaces: dict[str, str]) -> None:
    """Write ``rdf:Description`` strings (column ``value``) as ``n_docs`` RDF/XML
    documents, each with exactly one ``rdf:RDF`` root (the XML source needs one
    root per file).  Rows are hashed to a document by ``key``; header and footer
    rows are sorted around each document's descriptions in its own task."""
    spark = descriptions.sparkSession
    xmlns = " ".join(f'xmlns:{k}="{v}"' for k, v in namespaces.items())
    body = descriptions.select(F.pmod(F.xxhash64(key), F.lit(n_docs)).cast("int").alias("doc"),
                               F.lit(1).alias("seq"), F.col("value"))
    docs = spark.range(n_docs).select(F.col("id").cast("int").alias("doc"))
    head = docs.select("doc", F.lit(0).alias("seq"), F.lit(f"<rdf:RDF {xmlns}>").alias("value"))
    foot = docs.select("doc", F.lit(2).alias("seq"), F.lit("</rdf:RDF>").alias("value"))
    out = (body.unionByName(head).unionByName(foot)
           .repartition(n_docs, "doc").sortWithinPartitions("doc", "seq").select("doc", "value"))
    out.write.mode("overwrite").partitionBy("doc").text(path)


def local_triples(triples: DataFrame) -> DataFrame:
    """Triples with local names: subject and URI objects reduced to their
    decoded fragment (F12), predicates to the part after the prefix
    (``topology:hasInterface`` -> ``hasInterface``)."""
    obj = F.when(F.col("object_kind") == "uri", local_name(F.col("object"))).otherwise(F.col("object"))
    return triples.select("request_id", local_name(F.col("subject")).alias("subject"),
                          F.substring_index(F.col("predicate"), ":", -1).alias("predicate"),
                          obj.alias("object"), "object_kind", "datatype")
