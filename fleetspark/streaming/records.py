"""Broker records (S10): decoding, dead letters and a sink that a replay does not fill twice.

A record has the columns of Spark's Kafka source: ``key`` and ``value`` (binary), ``topic``, ``partition``,
``offset`` and ``timestamp``.  (``topic``, ``partition``, ``offset``) names it for good.  The same functions
work on a batch frame and on a stream; nothing here needs the connector.

``decode`` reads ``value`` as JSON against a schema and says why a record could not be read:

* ``tombstone``: the value is null
* ``encoding``: the value is no valid UTF-8
* ``malformed``: no JSON object, or a field of another type (text after the object is not read)
* ``missing <field>``: a required field is absent or null (the first one, in the order given)

``OffsetSink`` is a ``foreachBatch`` target.  Each batch writes its rows to a folder of its own and then its
offset ranges to a log; only folders that the log names are read, so a batch that died in between leaves
nothing behind.  A batch whose ranges touch no logged range is written as it is.  One that does (a stream
restarted without its checkpoint, or a topic read again) is first anti-joined by (topic, partition, offset)
with the batches it touches, and with those only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_ID = ["topic", "partition", "offset"]
RANGE_SCHEMA = "batch string, topic string, partition int, first long, last long"
# Written with all six digits: the default pattern of to_json keeps milliseconds only.
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def encode(rows: DataFrame, key: Column | str, columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``key`` and ``value`` as a Kafka sink takes them: the columns as one JSON object."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.withColumns({"key": F.to_binary(key.cast("string"), F.lit("utf-8")), "value": F.to_binary(
        F.to_json(F.struct(*columns), {**JSON_OPTIONS, "ignoreNullFields": "false"}), F.lit("utf-8"))})


def decode(records: DataFrame, schema: T.StructType | str, required: Sequence[str] = ()) -> DataFrame:
    """``records`` with ``decoded`` (a struct of ``schema``, null if not read) and ``reason`` (null if read)."""
    schema = _schema(schema)
    corrupt = "_corrupt"
    while corrupt in schema.names:
        corrupt += "_"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    text = F.when(F.is_valid_utf8(F.col("value").cast("string")), F.col("value").cast("string"))
    parsed = F.from_json(text, full, {**JSON_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    out = records.withColumn("_text", text).withColumn("_parsed", parsed)
    # a blank text gives a null struct, "null" and arrays a struct of nulls
    unread = F.col("_parsed").isNull() | F.col(f"_parsed.{corrupt}").isNotNull() | ~F.col("_text").rlike(r"^\s*\{")
    reason = (F.when(F.col("value").isNull(), "tombstone").when(F.col("_text").isNull(), "encoding")
              .when(unread, "malformed"))
    for name in required:
        reason = reason.when(F.col("_parsed")[name].isNull(), f"missing {name}")
    out = out.withColumn("reason", reason)
    fields = F.struct(*[F.col("_parsed")[f.name].alias(f.name) for f in schema.fields])
    return out.withColumn("decoded", F.when(F.col("reason").isNull(), fields)).drop("_text", "_parsed")


def good_rows(decoded: DataFrame) -> DataFrame:
    """The records that were read: their identity and the fields of the schema.

    A field named like a part of the identity is ``value_<name>``."""
    names = decoded.schema["decoded"].dataType.names
    fields = [F.col("decoded")[n].alias(f"value_{n}" if n in RECORD_ID else n) for n in names]
    return decoded.where(F.col("reason").isNull()).select(*RECORD_ID, *fields)


def dead_letters(decoded: DataFrame) -> DataFrame:
    """The records that were not: identity, reason, and key and value as they came."""
    return decoded.where(F.col("reason").isNotNull()).select(*RECORD_ID, "reason", "key", "value")


class OffsetSink:
    """Rows with ``topic``, ``partition``, ``offset`` under ``path``, each record once.

    ``writer`` names the checkpoint that numbers the batches: the same writer and batch number overwrite
    their own folder, as a restarted batch must.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, writer: str):
        self.spark, self.schema, self.writer = spark, schema, writer
        self.rows, self.log = f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/log"

    def _logged(self) -> DataFrame:
        try:
            return self.spark.read.schema(RANGE_SCHEMA).parquet(f"{self.log}/*")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc.getCondition()):
                raise
            return self.spark.createDataFrame([], RANGE_SCHEMA)

    def _folder(self, batch: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.rows}/{batch}")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The target of ``foreachBatch``."""
        batch = f"{self.writer}-{batch_id:012d}"
        rows = rows.select(*self.schema.names).dropDuplicates(RECORD_ID)
        final = f"{batch}-new"  # for what is left of a batch that touches earlier ones
        earlier = self._logged().where(~F.col("batch").isin(batch, final))  # its own, if this is a second attempt
        # written first, so that ranges and rows are of one evaluation
        rows.write.mode("overwrite").parquet(f"{self.rows}/{batch}")
        written = self._folder(batch)
        ranges = written.groupBy("topic", "partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
        touched = [r["batch"] for r in ranges.alias("n").join(earlier.alias("e"), [
            F.col("n.topic") == F.col("e.topic"), F.col("n.partition") == F.col("e.partition"),
            F.col("n.first") <= F.col("e.last"), F.col("e.first") <= F.col("n.last")]).select("batch").distinct().collect()]
        if touched:
            known = self._folder(touched[0])
            for other in touched[1:]:
                known = known.unionByName(self._folder(other))
            written.join(known.select(*RECORD_ID), RECORD_ID, "left_anti").write.mode("overwrite").parquet(f"{self.rows}/{final}")
            ranges = self._folder(final).groupBy("topic", "partition").agg(
                F.min("offset").alias("first"), F.max("offset").alias("last"))
        ranges.select(F.lit(final if touched else batch).alias("batch"), "topic", "partition", "first", "last").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.log}/{batch}")

    def read(self) -> DataFrame:
        """The rows of every logged batch."""
        batches = sorted(r["batch"] for r in self._logged().select("batch").distinct().collect())
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.rows}/{b}" for b in batches])


def run_records(stream: DataFrame, schema: T.StructType | str, required: Sequence[str], path: str,
                checkpoint: str, writer: str) -> tuple[OffsetSink, OffsetSink]:
    """Decode all records available now into a sink of good rows and one of dead letters, batch by batch.

    Run again with the same ``checkpoint`` and ``writer`` it goes on where it stopped; with others over the
    same ``path`` it adds only records that are not there yet.
    """
    spark = stream.sparkSession
    shape = decode(stream, schema, required)
    good = OffsetSink(spark, f"{path}/good", good_rows(shape).schema, writer)
    dead = OffsetSink(spark, f"{path}/dead", dead_letters(shape).schema, writer)

    def both(batch: DataFrame, batch_id: int) -> None:
        # read and decoded once for both sinks; key and value go on with dead letters only
        lost = F.col("reason").isNotNull()
        decoded = decode(batch, schema, required).select(
            *RECORD_ID, "reason", "decoded", *[F.when(lost, F.col(c)).alias(c) for c in ("key", "value")])
        decoded = decoded.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good.write(good_rows(decoded), batch_id)
            dead.write(dead_letters(decoded), batch_id)
        finally:
            decoded.unpersist()

    query = (stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return good, dead
