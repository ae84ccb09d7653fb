"""Broker records (S10): ``events`` as records with binary values, some of them bad, streamed over several
batches into a sink of decoded rows and one of dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.operators.ranking import row_number_within
from fleetspark.plans.tables import table
from fleetspark.session import parallelism
from fleetspark.streaming.records import encode, run_records
from fleetspark.streaming.sources import read_event_stream, shared_path

TOPIC = "events"
BROKERS = 3
REQUIRED = ["event_id", "user_id"]


def _event_records(spark, d):
    """A record per event, offsets by time within a partition; tombstones, cut and mis-encoded values and
    objects without their user among them.  Returns the folder of the records, their schema and the events' one."""
    e = table(spark, d, "events")
    keyed = e.withColumn("_small", F.col("value") < 1).withColumn("partition", F.pmod("user_id", F.lit(BROKERS)).cast("int"))
    numbered = row_number_within(keyed, ["partition"], ["ts", "event_id"], "_n")
    small = F.col("_small")
    no_user = (F.col("event_type") == "view") & small
    named = numbered.withColumn("_key", F.col("user_id")).withColumn("user_id", F.when(~no_user, F.col("user_id")))
    value, n = F.col("value_sent"), F.length("value_sent")
    records = encode(named, "_key", e.columns).withColumnRenamed("value", "value_sent").select(
        "key", F.when((F.col("event_type") == "signup") & (F.col("_key") % 10 == 0), F.lit(None))
        .when((F.col("event_type") == "error") & small, F.substring(value, F.lit(1), n - 1))
        .when((F.col("event_type") == "click") & small, F.concat(F.to_binary(F.lit("FF"), F.lit("hex")), value))
        .otherwise(value).alias("value"),
        F.lit(TOPIC).alias("topic"), "partition", (F.col("_n") - 1).alias("offset"), F.col("ts").alias("timestamp"))
    path = shared_path(spark, "records")
    # two batches, each with a file per core
    records.repartition(2 * parallelism(spark)).write.parquet(path)
    return path, records.schema, e.schema


def _sinks(spark, d):
    path, shape, events = _event_records(spark, d)
    stream = read_event_stream(spark, path, schema=shape, max_files_per_trigger=parallelism(spark))
    return run_records(stream, events, REQUIRED, shared_path(spark, "records-sink"),
                       shared_path(spark, "records-ckpt"), "first")


def stream_records(spark, d):
    """The decoded events of all batches, each record once, with its partition and offset."""
    return _sinks(spark, d)[0].read().drop("topic")


def stream_dead_letters(spark, d):
    """The records that could not be read and why, by partition and offset."""
    return _sinks(spark, d)[1].read().select("partition", "offset", "reason", F.col("key").cast("string").alias("key"))


QUERIES = {"stream_records": stream_records, "stream_dead_letters": stream_dead_letters}

_RECORDS = """r AS (
  SELECT *, CAST(user_id % 3 AS INTEGER) AS "partition",
         row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1 AS "offset",
         CASE WHEN event_type = 'signup' AND user_id % 10 = 0 THEN 'tombstone'
              WHEN event_type = 'error' AND value < 1 THEN 'malformed'
              WHEN event_type = 'click' AND value < 1 THEN 'encoding'
              WHEN event_type = 'view' AND value < 1 THEN 'missing user_id' END AS reason
  FROM events)"""

ORACLE = {
    "stream_records": f"""WITH {_RECORDS}
SELECT "partition", "offset", event_id, ts, user_id, event_type, value, props FROM r WHERE reason IS NULL""",
    "stream_dead_letters": f"""WITH {_RECORDS}
SELECT "partition", "offset", reason, CAST(user_id AS VARCHAR) AS key FROM r WHERE reason IS NOT NULL""",
}
