"""Event stream source / sink options (S10) and batch sinks.

Brokers are provisioned with one partition per topic; the Kafka connector is
an optional jar.  When it is absent the same jobs read a directory of files as
a stream.  Paths are URIs (``hdfs://…``, ``s3a://…``, ``file:``) handed to
Spark unchanged, so storage location is configuration, not code.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetspark.session import checkpoint_dir


def read_event_stream(spark: SparkSession, path: str | None = None, schema=None, fmt: str = "parquet",
                      bootstrap: str | None = None, topic: str | None = None,
                      max_files_per_trigger: int | None = None, file_glob: str | None = None,
                      spread_to: int | None = None) -> DataFrame:
    """A streaming DataFrame of events from Kafka (``fmt='kafka'``) or from files.

    ``spread_to``: a topic with one partition (the brokers' default) or a
    single file would make every micro-batch one task; Kafka splits its offset
    ranges over ``minPartitions`` tasks, a file stream is round-robined.
    """
    if fmt == "kafka":
        reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
                  .option("subscribe", topic).option("startingOffsets", "earliest"))
        if spread_to:
            reader = reader.option("minPartitions", spread_to)
        try:
            return reader.load()
        except Exception as exc:  # connector jar not on the classpath
            raise RuntimeError("Kafka source needs the spark-sql-kafka connector on the classpath") from exc
    reader = spark.readStream.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:  # a file stream source watches a folder; keep only matching files
        reader = reader.option("pathGlobFilter", file_glob)
    df = reader.load(path)
    return df.repartition(spread_to) if spread_to else df


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None, fmt: str = "parquet") -> None:
    """``cat > F`` (overwrite) or ``>> F`` (append, duplicates kept) for a table."""
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be overwrite or append")
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def run_available(stream: DataFrame, name: str, output_mode: str = "append",
                  state_partitions: int | None = None) -> DataFrame:
    """Run a streaming query over everything available now and return its
    output as a batch DataFrame read back from a parquet sink (with a
    checkpoint in the shared folder, so a restarted run resumes exactly once).

    ``state_partitions`` fixes the number of state-store partitions of the
    query's stateful operators (recorded in its checkpoint at the first batch)
    instead of inheriting the batch shuffle setting."""
    spark = stream.sparkSession
    out = shared_path(spark, f"{name}-out")
    ckpt = shared_path(spark, f"{name}-ckpt")
    key = "spark.sql.shuffle.partitions"
    prev = spark.conf.get(key)
    if state_partitions:
        spark.conf.set(key, str(state_partitions))
    try:
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode(output_mode).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(key, prev)
    return spark.read.schema(stream.schema).parquet(out)
