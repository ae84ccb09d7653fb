"""Loading the driver tables and the stand-in shapes derived from them.

Stand-ins only reshape driver rows into the schema an operator expects
(FIXTURES.md §A); they do none of the operator's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.operators.sizing import spread


TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the build plan: addresses are 172.16.0.0 + id, destination
# ports are picked from this list by event id.
BASE_ADDRESS = 2886729728  # 172.16.0.0
PORTS = [22, 80, 443, 8080, 50070]


# Text tables are spread by default: every query on them does per-row regex or
# split work.  Other tables are spread only when a query asks (its per-row work
# is heavy); for light projections an extra round-robin shuffle costs more than
# it saves.
_TEXT_TABLES = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool | None = None) -> DataFrame:
    """A driver table.  With ``spread_rows`` (default: text tables only) a scan
    with fewer splits than cores is spread (see ``sizing.spread``)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    want = (name in _TEXT_TABLES) if spread_rows is None else spread_rows
    df = spark.read.parquet(path)
    return spread(df) if want else df


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection records (FIXTURES ``flows``) reshaped from ``events``."""
    return flows_from_events(table(spark, sf_dir, "events"))


def flows_from_events(e: DataFrame) -> DataFrame:
    """src = 172.16.0.0 + user_id; dport by event id from PORTS; the interface,
    state and TCP flags are read off the event type and value (batch or stream)."""
    iface = (F.when(F.col("event_type") == "signup", "eth1")
             .when((F.col("event_type") == "error") & (F.col("value") < 25), "lo").otherwise("eth0"))
    dst = F.when(F.col("event_type") == "error", F.lit(2130706433)).otherwise(
        F.lit(BASE_ADDRESS) + F.col("user_id"))  # errors go to 127.0.0.1, some from outside the loopback
    state = F.when(F.col("event_type") == "purchase", "ESTABLISHED").otherwise("NEW")
    flags = (F.when(F.col("value") < 1, "NONE").when(F.col("value") > 49, "ALL")
             .when(F.col("value") > 25, "SYN").otherwise("ACK"))
    return e.select(
        F.col("event_id").alias("flow_id"),
        "ts",
        F.lit("INPUT").alias("chain"),
        iface.alias("iface"),
        F.lit("tcp").alias("proto"),
        (F.lit(BASE_ADDRESS) + F.col("user_id")).alias("src"),
        dst.alias("dst"),
        F.element_at(F.array(*[F.lit(p) for p in PORTS]),
                     (F.col("event_id") % len(PORTS) + 1).cast("int")).alias("dport"),
        state.alias("state"),
        flags.alias("tcp_flags"),
        (flags == "SYN").alias("syn"),
    )


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines(file, line_no, line)`` from ``documents`` (whole texts)."""
    from fleetspark.operators.lines import to_lines
    d = table(spark, sf_dir, "documents")
    return to_lines(d, "text", ["doc_id"])
