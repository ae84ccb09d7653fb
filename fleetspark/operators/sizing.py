"""Size checks in front of every explicit broadcast.

A side is broadcast only after a bounded probe (an aggregated count) proves
it has at most ``n`` rows; otherwise the caller takes its shuffle path.  AQE
may still turn a shuffle join into a broadcast at run time from real sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default row bound for a broadcast side (dimension / rule / prefix tables).
DEFAULT_BROADCAST_ROWS = 2_000_000


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """One aggregated count: a task sends one number, where ``limit`` would send its rows to one task."""
    return df.count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    if has_at_most(df, max_rows):
        return F.broadcast(df), True
    return df, False


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan that came up with fewer partitions than the cluster has
    cores (a single small file is one task), so row-local CPU work runs in
    parallel.  A large input already has more splits than cores and is
    returned unchanged, so no shuffle is added at scale."""
    from fleetspark.session import parallelism
    target = min_partitions or parallelism(df.sparkSession)
    try:
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (remote session): leave as is
        return df
    return df.repartition(target) if n < target else df


def collect_bounded(df: DataFrame, max_rows: int, what: str = "table") -> list:
    """Collect a small side in one job, failing loudly if it has more than ``max_rows`` rows."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; use the distributed path")
    return rows


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder under the shared checkpoint folder and read back, for plans that use it several times."""
    from fleetspark.streaming.sources import shared_path
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
