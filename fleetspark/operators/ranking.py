"""Skew-safe ordering inside groups.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group to
one task, so a group holding a third of the data is a third of the job on one
core.  ``distributed_row_number`` gives the same numbers without that:

1. ``repartitionByRange(g, o)`` sorts globally, once: the ranged rows are written; its sampled bounds split a hot
   group over many partitions, and each partition holds a contiguous slice
   of the (g, o) order;
2. inside a partition, ``monotonically_increasing_id`` follows the sorted rows,
   so a row's position inside its (group, partition) chunk is its id minus
   the chunk's first id;
3. chunk sizes per (group, partition) are a small table (at most groups +
   partitions rows); a running sum over each group's chunks gives the offset
   of every chunk, joined back by (group, partition).

``distributed_running_sum`` uses the same chunks for running totals (W4), and
``ordered_list_chunks`` for A2: one string per (group, chunk), bounded by the
partition size, numbered in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def _chunked(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, n_partitions: int | None):
    from fleetspark.session import parallelism
    from fleetspark.streaming.sources import shared_path
    n = n_partitions or max(2, 2 * parallelism(df.sparkSession))
    keys = [*_cols(group_cols), *_cols(order_cols)]
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    # Written once: the range bounds are sampled, so a second evaluation (pruned to other
    # columns, or after a lost executor) could cut elsewhere and disagree on the chunk ids.
    path = shared_path(df.sparkSession, "ranking")
    ranged.write.parquet(path)
    s = df.sparkSession.read.schema(ranged.schema).parquet(path)
    chunks = s.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    return s, chunks


def _join_chunks(rows: DataFrame, chunks: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Rows with their chunk's columns; null groups are groups too."""
    named = chunks.withColumnsRenamed({c: f"_c_{c}" for c in [*group_cols, "_pid"]})
    same = F.col("_pid") == F.col("_c__pid")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return rows.join(named, same, "inner").drop(*[f"_c_{c}" for c in [*group_cols, "_pid"]])


def distributed_row_number(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                           out_col: str = "rn", n_partitions: int | None = None) -> DataFrame:
    """``row_number()`` within each group in the given order, without putting a
    group in one task.  ``order_cols`` must make the order total.

    The chunk-offset table is joined back without a hint: it is known only after
    its stage runs, and AQE broadcasts it then if its real size is small (a
    probe here would recompute the range shuffle just to count)."""
    s, chunks = _chunked(df, group_cols, order_cols, n_partitions)
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    out = _join_chunks(s, offsets, group_cols)
    rn = (F.col("_off") + (F.col("_mid") - F.col("_first")) + 1).cast("bigint")
    return out.withColumn(out_col, rn).drop("_pid", "_mid", "_first", "_off")


def distributed_running_sum(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, value_col: str,
                            out_col: str = "running", n_partitions: int | None = None) -> DataFrame:
    """``sum(value) OVER (PARTITION BY g ORDER BY o ROWS UNBOUNDED PRECEDING)``
    without a group in one task: a running sum inside each (group, range
    partition) chunk plus the total of the group's earlier chunks.
    ``order_cols`` must make the order total."""
    s, _ = _chunked(df, group_cols, order_cols, n_partitions)
    totals = s.groupBy(*group_cols, "_pid").agg(F.sum(value_col).alias("_t"))
    wo = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(wo), F.lit(0))).drop("_t")
    wi = Window.partitionBy(*group_cols, "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    inner = s.withColumn("_in", F.sum(value_col).over(wi))
    out = _join_chunks(inner, offsets, group_cols)
    return out.withColumn(out_col, F.col("_off") + F.col("_in")).drop("_pid", "_mid", "_off", "_in")


def ordered_list_chunks(df: DataFrame, group_cols: Sequence[str], value: Column, order: Sequence,
                        sep: str = ",", out_col: str = "members", chunk_col: str = "chunk",
                        n_partitions: int | None = None) -> DataFrame:
    """A2 for groups of any size: the ordered, ``sep``-joined member list of each
    group as consecutive chunks (``chunk`` 0, 1, ...); joining a group's chunks
    in order with ``sep`` gives the whole list.  Each chunk is built in one
    task from one range partition, so no task holds a whole hot group."""
    d = df.select(*group_cols, value.alias("_v"), *[c.alias(f"_o{i}") if isinstance(c, Column) else F.col(c).alias(
        f"_o{i}") for i, c in enumerate(order)])
    ocols = [f"_o{i}" for i in range(len(order))]
    s, _ = _chunked(d, group_cols, [*ocols, "_v"], n_partitions)
    per = s.groupBy(*group_cols, "_pid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_mid"), F.col("_v")))),
                                 lambda x: x["_v"]), sep).alias(out_col))
    w = Window.partitionBy(*group_cols).orderBy("_pid")
    return per.withColumn(chunk_col, (F.row_number().over(w) - 1).cast("int")).drop("_pid")


# A group up to this many rows is ordered comfortably by one task.
DEFAULT_MAX_GROUP_ROWS = 1_000_000


def largest_group(df: DataFrame, group_cols: Sequence[str]) -> int:
    """Row count of the biggest group (one partially-aggregated job, one number back)."""
    row = df.groupBy(*group_cols).count().agg(F.max("count").alias("m")).first()
    return int(row["m"] or 0)


def row_number_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, out_col: str = "rn",
                      skew_safe: bool | str = "auto", max_group_rows: int = DEFAULT_MAX_GROUP_ROWS) -> DataFrame:
    """``row_number()`` per group: a plain window when every group is provably
    small, else :func:`distributed_row_number`.  ``skew_safe`` forces either."""
    if skew_safe == "auto":
        skew_safe = largest_group(df, group_cols) > max_group_rows
    if skew_safe:
        return distributed_row_number(df, group_cols, order_cols, out_col)
    w = Window.partitionBy(*group_cols).orderBy(*_cols(order_cols))
    return df.withColumn(out_col, F.row_number().over(w).cast("bigint"))


def running_sum_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, value_col: str,
                       out_col: str = "running", skew_safe: bool | str = "auto",
                       max_group_rows: int = DEFAULT_MAX_GROUP_ROWS) -> DataFrame:
    """Running sum per group in order: a plain window when every group is
    provably small, else :func:`distributed_running_sum`."""
    if skew_safe == "auto":
        skew_safe = largest_group(df, group_cols) > max_group_rows
    if skew_safe:
        return distributed_running_sum(df, group_cols, order_cols, value_col, out_col)
    w = Window.partitionBy(*group_cols).orderBy(*_cols(order_cols)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out_col, F.sum(value_col).over(w))
