"""Overlapping ranges by a distributed sweep (J8 without listing addresses).

A range is two changes, +1 at its start and -1 after its end.  Changes at one place are summed before
anything is sorted; the running sum along the places of a group is how many ranges cover the
stretch up to the next place.  Groups of any size: where the largest group is over
``max_group_rows`` changes, places are range-partitioned and each chunk of a group gets the sum of the
chunks before it and the first place of the chunk after it from the small chunk table
(``ranking``), so no task holds a hot group.  The changes of each sweep are written once: sizing the groups and
sweeping them would each run everything before them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.operators.ranking import DEFAULT_MAX_GROUP_ROWS, _chunked, _join_chunks, largest_group
from fleetspark.operators.sizing import write_once


def range_changes(ranges: DataFrame, keys: Sequence[str], lo_col: str, hi_col: str) -> DataFrame:
    """(keys, pos, delta): net change of the cover at each place; a range with a null end or swapped ends covers nothing."""
    lo, hi = F.col(lo_col).cast("bigint"), F.col(hi_col).cast("bigint")
    two = F.array(F.struct(lo.alias("pos"), F.lit(1).cast("bigint").alias("delta")),
                  F.struct((hi + 1).alias("pos"), F.lit(-1).cast("bigint").alias("delta")))
    each = ranges.where(lo <= hi).select(*keys, F.explode(two).alias("c")).select(*keys, "c.pos", "c.delta")
    return net_changes(each, keys)


def net_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return changes.groupBy(*keys, "pos").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def stretches(changes: DataFrame, keys: Sequence[str], max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
              n_partitions: int | None = None) -> DataFrame:
    """(keys, pos, next_pos, before, depth): the cover from each place up to the next one of its group (null after the last)."""
    if largest_group(changes, keys) <= max_group_rows:
        w = Window.partitionBy(*keys).orderBy("pos")
        out = changes.withColumn("depth", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("next_pos", F.lead("pos").over(w))
    else:
        rows, _ = _chunked(changes, keys, ["pos"], n_partitions)
        of_group = Window.partitionBy(*keys).orderBy("_pid")
        chunks = rows.groupBy(*keys, "_pid").agg(F.sum("delta").alias("_sum"), F.min("pos").alias("_from"))
        chunks = chunks.select(
            *keys, "_pid", F.lead("_from").over(of_group).alias("_after"),
            F.coalesce(F.sum("_sum").over(of_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
        w = Window.partitionBy(*keys, "_pid").orderBy("_mid")
        inner = rows.withColumn("_in", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
            "_lead", F.lead("pos").over(w))
        out = _join_chunks(inner, chunks, keys).select(
            *keys, "pos", "delta", (F.col("_carry") + F.col("_in")).alias("depth"),
            F.coalesce("_lead", "_after").alias("next_pos"))
    return out.select(*keys, "pos", "next_pos", (F.col("depth") - F.col("delta")).alias("before"), "depth")


def range_overlaps(ranges: DataFrame, group_cols: Sequence[str], lo_col: str, hi_col: str, owner_col: str,
                   min_owners: int = 2, max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
                   n_partitions: int | None = None) -> DataFrame:
    """Maximal stretches that ``min_owners`` or more owners claim inside a group: first, last, n_owners.

    Both ends belong to a range.  An owner's ranges that overlap or touch count once: a first
    sweep per (group, owner) leaves the places where the owner begins and ends to cover anything, and
    these are the second sweep's changes.  A stretch ends where the number of owners changes.  A null owner or group
    is one of its own; a range with a null end or swapped ends claims nothing; repeated rows change nothing.
    """
    own = [*group_cols, owner_col]
    changes = write_once(range_changes(ranges, own, lo_col, hi_col), "range-changes")
    of_owner = stretches(changes, own, max_group_rows, n_partitions)
    edges = of_owner.where("before = 0 OR depth = 0").select(
        *group_cols, "pos", F.when(F.col("depth") > 0, 1).otherwise(-1).cast("bigint").alias("delta"))
    covered = stretches(write_once(net_changes(edges, group_cols), "owner-changes"), group_cols, max_group_rows, n_partitions)
    return covered.where(F.col("depth") >= min_owners).select(
        *group_cols, F.col("pos").alias("first"), (F.col("next_pos") - 1).alias("last"), F.col("depth").alias("n_owners"))
