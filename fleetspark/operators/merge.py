"""Directory merges by file name: newer wins (U2, ``cp --update``) and source
always wins (U3, ``cp --force``).

Both are one ``groupBy(name)`` with ``max_by`` over a union of the two sides,
so they partially aggregate before the shuffle (no join, no hot reducer).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tagged(src: DataFrame, dst: DataFrame, cols: Sequence[str]) -> DataFrame:
    return (src.select(*cols).withColumn("side", F.lit("source")).withColumn("_is_target", F.lit(0))
            .unionByName(dst.select(*cols).withColumn("side", F.lit("target")).withColumn("_is_target", F.lit(1))))


def newer_wins(src: DataFrame, dst: DataFrame, name_col: str = "name", mtime_col: str = "mtime",
               value_cols: Sequence[str] = ("content",)) -> DataFrame:
    """Per name keep the newer file; equal times keep the target; one-sided names stay.

    Of rows that repeat a name, time and side the one with the greatest values stays."""
    cols = [name_col, mtime_col, *value_cols]
    u = _tagged(src, dst, cols)
    keep = F.struct(*[F.col(c) for c in [mtime_col, *value_cols, "side"]])
    order = F.struct(F.col(mtime_col), F.col("_is_target"), *[F.col(c) for c in value_cols])
    out = u.groupBy(name_col).agg(F.max_by(keep, order).alias("_w"))
    return out.select(name_col, *[F.col("_w")[c].alias(c) for c in [mtime_col, *value_cols, "side"]])


def force_merge(src: DataFrame, dst: DataFrame, name_col: str = "name", mtime_col: str = "mtime",
                value_cols: Sequence[str] = ("content",)) -> DataFrame:
    """Per name the source file whenever it exists, else the target (U3); of rows that repeat a name and side the latest."""
    cols = [name_col, mtime_col, *value_cols]
    u = _tagged(src, dst, cols)
    keep = F.struct(*[F.col(c) for c in [mtime_col, *value_cols, "side"]])
    out = u.groupBy(name_col).agg(F.max_by(keep, F.struct(
        -F.col("_is_target"), F.col(mtime_col), *[F.col(c) for c in value_cols])).alias("_w"))
    return out.select(name_col, *[F.col("_w")[c].alias(c) for c in [mtime_col, *value_cols, "side"]])
