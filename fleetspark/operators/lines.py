"""Ordered text lines: scan (lines table), sed-style edits that depend on the
previous line (W3), multiset drift between two copies (J9, U4), n-th from the
end (W2) and first / last k (O3).

A file's order is always explicit (``line_no`` from ``posexplode``), never the
read order.  Per-line edits (F1-F4, F8, P7, P8) are plain column expressions on
the lines table and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions.predicate import matches_glob
from fleetspark.functions.text import lines_array


def to_lines(df: DataFrame, text_col: str, key_cols: Sequence[str], line_col: str = "line",
             no_col: str = "line_no") -> DataFrame:
    """One row per line of every text, numbered from 1 (``lines(file, line_no, line)``)."""
    return df.select(*key_cols, F.posexplode(lines_array(F.col(text_col))).alias("_pos", line_col)).select(
        *key_cols, (F.col("_pos") + 1).alias(no_col), line_col)


def drop_matching(lines: DataFrame, patterns: Sequence[str], line_col: str = "line") -> DataFrame:
    """``egrep -v "(p1|p2)"``."""
    rx = "(" + "|".join(patterns) + ")"
    return lines.where(~F.coalesce(F.col(line_col).rlike(rx), F.lit(False)))


def drop_glob(df: DataFrame, name_col: str, glob: str) -> DataFrame:
    """``rm -f dir/glob``: drop names matching a shell glob."""
    return df.where(~F.coalesce(matches_glob(name_col, glob), F.lit(False)))


def keep_glob(df: DataFrame, name_col: str, glob: str) -> DataFrame:
    return df.where(F.coalesce(matches_glob(name_col, glob), F.lit(False)))


def edit_after_match(lines: DataFrame, key_cols: Sequence[str], pattern: str,
                     edit: Callable[[Column], Column], line_col: str = "line",
                     no_col: str = "line_no") -> DataFrame:
    """``sed '/pattern/!b;n;<edit>'``.

    A matching line prints and pulls in the next line, which gets the edit and is
    not tested itself.  So inside a run of adjacent matching lines the 1st, 3rd,
    ... trigger and the 2nd, 4th, ... are edited.  Adds ``edited``.
    """
    w = Window.partitionBy(*key_cols).orderBy(no_col)
    m = F.coalesce(F.col(line_col).rlike(pattern), F.lit(False))
    step = lines.withColumn("_m", m)
    # first line number of the current run of matching lines
    last_break = F.max(F.when(~F.col("_m"), F.col(no_col))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    step = step.withColumn("_start", F.coalesce(last_break, F.lit(0)) + 1)
    step = step.withColumn("_trig", F.col("_m") & (((F.col(no_col) - F.col("_start")) % 2) == 0))
    step = step.withColumn("edited", F.coalesce(F.lag("_trig").over(w), F.lit(False)))
    out = step.withColumn(line_col, F.when(F.col("edited"), edit(F.col(line_col))).otherwise(F.col(line_col)))
    return out.drop("_m", "_start", "_trig")


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` not matched one-for-one in ``right`` (U4, ``EXCEPT ALL``)."""
    return left.exceptAll(right)


def line_drift(a: DataFrame, b: DataFrame, key_cols: Sequence[str], line_col: str = "line",
               a_name: str = "only_a", b_name: str = "only_b") -> DataFrame:
    """Lines only in one copy, per file, counting repeats (J9): ``A EXCEPT ALL B``
    and ``B EXCEPT ALL A`` in one pass.

    Both copies are counted per (file, line) in a single aggregation (combined
    map-side, so a file or line repeated everywhere is pre-reduced); the surplus
    of each side is replayed as that many rows.
    """
    cols = [*key_cols, line_col]
    tagged = (a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
              .unionByName(b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    counts = tagged.groupBy(*cols).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    surplus = counts.where(F.col("_na") != F.col("_nb")).select(
        *cols, F.when(F.col("_na") > F.col("_nb"), F.lit(a_name)).otherwise(F.lit(b_name)).alias("side"),
        F.abs(F.col("_na") - F.col("_nb")).cast("int").alias("_n"))
    return surplus.select(*cols, "side", F.explode(F.array_repeat(F.lit(1), F.col("_n"))).alias("_r")).drop("_r")


def second_last(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                value_cols: Sequence[str]) -> DataFrame:
    """``tail -2 | head -1`` per group (W2): the second-to-last row, or the only row.

    Top-2 from the end with a window group limit (pre-shuffle), then ``max_by``
    of the rank.
    """
    desc = [(F.col(c) if isinstance(c, str) else c).desc() for c in order_cols]
    w = Window.partitionBy(*group_cols).orderBy(*desc)
    top = df.select(*group_cols, *value_cols, F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= 2)
    pick = top.groupBy(*group_cols).agg(
        F.max_by(F.struct(*[F.col(c) for c in value_cols]), F.col("_rn")).alias("_p"))
    return pick.select(*group_cols, *[F.col("_p")[c].alias(c) for c in value_cols])


def last_k(df: DataFrame, order_cols: Sequence[Column | str], k: int) -> DataFrame:
    """``tail -k`` of an ordered result (O3); a distributed top-k, not a full sort."""
    desc = [(F.col(c) if isinstance(c, str) else c).desc() for c in order_cols]
    return df.orderBy(*desc).limit(k)


def first_k(df: DataFrame, order_cols: Sequence[Column | str], k: int) -> DataFrame:
    """``head -k`` of an ordered result (O3)."""
    return df.orderBy(*order_cols).limit(k)
