"""Lease / allocation work: nested matches (P3), last-wins lookup join (J1),
n-th row picks (W1), maps from rows (A3), bounded allocation (A5).

Scale notes
* Dedupe before any lookup is a ``groupBy`` with ``max_by`` -> map-side partial
  aggregation, so a hot key is pre-reduced on every mapper.
* Per-group "first k" uses ``row_number() <= k``; Spark plans it as a
  ``WindowGroupLimit`` before the shuffle, so a group holding a third of all rows
  still ships at most k rows per map task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.operators.sizing import DEFAULT_BROADCAST_ROWS, has_at_most


def keep_per_match(df: DataFrame, array_col: str, cond: Callable[[Column], Column],
                   set_form: bool = False) -> DataFrame:
    """``map(select(.arr[] | select(cond)))``.

    The parent row is emitted once per matching element (two matches emit it
    twice).  ``set_form=True`` keeps it once if any element matches.
    """
    if set_form:
        return df.where(F.exists(F.col(array_col), cond))
    cols = df.columns
    return (df.select(*cols, F.explode(F.col(array_col)).alias("_elem"))
              .where(cond(F.col("_elem")))
              .select(*cols))


def last_wins(df: DataFrame, key_cols: Sequence[str], value_cols: Sequence[str],
              order_col: str) -> DataFrame:
    """One row per key: the values of the row with the greatest ``order_col``
    (ties broken by the values themselves, so the choice is total)."""
    packed = F.struct(*[F.col(c) for c in value_cols]).alias("_v")
    order = F.struct(F.col(order_col), *[F.col(c) for c in value_cols])
    out = df.groupBy(*key_cols).agg(F.max_by(packed, order).alias("_v"))
    return out.select(*key_cols, *[F.col("_v")[c].alias(c) for c in value_cols])


def lookup_last(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                value_cols: Sequence[str], order_col: str,
                max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``map($lookup[.key])``: left join to a last-wins deduplicated lookup.

    Every left row is kept; an absent key gives nulls.  The lookup side is
    broadcast only when the size probe allows, else the join shuffles (and AQE
    splits skewed left partitions).
    """
    lk = last_wins(right, [right_key], value_cols, order_col).withColumnRenamed(right_key, "_lk")
    # probe the raw side (a cheap limited scan): dedupe only shrinks it
    if has_at_most(right.select(right_key), max_broadcast_rows):
        lk = F.broadcast(lk)
    return left.join(lk, left[left_key] == lk["_lk"], "left").drop("_lk")


def nth_rows(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
             indexes: Sequence[int], value_cols: Sequence[str], index_col: str = "idx") -> DataFrame:
    """``ARR[i]`` for each wanted 0-based index per group.

    Every group that has a row gets one output row per wanted index; an index
    past the end gives nulls ("empty when short").
    """
    k = max(indexes) + 1
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    top = df.select(*group_cols, *value_cols, F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= k)
    packed = top.groupBy(*group_cols).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rn"), *[F.col(c) for c in value_cols]))).alias("_top"))
    idx = F.explode(F.array(*[F.lit(int(i)) for i in indexes])).alias(index_col)
    out = packed.select(*group_cols, idx, "_top")
    elem = F.get(F.col("_top"), F.col(index_col))
    return out.select(*group_cols, F.col(index_col), *[elem[c].alias(c) for c in value_cols])


def map_from_rows(df: DataFrame, group_cols: Sequence[str], key_col: str, value_col: str,
                  order_col: str, map_col: str = "m") -> DataFrame:
    """``from_entries`` per group with the last duplicate key winning (A3).

    Duplicates are removed first (partial aggregation), so ``map_from_entries``
    never sees a repeated key and the session's map dedup policy is irrelevant.
    """
    dedup = last_wins(df, [*group_cols, key_col], [value_col], order_col)
    return dedup.groupBy(*group_cols).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key_col), F.col(value_col))))).alias(map_col))


def bounded_allocation(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                       min_count: int, max_count: int, rank_col: str = "pick",
                       count_col: str = "n_candidates") -> DataFrame:
    """Allocate from a group only if it has at least ``min_count`` candidates,
    and take at most ``max_count`` of them in order (A5)."""
    counts = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(count_col)).where(F.col(count_col) >= min_count)
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    top = df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= max_count)
    named = counts.withColumnsRenamed({c: f"_g_{c}" for c in group_cols})
    same = F.lit(True)
    for c in group_cols:  # a null group is a group too
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return top.join(named, same, "inner").drop(*[f"_g_{c}" for c in group_cols])
