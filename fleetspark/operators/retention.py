"""Retention: age filter (F22), newest-first byte budget (W4), weekly rotation
(F23).

Scale notes
* W4 needs a running sum per host in time order.  A window over a host holding
  a third of the data would be one task; when the largest host is above the
  bound the sum is split over the chunks of a range-partitioned sort: a
  running sum inside each (host, partition) chunk plus the totals of the
  host's earlier chunks (a small table).
* F23 aggregates to (host, week) first; ranking happens on that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions.timefx import within_days
from fleetspark.operators.ranking import DEFAULT_MAX_GROUP_ROWS, running_sum_within


def age_filter(df: DataFrame, ts_col: str, asof, keep_days: int = 10, repair_days: int = 7,
               flag_col: str = "in_repair_window") -> DataFrame:
    """Keep rows newer than ``asof - keep_days``; flag those inside the repair horizon."""
    return (df.where(within_days(F.col(ts_col), asof, keep_days))
              .withColumn(flag_col, within_days(F.col(ts_col), asof, repair_days)))


def newest_within_budget(df: DataFrame, host_col: str, ts_col: str, bytes_col: str, budget: int,
                         tie_col: str, cum_col: str = "cum_bytes", skew_safe: bool | str = "auto",
                         max_group_rows: int = DEFAULT_MAX_GROUP_ROWS) -> DataFrame:
    """Rows kept when walking each host's records newest first until the byte
    budget is exceeded (W4).  ``tie_col`` makes the order total.  The running
    total is :func:`~fleetspark.operators.ranking.running_sum_within`: a plain
    window while every host is provably small, else the distributed running sum
    that spreads a host holding a third of all records over many tasks."""
    order = [F.col(ts_col).desc(), F.col(tie_col).desc()]
    out = running_sum_within(df, [host_col], order, bytes_col, cum_col, skew_safe=skew_safe,
                             max_group_rows=max_group_rows)
    return out.where(F.col(cum_col) <= budget)


def weekly_rotation(df: DataFrame, host_col: str, ts_col: str, bytes_col: str, keep: int = 4,
                    min_size: int = 1 << 20, week_col: str = "week", gen_col: str = "generation") -> DataFrame:
    """``weekly / rotate 4 / minsize 1M / notifempty`` (F23): weekly totals per host,
    weeks big enough and not empty become generations, newest ``keep`` kept."""
    weeks = df.groupBy(host_col, F.date_trunc("week", F.col(ts_col)).cast("timestamp_ntz").alias(week_col)).agg(
        F.sum(bytes_col).alias(bytes_col))
    eligible = weeks.where((F.col(bytes_col) >= min_size) & (F.col(bytes_col) > 0))
    w = Window.partitionBy(host_col).orderBy(F.col(week_col).desc())
    return eligible.withColumn(gen_col, F.dense_rank().over(w)).where(F.col(gen_col) <= keep)
