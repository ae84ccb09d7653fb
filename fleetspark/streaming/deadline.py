"""Deadline detection (T1): a step started at ``t`` is done if a completion of
the same key is seen in ``[t, t + timeout]``, else it timed out.

Batch form: an equi-join on (key, time bucket) with the exact window as the
residual condition, so a key with very many events is not a per-key range
join; the first completion per start is a ``min`` (partial aggregation).

Stream form: a stream-stream left outer join with watermarks on both sides,
the same (key, bucket) equality and time-range condition; the unmatched
(timeout) rows are emitted once the watermark passes ``start + timeout``.  A
final ``groupBy`` on the start (event time included) keeps the first
completion and folds the two bucket rows of a start together.

``poll_s``: a waiter that looks every ``poll_s`` seconds, first at the start, and
gives up after ``timeout_s`` without a last look.  A completion is then seen at
the first look at or after it (``seen_at``), the last one ``poll_s`` before the
timeout; one that comes later counts as none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(ts: Column, width_s: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(width_s * 1_000_000)).cast("bigint")


def _last_look(timeout_s: int, poll_s: int | None) -> int:
    """Seconds after a start within which a completion counts."""
    if poll_s is None:
        return timeout_s
    if poll_s < 1 or timeout_s < 1:
        raise ValueError("poll_s and timeout_s must be positive")
    return (timeout_s - 1) // poll_s * poll_s


def _judged(out: DataFrame, poll_s: int | None) -> DataFrame:
    out = out.withColumn("status", F.when(F.col("done_at").isNotNull(), "done").otherwise("timeout"))
    if poll_s is None:
        return out
    waited = F.unix_micros(F.col("done_at").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    looks = F.ceil(waited / F.lit(poll_s * 1_000_000)).cast("bigint")
    seen = F.col("started") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (looks * poll_s).cast("decimal(18,6)"))
    return out.withColumn("seen_at", seen)


def deadline_batch(starts: DataFrame, dones: DataFrame, key_cols: Sequence[str], start_id: str,
                   start_ts: str, done_ts: str, timeout_s: int = 120, poll_s: int | None = None) -> DataFrame:
    """One row per start: ``done_at`` (first completion in the window) and
    ``status`` done / timeout; with ``poll_s`` also ``seen_at``."""
    within = _last_look(timeout_s, poll_s)
    s = starts.select(*key_cols, start_id, F.col(start_ts).alias("started"))
    b0 = _bucket(F.col("started"), timeout_s)
    s = s.withColumn("_b", F.explode(F.array(b0, b0 + 1)))
    d = dones.select(*[F.col(k).alias(f"_d_{k}") for k in key_cols], F.col(done_ts).alias("_done"))
    d = d.withColumn("_db", _bucket(F.col("_done"), timeout_s))
    cond = [F.col(k) == F.col(f"_d_{k}") for k in key_cols]
    cond.append(F.col("_b") == F.col("_db"))
    cond.append(F.col("_done").between(F.col("started"), F.col("started") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(within))))
    cond_all = cond[0]
    for c in cond[1:]:
        cond_all = cond_all & c
    j = s.join(d, cond_all, "left")
    out = j.groupBy(*key_cols, start_id, "started").agg(F.min("_done").alias("done_at"))
    return _judged(out, poll_s)


def deadline_stream(starts: DataFrame, dones: DataFrame, key_cols: Sequence[str], start_id: str,
                    start_ts: str, done_ts: str, timeout_s: int = 120,
                    watermark: str = "10 minutes", poll_s: int | None = None) -> DataFrame:
    """Streaming twin of :func:`deadline_batch` (append mode)."""
    within = _last_look(timeout_s, poll_s)
    s = starts.select(*key_cols, start_id, F.col(start_ts).cast("timestamp").alias("started"))
    b0 = _bucket(F.col("started"), timeout_s)
    s = s.withColumn("_b", F.explode(F.array(b0, b0 + 1))).withWatermark("started", watermark)
    d = dones.select(*[F.col(k).alias(f"_d_{k}") for k in key_cols],
                     F.col(done_ts).cast("timestamp").alias("_done"))
    d = d.withColumn("_db", _bucket(F.col("_done"), timeout_s)).withWatermark("_done", watermark)
    cond = F.col("_done").between(F.col("started"), F.col("started") + F.expr(f"INTERVAL {int(within)} SECONDS"))
    cond = cond & (F.col("_b") == F.col("_db"))
    for k in key_cols:
        cond = cond & (F.col(k) == F.col(f"_d_{k}"))
    # state is keyed by (key, time bucket), so a hot key spreads over buckets;
    # the two rows of a start (one per candidate bucket) meet again in the min
    j = s.join(d, cond, "leftOuter")
    out = j.groupBy(*key_cols, start_id, "started").agg(F.min("_done").alias("done_at"))
    return _judged(out, poll_s)
