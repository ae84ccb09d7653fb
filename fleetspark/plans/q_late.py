"""Deadlines over several deliveries of the events, some rows late."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.plans.q_streaming import ORACLE as _STREAMING, TIMEOUT_S
from fleetspark.plans.tables import table
from fleetspark.streaming.deadline_batches import DeadlineRun, run_deadlines
from fleetspark.streaming.sources import read_event_stream, shared_path, write_table

DELIVERIES = 3  # by time; rows that miss theirs come with the next, so there is one more
DELAY_S = 600


def _run(spark, d):
    """The events delivered one after the other, the stream started anew from its checkpoint for each."""
    events = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    if lo is None:
        lo = hi = 0
    third = F.floor((at - lo) * DELIVERIES / F.lit(hi - lo + 1)) + F.when(F.col("event_id") % 40 == 0, 1).otherwise(0)
    inbox, checkpoint = shared_path(spark, "deliveries"), shared_path(spark, "deliveries-ckpt")
    run = DeadlineRun(spark, shared_path(spark, "deadlines"), ["user_id"], "event_id", "ts", F.col("event_type") == "click",
                      F.col("event_type") == "purchase", TIMEOUT_S, DELAY_S)
    for n in range(DELIVERIES + 1):
        write_table(events.where(F.coalesce(third, F.lit(0)) == n), inbox, mode="append")
        run_deadlines(read_event_stream(spark, inbox, schema=events.schema), run, checkpoint)
    return run


def deadline_batches(spark, d):
    """Every start judged over four batches, late rows brought in: equals the batch form."""
    return _run(spark, d).amended().select("user_id", "event_id", "started", "done_at", "status")


def deadline_late(spark, d):
    """The side output of the same run: starts and completions that came after their horizon."""
    return _run(spark, d).late().select("user_id", "event_id", F.col("ts").alias("at"), "role")


QUERIES = {"deadline_batches": deadline_batches, "deadline_late": deadline_late}

ORACLE = {
    "deadline_batches": _STREAMING["deadline"],
    "deadline_late": """
WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'start' ELSE 'done' END AS role,
             (epoch_us(ts) - lo) * 3 // (hi - lo + 1) + CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END AS delivery
      FROM events, b WHERE event_type IN ('click', 'purchase')),
t AS (SELECT delivery, max(epoch_us(ts)) AS top FROM e GROUP BY delivery)
SELECT user_id, event_id, ts AS at, role FROM e
WHERE epoch_us(ts) < (SELECT max(top) FROM t WHERE t.delivery < e.delivery) - 600000000""",
}
