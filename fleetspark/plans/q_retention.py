"""Build-plan step 5: retention and clock queries over ``events`` (F19-F23, W4),
as of the fixed date 2024-01-31."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions.timefx import lease_end, lease_start, plus_decimal_days, utc_day, utc_stamp
from fleetspark.operators.retention import age_filter, newest_within_budget, weekly_rotation
from fleetspark.plans.tables import table

# As-of date of the build plan; keep / repair horizons; log limits.
ASOF = "2024-01-31T00:00:00"
DAYS_TO_KEEP = 10
DAYS_TO_REPAIR = 7
BYTE_BUDGET = 4 << 20
ROTATE_KEEP = 4
ROTATE_MIN_SIZE = 1 << 20
LEASE_DAYS = 7


def _logs(spark, d):
    """``log_files(host, ts, bytes)`` from events: host = user, bytes read off the value."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("host"), "event_id", "ts",
                    F.floor(F.col("value") * 4096).cast("bigint").alias("bytes"))


def q_age_filter(spark, d):
    """Keep 10 days before the as-of date, flag the 7-day repair horizon."""
    out = age_filter(table(spark, d, "events"), "ts", ASOF, DAYS_TO_KEEP, DAYS_TO_REPAIR)
    return out.select("event_id", "ts", "in_repair_window")


def q_size_budget(spark, d):
    """Newest records per host up to a 4 MiB budget."""
    out = newest_within_budget(_logs(spark, d), "host", "ts", "bytes", BYTE_BUDGET, tie_col="event_id")
    return out.select("host", "event_id", "ts", "bytes", "cum_bytes")


def q_weekly_rotation(spark, d):
    """Weekly generations >= 1 MiB, newest 4 kept."""
    return weekly_rotation(_logs(spark, d), "host", "ts", "bytes", ROTATE_KEEP, ROTATE_MIN_SIZE)


def q_lease_window(spark, d):
    """Stamps and lease window per event clock: start +1 minute, end +7 days, cut to minutes."""
    e = table(spark, d, "events")
    return e.select("event_id", utc_stamp("ts").alias("stamp"), utc_day("ts").alias("day"),
                    lease_start("ts").alias("lease_start"), lease_end("ts", LEASE_DAYS).alias("lease_end"))


def q_term_expiry(spark, d):
    """Term end = start + a decimal number of days."""
    e = table(spark, d, "events").select("event_id", "ts", (F.col("value") / 10).cast("decimal(18,6)").alias("days"))
    return e.select("event_id", "days", plus_decimal_days("ts", "days").alias("expires"))


QUERIES = {
    "age_filter": q_age_filter,
    "size_budget": q_size_budget,
    "weekly_rotation": q_weekly_rotation,
    "lease_window": q_lease_window,
    "term_expiry": q_term_expiry,
}

_LOGS = "logs AS (SELECT user_id AS host, event_id, ts, CAST(floor(value * 4096) AS BIGINT) AS bytes FROM events)"

ORACLE = {
    "age_filter": """
SELECT event_id, ts, ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AS in_repair_window
FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY""",
    "size_budget": f"""WITH {_LOGS},
c AS (SELECT *, sum(bytes) OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_bytes FROM logs)
SELECT host, event_id, ts, bytes, CAST(cum_bytes AS BIGINT) AS cum_bytes FROM c WHERE cum_bytes <= 4194304""",
    "weekly_rotation": f"""WITH {_LOGS},
w AS (SELECT host, date_trunc('week', ts) AS week, CAST(sum(bytes) AS BIGINT) AS bytes FROM logs GROUP BY ALL),
e AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY host ORDER BY week DESC) AS INTEGER) AS generation
      FROM w WHERE bytes >= 1048576 AND bytes > 0)
SELECT host, week, bytes, generation FROM e WHERE generation <= 4""",
    "lease_window": """
SELECT event_id, strftime(ts, '%Y%m%d-%H%M') || 'UTC' AS stamp, strftime(ts, '%Y-%m-%d') AS day,
       date_trunc('minute', ts + INTERVAL 1 MINUTE) AS lease_start,
       date_trunc('minute', ts + INTERVAL 7 DAY) AS lease_end
FROM events""",
    "term_expiry": """
WITH e AS (SELECT event_id, ts, CAST(value / 10 AS DECIMAL(18, 6)) AS days FROM events)
SELECT event_id, days, ts + to_microseconds(CAST(days * 86400000000 AS BIGINT)) AS expires FROM e""",
}
