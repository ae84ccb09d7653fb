"""Build-plan step 6: deadline detection (T1) and continuous policy (T2) over
``events``, each as a batch job and as a Structured Streaming job whose output
must equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions.ip import in_cidr, ip_to_num
from fleetspark.operators.policy import first_match, most_specific_prefix
from fleetspark.plans.q_policy import ALLOW_CIDR, policies_frame, prefixes_frame, rules_frame
from fleetspark.plans.q_scan import log_lines_from_events
from fleetspark.plans.tables import flows_from_events, table
from fleetspark.session import parallelism
from fleetspark.sources.access_log import parse_access_log
from fleetspark.streaming.deadline import deadline_batch, deadline_stream
from fleetspark.streaming.sources import read_event_stream, run_available, shared_path, write_table

TIMEOUT_S = 120
WATERMARK = "10 minutes"
POLL_S = 5


def deadline(spark, d):
    """Click -> purchase by the same user within 120 s, else timeout (T1, batch)."""
    e = table(spark, d, "events")
    starts = e.where(F.col("event_type") == "click")
    dones = e.where(F.col("event_type") == "purchase")
    return deadline_batch(starts, dones, ["user_id"], "event_id", "ts", "ts", TIMEOUT_S).select(
        "user_id", "event_id", "started", "done_at", "status")


def deadline_polls(spark, d):
    """The same steps as a waiter sees them that looks every 5 s, the last time after 115 s."""
    e = table(spark, d, "events")
    return deadline_batch(e.where(F.col("event_type") == "click"), e.where(F.col("event_type") == "purchase"), ["user_id"],
                          "event_id", "ts", "ts", TIMEOUT_S, POLL_S).select(
        "user_id", "event_id", "started", "done_at", "seen_at", "status")


def _event_stream_with_close(spark, d):
    """The events file as a stream, plus an end-of-input marker one day after
    the last event (derived from the table) so the watermark passes every real row; with the last
    event's time in microseconds, which tells real rows from the marker."""
    events = table(spark, d, "events")
    marker_dir = shared_path(spark, "events-close")
    close = events.agg(F.max("ts").alias("m")).select(
        F.lit(-1).cast("bigint").alias("event_id"), (F.col("m") + F.expr("INTERVAL 1 DAY")).alias("ts"),
        F.lit(-1).cast("bigint").alias("user_id"), F.explode(F.array(F.lit("click"), F.lit("purchase"))).alias(
            "event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    write_table(close.select(*events.columns), marker_dir, mode="overwrite")
    last = events.agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("m")).first()["m"]
    s1 = read_event_stream(spark, d, schema=events.schema, file_glob="events.parquet")
    s2 = read_event_stream(spark, marker_dir, schema=events.schema)
    return s1.unionByName(s2), last


def deadline_streaming(spark, d):
    """T1 as a stream-stream left outer join with watermarks (stream = batch)."""
    ev, last = _event_stream_with_close(spark, d)
    starts = ev.where(F.col("event_type") == "click")
    dones = ev.where(F.col("event_type") == "purchase")
    out = run_available(deadline_stream(starts, dones, ["user_id"], "event_id", "ts", "ts", TIMEOUT_S, WATERMARK),
                        "deadline", state_partitions=parallelism(spark))
    return out.where(F.unix_micros(F.col("started").cast("timestamp")) <= F.lit(last)).select(
        "user_id", "event_id", F.col("started").cast("timestamp_ntz").alias("started"),
        F.col("done_at").cast("timestamp_ntz").alias("done_at"), "status")


def stream_policy(spark, d):
    """First-match rule verdicts over the event stream (T2); no state, so every row is emitted."""
    events = table(spark, d, "events")
    s = read_event_stream(spark, d, schema=events.schema, file_glob="events.parquet",
                          spread_to=parallelism(spark))
    verdicts = first_match(flows_from_events(s), rules_frame(spark), policies_frame(spark), strategy="inline")
    return run_available(verdicts.select("flow_id", "verdict", "rule_rank"), "policy")


def stream_enrich(spark, d):
    """The access-log scan (S6), CIDR allow (P9) and most-specific-prefix
    enrichment (J7, stream-static broadcast joins) as one continuous job (T2)."""
    events = table(spark, d, "events")
    s = read_event_stream(spark, d, schema=events.schema, file_glob="events.parquet",
                          spread_to=parallelism(spark))
    parsed, _rejects = parse_access_log(log_lines_from_events(s))
    pts = parsed.withColumn("ip_num", ip_to_num("remote_addr"))
    enriched = most_specific_prefix(pts, "ip_num", prefixes_frame(spark, d))
    out = enriched.select("remote_addr", "time_local", "request", "status", "attr", "prefix_len",
                          in_cidr(F.col("ip_num"), ALLOW_CIDR).alias("allowed"))
    return run_available(out, "enrich")


def stream_policy_joined(spark, d):
    """The same verdicts through the keyed joins of long rule lists: static sides, no state."""
    events = table(spark, d, "events")
    s = read_event_stream(spark, d, schema=events.schema, file_glob="events.parquet",
                          spread_to=parallelism(spark))
    verdicts = first_match(flows_from_events(s), rules_frame(spark), policies_frame(spark), strategy="join")
    return run_available(verdicts.select("flow_id", "verdict", "rule_rank"), "policy-joined")


QUERIES = {
    "deadline": deadline,
    "deadline_polls": deadline_polls,
    "deadline_stream": deadline_streaming,
    "stream_policy": stream_policy,
    "stream_policy_joined": stream_policy_joined,
    "stream_enrich": stream_enrich,
}

_DEADLINE_SQL = """
WITH s AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'),
p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT s.user_id, s.event_id, s.ts AS started, min(p.ts) AS done_at,
       CASE WHEN min(p.ts) IS NOT NULL THEN 'done' ELSE 'timeout' END AS status
FROM s LEFT JOIN p ON p.user_id = s.user_id AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 120 SECOND
GROUP BY s.user_id, s.event_id, s.ts"""

from fleetspark.plans.q_policy import ORACLE as _POLICY_ORACLE, prefix_sql  # noqa: E402

ORACLE = {
    "deadline": _DEADLINE_SQL,
    "deadline_stream": _DEADLINE_SQL,
    "deadline_polls": """
WITH s AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'),
p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT s.user_id, s.event_id, s.ts AS started, min(p.ts) AS done_at
      FROM s LEFT JOIN p ON p.user_id = s.user_id AND p.ts BETWEEN s.ts AND s.ts + INTERVAL 115 SECOND
      GROUP BY s.user_id, s.event_id, s.ts)
SELECT *, started + to_seconds(5 * ((epoch_us(done_at) - epoch_us(started) + 4999999) // 5000000)) AS seen_at,
       CASE WHEN done_at IS NOT NULL THEN 'done' ELSE 'timeout' END AS status FROM m""",
    "stream_policy": _POLICY_ORACLE["first_match_policy"],
    "stream_policy_joined": _POLICY_ORACLE["first_match_policy"],
    "stream_enrich": f"""
WITH {prefix_sql("user_id")}
SELECT concat_ws('.', (e.src >> 24) & 255, (e.src >> 16) & 255, (e.src >> 8) & 255, e.src & 255) AS remote_addr,
       date_trunc('second', ev.ts) AS time_local,
       'GET /' || ev.event_type || '/' || CAST(ev.event_id AS VARCHAR) || ' HTTP/1.1' AS request,
       CAST(CASE WHEN ev.event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status,
       best.attr, CAST(best.prefix_len AS INTEGER) AS prefix_len,
       (e.src // 128 = 2886729728 // 128) AS allowed
FROM e JOIN events ev ON ev.event_id = e.event_id LEFT JOIN best ON best.event_id = e.event_id
WHERE NOT (ev.event_type = 'view' AND ev.value < 1)""",
}
