"""Page templates filled from parameters per host (F5): a page's host is a user, whose events set the values."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.operators.audit import start_order, stop_order, unresolved_placeholders
from fleetspark.operators.fill import fill_from_table
from fleetspark.plans.q_audit import _DAEMONS_SQL, PAGE_TAG, _daemons
from fleetspark.plans.tables import table

HOSTS = 400  # some hosts have pages and no events
# Which tag a type of event sets.
TAGS = {"click": "b", "signup": "h1", "purchase": "li"}
DAEMON_LIST = ["ospfd", "zebra"]


def _filled(spark, d):
    e = table(spark, d, "events")
    tag = F.col("event_type")
    for event, name in TAGS.items():
        tag = F.when(F.col("event_type") == event, name).otherwise(tag)
    # an error takes the user's value of "li" away until the next purchase
    name = F.when(F.col("event_type") == "error", "li").otherwise(tag)
    value = F.when(F.col("event_type") != "error", F.concat(F.lit("[<p>"), F.col("event_id").cast("string"), F.lit("]")))
    params = e.select(F.col("user_id").alias("host"), name.alias("name"), value.alias("value"), "ts", "event_id")
    pages = table(spark, d, "pages").select("page_id", "html", (F.col("page_id") % HOSTS).alias("host"))
    return fill_from_table(pages, params, "host", ["page_id"], "html", order_cols=["ts", "event_id"], pattern=PAGE_TAG)


def host_fill(spark, d):
    """Every page with its placeholders filled from its host's last parameters, in one pass."""
    return _filled(spark, d).select("page_id", "host", "filled")


def host_fill_audit(spark, d):
    """The placeholders left per occurrence after each host's parameters are filled in."""
    return unresolved_placeholders(_filled(spark, d), "filled", ["page_id"], PAGE_TAG)


def daemon_list_start(spark, d):
    """``start_prio 10 "ospfd zebra"`` per host: only the listed daemons, ties in that order (O1)."""
    return start_order(_daemons(spark, d), "host", "daemon", "list_pos", "prio", wanted=10, daemon_list=DAEMON_LIST)


def daemon_list_stop(spark, d):
    """``stop_prio 2 "ospfd zebra"`` per host (O2)."""
    return stop_order(_daemons(spark, d), "host", "daemon", "list_pos", "prio", wanted=2, daemon_list=DAEMON_LIST)


QUERIES = {"host_fill": host_fill, "host_fill_audit": host_fill_audit, "daemon_list_start": daemon_list_start,
           "daemon_list_stop": daemon_list_stop}

# "<p>" in a value is not filled: no event sets "p".
_FILLED = """e AS (
  SELECT user_id, CASE event_type WHEN 'click' THEN 'b' WHEN 'signup' THEN 'h1' ELSE 'li' END AS name,
         last(CASE WHEN event_type <> 'error' THEN '[<p>' || CAST(event_id AS VARCHAR) || ']' END ORDER BY ts, event_id) AS value
  FROM events WHERE event_type IN ('click', 'signup', 'purchase', 'error') GROUP BY 1, 2),
m AS (SELECT user_id, max(value) FILTER (name = 'b') AS b, max(value) FILTER (name = 'h1') AS h1,
             max(value) FILTER (name = 'li') AS li FROM e GROUP BY 1),
f AS (SELECT page_id, page_id % 400 AS host, replace(replace(replace(html, '<b>', coalesce(b, '<b>')),
             '<h1>', coalesce(h1, '<h1>')), '<li>', coalesce(li, '<li>')) AS filled
      FROM pages LEFT JOIN m ON m.user_id = page_id % 400)"""

ORACLE = {
    "host_fill": f"WITH {_FILLED} SELECT page_id, host, filled FROM f",
    "host_fill_audit": f"""WITH {_FILLED},
x AS (SELECT page_id, regexp_extract_all(filled, '<([a-z][a-z0-9]*)>', 1) AS arr FROM f)
SELECT page_id, CAST(unnest(generate_series(0, len(arr) - 1)) AS INTEGER) AS pos, unnest(arr) AS placeholder FROM x""",
    "daemon_list_start": f"""WITH {_DAEMONS_SQL}
SELECT host, daemon, list_pos, prio, row_number() OVER (PARTITION BY host
       ORDER BY prio, CASE daemon WHEN 'ospfd' THEN 1 ELSE 2 END, list_pos) AS start_seq
FROM p WHERE prio BETWEEN 1 AND 10 AND daemon IN ('ospfd', 'zebra')""",
    "daemon_list_stop": f"""WITH {_DAEMONS_SQL}
SELECT host, daemon, list_pos, prio, row_number() OVER (PARTITION BY host
       ORDER BY prio DESC, CASE daemon WHEN 'ospfd' THEN 1 ELSE 2 END, list_pos) AS stop_seq
FROM p WHERE prio BETWEEN 2 AND 10 AND daemon IN ('ospfd', 'zebra')""",
}
