"""Build-plan step 4 (audit part): placeholders (F5, F6), template references
(F7), default secrets (F24), daemon start / stop order (O1, O2), directory
merges (U2, U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.operators.audit import (default_secret_audit, fill_placeholders, normalize_priority,
                                        start_order, stop_order, template_refs, unresolved_placeholders)
from fleetspark.operators.merge import force_merge, newer_wins
from fleetspark.plans.tables import doc_lines, table
from fleetspark.sources.kv import inline_assignments

# Our parameters for the page templates: two tag names get filled, the audit
# reports every other tag name left in the text.
PAGE_FILLS = [("b", "**"), ("h1", "# ")]
PAGE_TAG = r"<([a-z][a-z0-9]*)>"
PAGE_REFS = {"link": r'href="([^"]*)"', "call": r"track\((\d+)\)"}
ASSIGNMENT = r'([A-Za-z_][A-Za-z0-9_]*) = "([^"]*)"'


def placeholder_audit(spark, d):
    """Fill two placeholders in order (F5), then list every name left, per occurrence."""
    p = table(spark, d, "pages").select("page_id", fill_placeholders("html", PAGE_FILLS).alias("filled"))
    return unresolved_placeholders(p, "filled", ["page_id"], PAGE_TAG)


def template_references(spark, d):
    """Link targets and tracking calls named by each page."""
    return template_refs(table(spark, d, "pages"), "html", ["page_id"], PAGE_REFS)


def secret_audit(spark, d):
    """Assignments scanned from document lines and from the daemons' password lines (one an order, the
    daemon's name as its password); secret-like keys with a well-known value flagged (F24)."""
    passwords = _daemons(spark, d).select(F.lit("orders").alias("origin"), F.col("list_pos").alias("doc_id"), F.lit(1).alias("line_no"),
                                          F.concat(F.lit('vty_password = "'), F.col("daemon"), F.lit('"')).alias("line"))
    lines = doc_lines(spark, d).select(F.lit("documents").alias("origin"), "doc_id", "line_no", "line").unionByName(passwords)
    cfg = inline_assignments(lines, ASSIGNMENT, ["origin", "doc_id", "line_no"])
    return default_secret_audit(cfg).select("origin", "doc_id", "line_no", "key", "value", "is_default")


def _daemons(spark, d):
    """Daemon tables per host from ``orders``: host = customer, list position = order key."""
    o = table(spark, d, "orders")
    name = (F.when(F.col("o_orderstatus") == "F", "zebra").when(F.col("o_orderstatus") == "O", "bgpd")
            .otherwise("ospfd"))
    value = (F.when(F.col("o_orderpriority") == "1-URGENT", "yes")
             .when(F.col("o_orderpriority") == "2-HIGH", "2")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "3")
             .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "10").otherwise("no"))
    dm = o.select(F.col("o_custkey").alias("host"), name.alias("daemon"), F.col("o_orderkey").alias("list_pos"),
                  value.alias("value"))
    return dm.withColumn("prio", normalize_priority("daemon", "value")).drop("value")


def daemon_start_order(spark, d):
    """``start_prio 10`` per host over every host's daemon table (O1)."""
    return start_order(_daemons(spark, d), "host", "daemon", "list_pos", "prio", wanted=10)


def daemon_stop_order(spark, d):
    """``stop_prio 0`` per host: 10 down to 0, disabled ones included (O2)."""
    return stop_order(_daemons(spark, d), "host", "daemon", "list_pos", "prio", wanted=0)


def _dirs(spark, d):
    """Two directories from all events: clicks and signups are the source, the rest the target; one file per user-day."""
    e = table(spark, d, "events")
    files = e.groupBy(
        F.when(F.col("event_type").isin("click", "signup"), "source").otherwise("target").alias("dir"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"),
                 F.date_format("ts", "yyyy-MM-dd")).alias("name"),
    ).agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("mtime"),
          F.max_by("event_id", F.struct("ts", "event_id")).alias("content"))
    return files.where(F.col("dir") == "source"), files.where(F.col("dir") == "target")


def merge_newer(spark, d):
    """``cp --update source/* target/``."""
    src, dst = _dirs(spark, d)
    return newer_wins(src, dst)


def merge_force(spark, d):
    """``cp --force source/* target/``."""
    src, dst = _dirs(spark, d)
    return force_merge(src, dst)


QUERIES = {
    "placeholder_audit": placeholder_audit,
    "template_refs": template_references,
    "secret_audit": secret_audit,
    "daemon_start_order": daemon_start_order,
    "daemon_stop_order": daemon_stop_order,
    "merge_newer": merge_newer,
    "merge_force": merge_force,
}

_DAEMONS_SQL = """d AS (
  SELECT o_custkey AS host, CASE o_orderstatus WHEN 'F' THEN 'zebra' WHEN 'O' THEN 'bgpd' ELSE 'ospfd' END AS daemon,
         o_orderkey AS list_pos,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'yes' WHEN '2-HIGH' THEN '2' WHEN '3-MEDIUM' THEN '3'
              WHEN '4-NOT SPECIFIED' THEN '10' ELSE 'no' END AS val FROM orders),
n AS (SELECT *, CASE WHEN val IN ('no', '') THEN 0 WHEN val IN ('yes', 'true') THEN 1 ELSE TRY_CAST(val AS INTEGER) END AS b FROM d),
p AS (SELECT host, daemon, list_pos, CAST(CASE WHEN daemon <> 'zebra' AND b > 0 THEN b + 1 ELSE b END AS INTEGER) AS prio FROM n)"""

_DIRS_SQL = """f AS (
  SELECT CASE WHEN event_type IN ('click', 'signup') THEN 'source' ELSE 'target' END AS side,
         'u' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS name,
         date_trunc('hour', max(ts)) AS mtime, last(event_id ORDER BY ts, event_id) AS content
  FROM events GROUP BY ALL)"""

ORACLE = {
    "placeholder_audit": """
WITH f AS (SELECT page_id, replace(replace(html, '<b>', '**'), '<h1>', '# ') AS filled FROM pages),
x AS (SELECT page_id, regexp_extract_all(filled, '<([a-z][a-z0-9]*)>', 1) AS arr FROM f)
SELECT page_id, CAST(unnest(generate_series(0, len(arr) - 1)) AS INTEGER) AS pos, unnest(arr) AS placeholder FROM x""",
    "template_refs": """
SELECT page_id, 'link' AS kind, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref FROM pages
UNION ALL
SELECT page_id, 'call' AS kind, unnest(regexp_extract_all(html, 'track\\((\\d+)\\)', 1)) AS ref FROM pages""",
    "secret_audit": None,  # filled below (needs the lines CTE)
    "daemon_start_order": f"""WITH {_DAEMONS_SQL}
SELECT host, daemon, list_pos, prio,
       CAST(row_number() OVER (PARTITION BY host ORDER BY prio, list_pos, daemon) AS INTEGER) AS start_seq
FROM p WHERE prio BETWEEN 1 AND 10""",
    "daemon_stop_order": f"""WITH {_DAEMONS_SQL}
SELECT host, daemon, list_pos, prio,
       CAST(row_number() OVER (PARTITION BY host ORDER BY prio DESC, list_pos, daemon) AS INTEGER) AS stop_seq
FROM p WHERE prio BETWEEN 0 AND 10""",
    "merge_newer": f"""WITH {_DIRS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY mtime DESC, CASE WHEN side = 'target' THEN 1 ELSE 0 END DESC) AS rn FROM f)
SELECT name, mtime, content, side FROM r WHERE rn = 1""",
    "merge_force": f"""WITH {_DIRS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN side = 'source' THEN 0 ELSE 1 END) AS rn FROM f)
SELECT name, mtime, content, side FROM r WHERE rn = 1""",
}

from fleetspark.plans.q_lines import LINES_SQL  # noqa: E402

ORACLE["secret_audit"] = f"""WITH {LINES_SQL}, {_DAEMONS_SQL},
al AS (SELECT 'documents' AS origin, doc_id, line_no, line FROM lines
       UNION ALL SELECT 'orders', list_pos, 1, 'vty_password = "' || daemon || '"' FROM p),
a AS (SELECT origin, doc_id, line_no, regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*) = "([^"]*)"', 1) AS ks,
             regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*) = "([^"]*)"', 2) AS vs FROM al),
c AS (SELECT origin, doc_id, line_no, unnest(ks) AS key, unnest(vs) AS value FROM a)
SELECT origin, doc_id, line_no, key, value, trim(value) IN ('secret', 'soadmin', 'zebra', 'please-set-at-here') AS is_default
FROM c WHERE regexp_matches(lower(key), '(pass|secret|token)')"""
