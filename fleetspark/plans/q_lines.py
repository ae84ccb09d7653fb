"""Build-plan step 4 (text part): line edits and audits over ``documents`` and
``pages`` (F1-F4, F8-F13, P7, S5, A6, W2, W3, J9, U4, O3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions.ip import num_to_ip
from fleetspark.functions.text import (addressed, awk_field, basename, capture_replace, join_ws,
                                       replace_all, replace_first, split_get, split_size,
                                       strip_last_dotted, strip_to_first_space, uri_fragment)
from fleetspark.operators.lines import drop_matching, edit_after_match, last_k, line_drift, second_last
from fleetspark.plans.tables import BASE_ADDRESS, doc_lines, table

# Fixed values used by the text queries.
JUNK_PATTERNS = ["###", r"\$\$\$"]


def _lines(spark, d):
    return doc_lines(spark, d)


def q_replace_first(spark, d):
    """``s/ the / /``: first occurrence only (F2)."""
    return _lines(spark, d).select("doc_id", "line_no", replace_first("line", " the ", " ").alias("line"))


def q_addressed_replace(spark, d):
    """``/@/ s/@/ at /``: first match only, on addressed lines only."""
    return _lines(spark, d).select(
        "doc_id", "line_no", addressed("line", "@", lambda s: replace_first(s, "@", " at ")).alias("line"))


def q_capture_replace(spark, d):
    """``s/^(The .*)/#\\1/``: comment out lines by capture group."""
    return _lines(spark, d).select("doc_id", "line_no", capture_replace("line", "^(The .*)", r"#\1").alias("line"))


def q_strip_first_word(spark, d):
    """``${line#* }`` (F8)."""
    return _lines(spark, d).select("doc_id", "line_no", strip_to_first_space("line").alias("line"))


def q_drop_patterns(spark, d):
    """``egrep -v "(###|\\$\\$\\$)"``."""
    return drop_matching(_lines(spark, d), JUNK_PATTERNS).select("doc_id", "line_no", "line")


def q_cli_field(spark, d):
    """``grep ' the ' | awk '{print $4}'``."""
    li = _lines(spark, d).where(F.col("line").contains(" the "))
    return li.select("doc_id", "line_no", awk_field("line", 4).alias("field"))


def q_word_stats(spark, d):
    """Word count as list length (A6) and the second word by index."""
    return _lines(spark, d).select("doc_id", "line_no", split_size("line", " ").alias("n_words"),
                                   split_get(F.trim("line"), " ", 1).alias("second_word"))


def q_next_line_edit(spark, d):
    """``sed '/the/!b;n;s/\\./!/'``."""
    out = edit_after_match(_lines(spark, d), ["doc_id"], "the", lambda s: replace_first(s, ".", "!"))
    return out.select("doc_id", "line_no", "line", "edited")


def _embedded_copy(lines):
    edited = lines.select("doc_id", "line_no",
                          addressed("line", "@", lambda s: replace_first(s, "@", " at ")).alias("line"))
    return drop_matching(edited, JUNK_PATTERNS)


def q_line_drift(spark, d):
    """Lines only in the original or only in the rewritten copy, repeats counted."""
    lines = _lines(spark, d)
    return line_drift(lines, _embedded_copy(lines), ["doc_id"], a_name="only_standalone", b_name="only_embedded")


def q_url_parts(spark, d):
    """``s/\\//-/g`` (F1), ``basename URL .html`` (F9), decoded fragment."""
    p = table(spark, d, "pages")
    return p.select("page_id", replace_all("url", "/", "-").alias("dashed"),
                    basename("url", ".html").alias("base"), uri_fragment("url").alias("fragment"))


def q_name_parts(spark, d):
    """Network part of an address (F10) and ``${USER}-${TASK}-${TYPE}`` names."""
    e = table(spark, d, "events")
    ip = num_to_ip(F.lit(BASE_ADDRESS) + F.col("user_id"))
    return e.select("event_id", strip_last_dotted(ip).alias("net3"),
                    join_ws("-", F.concat(F.lit("user"), F.col("user_id").cast("string")),
                            "event_type", F.lit("lease")).alias("lease_name"))


def q_second_last(spark, d):
    """Second-to-last order per customer and priority, the only one if there is one."""
    o = table(spark, d, "orders")
    return second_last(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])


def q_latest_events(spark, d):
    """``tail -5``: the five latest events (O3); the limit is the feature."""
    e = table(spark, d, "events")
    return last_k(e.select("event_id", "ts", "user_id"), ["ts", "event_id"], 5)


QUERIES = {
    "replace_first": q_replace_first,
    "addressed_replace": q_addressed_replace,
    "capture_replace": q_capture_replace,
    "strip_first_word": q_strip_first_word,
    "drop_patterns": q_drop_patterns,
    "cli_field": q_cli_field,
    "word_stats": q_word_stats,
    "next_line_edit": q_next_line_edit,
    "line_drift": q_line_drift,
    "url_parts": q_url_parts,
    "name_parts": q_name_parts,
    "second_last": q_second_last,
    "latest_events": q_latest_events,
}

LINES_SQL = """lines AS (
  SELECT doc_id, CAST(unnest(generate_series(1, len(arr))) AS INTEGER) AS line_no, unnest(arr) AS line
  FROM (SELECT doc_id, CASE WHEN suffix(text, chr(10)) THEN arr0[1:len(arr0) - 1] ELSE arr0 END AS arr
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS arr0 FROM documents)))"""

_EMBEDDED = """emb AS (
  SELECT doc_id, line_no, CASE WHEN contains(line, '@') THEN regexp_replace(line, '@', ' at ') ELSE line END AS line
  FROM lines),
emb2 AS (SELECT * FROM emb WHERE NOT regexp_matches(line, '(###|\\$\\$\\$)'))"""

ORACLE = {
    "replace_first": f"WITH {LINES_SQL} SELECT doc_id, line_no, regexp_replace(line, ' the ', ' ') AS line FROM lines",
    "addressed_replace": f"""WITH {LINES_SQL}
SELECT doc_id, line_no, CASE WHEN contains(line, '@') THEN regexp_replace(line, '@', ' at ') ELSE line END AS line FROM lines""",
    "capture_replace": f"WITH {LINES_SQL} SELECT doc_id, line_no, regexp_replace(line, '^(The .*)', '#\\1') AS line FROM lines",
    "strip_first_word": f"WITH {LINES_SQL} SELECT doc_id, line_no, regexp_replace(line, '^[^ ]* ', '') AS line FROM lines",
    "drop_patterns": f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM lines WHERE NOT regexp_matches(line, '(###|\\$\\$\\$)')",
    "cli_field": f"""WITH {LINES_SQL}
SELECT doc_id, line_no, string_split_regex(trim(line), '\\s+')[4] AS field FROM lines WHERE contains(line, ' the ')""",
    "word_stats": f"""WITH {LINES_SQL}
SELECT doc_id, line_no, CAST(CASE WHEN trim(line) = '' THEN 0 ELSE len(string_split(trim(line), ' ')) END AS INTEGER) AS n_words,
       string_split(trim(line), ' ')[2] AS second_word FROM lines""",
    "next_line_edit": f"""WITH {LINES_SQL},
m AS (SELECT *, regexp_matches(line, 'the') AS m FROM lines),
s AS (SELECT *, coalesce(max(CASE WHEN NOT m THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) + 1 AS st FROM m),
t AS (SELECT *, m AND ((line_no - st) % 2 = 0) AS trig FROM s),
u AS (SELECT *, coalesce(lag(trig) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS edited FROM t)
SELECT doc_id, line_no, CASE WHEN edited THEN regexp_replace(line, '\\.', '!') ELSE line END AS line, edited FROM u""",
    "line_drift": f"""WITH {LINES_SQL}, {_EMBEDDED}
SELECT doc_id, line, 'only_standalone' AS side FROM (SELECT doc_id, line FROM lines EXCEPT ALL SELECT doc_id, line FROM emb2)
UNION ALL
SELECT doc_id, line, 'only_embedded' AS side FROM (SELECT doc_id, line FROM emb2 EXCEPT ALL SELECT doc_id, line FROM lines)""",
    "url_parts": """
WITH b AS (SELECT page_id, url, regexp_extract(rtrim(url, '/'), '[^/]*$') AS b0 FROM pages)
SELECT page_id, replace(url, '/', '-') AS dashed,
       CASE WHEN suffix(b0, '.html') AND b0 <> '.html' THEN left(b0, length(b0) - 5) ELSE b0 END AS base,
       CASE WHEN contains(url, '#') THEN url_decode(replace(string_split(url, '#')[-1], '+', ' ')) END AS fragment
FROM b""",
    "name_parts": """
SELECT event_id,
       concat_ws('.', ((2886729728 + user_id) >> 24) & 255, ((2886729728 + user_id) >> 16) & 255,
                 ((2886729728 + user_id) >> 8) & 255) AS net3,
       concat_ws('-', 'user' || CAST(user_id AS VARCHAR), event_type, 'lease') AS lease_name
FROM events""",
    "second_last": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
                  count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders)
SELECT o_custkey, o_orderpriority, o_orderkey, o_orderdate FROM r WHERE rn = least(2, n)""",
    "latest_events": "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5",
}
