"""Build-plan step 4 (scan part): access log (S6), key/value configs (S2, A4,
W5), XML property lists (S3), blocks (S7), file-name globs (P8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspark.functions.ip import num_to_ip
from fleetspark.functions.text import basename
from fleetspark.operators.lines import drop_glob, to_lines
from fleetspark.plans.tables import BASE_ADDRESS, table
from fleetspark.sources.access_log import parse_access_log
from fleetspark.sources.kv import blocks, last_wins_config, parse_kv_lines, xml_property_strings


def _log_lines(spark, d):
    return log_lines_from_events(table(spark, d, "events", spread_rows=True))


def log_lines_from_events(e):
    """Access-log lines written from events in the declared format (batch or
    stream); short view events lose their closing quote (malformed lines for
    the rejects path)."""
    user = F.when(F.col("event_type") == "purchase", F.concat(F.lit("user"), F.col("user_id").cast("string"))
                  ).otherwise(F.lit("-"))
    status = F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200"))
    tail = F.when((F.col("event_type") == "view") & (F.col("value") < 1), F.lit("")).otherwise(F.lit('"'))
    line = F.concat(
        num_to_ip(F.lit(BASE_ADDRESS) + F.col("user_id")), F.lit(" - "), user,
        F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] \"GET /"), F.col("event_type"),
        F.lit("/"), F.col("event_id").cast("string"), F.lit(" HTTP/1.1\" "), status, F.lit(" "),
        F.floor(F.col("value") * 100).cast("string"), F.lit(" \"-\" \"agent/"),
        F.get_json_object("props", "$.k"), F.lit("\" \"-"), tail)
    return e.select(line.alias("value"))


def access_log(spark, d):
    """Parse every log line into the nine declared fields."""
    parsed, _ = parse_access_log(_log_lines(spark, d))
    return parsed


def access_log_rejects(spark, d):
    """Lines that do not match the declared format (S6 rejects)."""
    _, rejects = parse_access_log(_log_lines(spark, d))
    return rejects.select(F.col("value").alias("line"))


def query_config_texts(spark, d):
    """One small config text per page: a ``[lang]`` section line, then its query pairs."""
    p = table(spark, d, "pages")
    lang = F.regexp_extract("url", r"/([a-z]{2})/", 1)
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    text = F.concat(F.lit("["), lang, F.lit("]\n"), F.replace(query, F.lit("&"), F.lit("\n")))
    return p.select(F.col("page_id").alias("file"), text.alias("text"))


def _query_configs(spark, d):
    return to_lines(query_config_texts(spark, d), "text", ["file"])


def _turn_configs(spark, d):
    """A config per conversation, one line a turn: the role set to the quoted length of its
    text (a role that speaks again is set again); every fifth turn is commented out."""
    c = table(spark, d, "conversations")
    line = F.concat(F.when(F.col("turn") % 5 == 4, F.lit("# ")).otherwise(F.lit("")), F.col("role"), F.lit(" = \""),
                    F.length("text").cast("string"), F.lit("\""))
    return c.select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), line.alias("line"))


def kv_scan(spark, d):
    """key=value lines with sections."""
    return parse_kv_lines(_query_configs(spark, d))


def kv_comments(spark, d):
    """key=value lines with comments and quoted values."""
    return parse_kv_lines(_turn_configs(spark, d))


def kv_last_wins(spark, d):
    """A key set twice keeps its last value (A4)."""
    return last_wins_config(parse_kv_lines(_turn_configs(spark, d)))


def xml_props(spark, d):
    """Property lists (``<property><name/><value/></property>``) scanned to rows (S3)."""
    kv = parse_kv_lines(_query_configs(spark, d))
    prop = F.concat(F.lit("<property><name>"), F.col("key"), F.lit("</name><value>"), F.col("value"),
                    F.lit("</value></property>"))
    docs = kv.groupBy("file").agg(F.concat(
        F.lit("<configuration>"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", prop.alias("p")))),
                                 lambda x: x["p"]), ""),
        F.lit("</configuration>")).alias("xml"))
    return xml_property_strings(docs, "xml", ["file"])


def block_texts(spark, d):
    """A text per conversation: an ``interface:`` block of role and turn for each turn."""
    c = table(spark, d, "conversations")
    block = F.concat(F.lit("interface:\n     role: "), F.col("role"), F.lit("\n     turn: "),
                     F.col("turn").cast("string"))
    return c.groupBy(F.col("conv_id").alias("file")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def block_scan(spark, d):
    """``interface:`` blocks of indented ``key: value`` lines, one row per block."""
    return blocks(to_lines(block_texts(spark, d), "text", ["file"]), "interface", keys=["role", "turn"])


def glob_filter(spark, d):
    """``rm -f */*.html``: drop pages whose base name matches the glob."""
    p = table(spark, d, "pages").select("page_id", basename("url").alias("base"))
    return drop_glob(p, "base", "*.html")


QUERIES = {
    "access_log": access_log,
    "access_log_rejects": access_log_rejects,
    "kv_scan": kv_scan,
    "kv_comments": kv_comments,
    "kv_last_wins": kv_last_wins,
    "xml_props": xml_props,
    "block_scan": block_scan,
    "glob_filter": glob_filter,
}

_LOG_SQL = """lg AS (
  SELECT event_id, event_type, value,
         concat_ws('.', ((2886729728 + user_id) >> 24) & 255, ((2886729728 + user_id) >> 16) & 255,
                   ((2886729728 + user_id) >> 8) & 255, (2886729728 + user_id) & 255) AS remote_addr,
         CASE WHEN event_type = 'purchase' THEN 'user' || CAST(user_id AS VARCHAR) ELSE '-' END AS remote_user,
         date_trunc('second', ts) AS time_local,
         'GET /' || event_type || '/' || CAST(event_id AS VARCHAR) || ' HTTP/1.1' AS request,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         CAST(floor(value * 100) AS BIGINT) AS body_bytes_sent,
         'agent/' || json_extract_string(props, '$.k') AS user_agent, ts
  FROM events)"""

_KV_SQL = """cfg AS (
  SELECT page_id AS file, regexp_extract(url, '/([a-z]{2})/', 1) AS section,
         string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') AS pairs FROM pages),
kv AS (SELECT file, section, CAST(unnest(generate_series(2, len(pairs) + 1)) AS INTEGER) AS line_no,
              unnest(pairs) AS line FROM cfg),
kv2 AS (SELECT file, section, line_no, split_part(line, '=', 1) AS key,
               substr(line, strpos(line, '=') + 1) AS value FROM kv WHERE contains(line, '='))"""

ORACLE = {
    "access_log": f"""WITH {_LOG_SQL}
SELECT remote_addr, remote_user, time_local, request, CAST(status AS INTEGER) AS status, body_bytes_sent,
       '-' AS referer, user_agent, '-' AS x_forwarded_for
FROM lg WHERE NOT (event_type = 'view' AND value < 1)""",
    "access_log_rejects": f"""WITH {_LOG_SQL}
SELECT remote_addr || ' - ' || remote_user || ' [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || request
       || '" ' || CAST(status AS VARCHAR) || ' ' || CAST(body_bytes_sent AS VARCHAR) || ' "-" "' || user_agent || '" "-' AS line
FROM lg WHERE event_type = 'view' AND value < 1""",
    "kv_scan": f"WITH {_KV_SQL} SELECT file, section, key, value, line_no FROM kv2",
    "kv_comments": """
SELECT conv_id AS file, CAST(NULL AS VARCHAR) AS section, role AS key, CAST(length(text) AS VARCHAR) AS value, turn AS line_no
FROM conversations WHERE turn % 5 <> 4""",
    "kv_last_wins": """
SELECT conv_id AS file, role AS key, arg_max(CAST(length(text) AS VARCHAR), turn) AS value, max(turn) AS line_no
FROM conversations WHERE turn % 5 <> 4 GROUP BY conv_id, role""",
    "xml_props": f"""WITH {_KV_SQL}
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY line_no) AS INTEGER) AS line_no, key, value FROM kv2""",
    "block_scan": """
SELECT conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS block, role,
       CAST(turn AS VARCHAR) AS turn FROM conversations""",
    "glob_filter": """
WITH b AS (SELECT page_id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS base FROM pages)
SELECT page_id, base FROM b WHERE NOT (base LIKE '%.html')""",
}
