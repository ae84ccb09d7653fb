"""Web access log in the declared ``main`` format.

``$remote_addr - $remote_user [$time_local] "$request" $status
$body_bytes_sent "$http_referer" "$http_user_agent" "$http_x_forwarded_for"``

One anchored regex decides on a line; its fields are cut off at blanks and quotes, the local
time is parsed with its zone and kept as a UTC ``TIMESTAMP_NTZ``.  Lines that
do not match go to the rejects DataFrame, never silently dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# nginx writes a double quote inside a field as \x22, so a quoted field is [^"]*
MAIN_FORMAT = (r'^(\S+) - (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-) '
               r'"([^"]*)" "([^"]*)" "([^"]*)"$')
FIELDS = ["remote_addr", "remote_user", "time_local", "request", "status", "body_bytes_sent",
          "referer", "user_agent", "x_forwarded_for"]


def local_time_to_utc(text) -> F.Column:
    """``10/Oct/2000:13:55:36 -0700`` -> UTC TIMESTAMP_NTZ."""
    c = F.col(text) if isinstance(text, str) else text
    stamp = F.try_to_timestamp(F.regexp_extract(c, r"^(\S+)", 1), F.lit("dd/MMM/yyyy:HH:mm:ss")).cast("timestamp_ntz")
    zone = F.regexp_extract(c, r"([+-])(\d{2})(\d{2})$", 0)
    sign = F.when(F.substr(zone, F.lit(1), F.lit(1)) == "-", F.lit(-1)).otherwise(F.lit(1))
    minutes = (F.substr(zone, F.lit(2), F.lit(2)).try_cast("int") * 60
               + F.substr(zone, F.lit(4), F.lit(2)).try_cast("int"))
    offset = F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(sign * minutes, F.lit(0)))
    return stamp - offset


def parse_access_log(lines: DataFrame, line_col: str = "value", keep_cols=()) -> tuple[DataFrame, DataFrame]:
    """Split into (parsed, rejects).  ``parsed`` has the nine declared fields.

    The long pattern is tried once a line.  In a line of that form blanks end the first fields,
    and the others are counted off by quotes from its end, where no field holds one.
    """
    line = F.col(line_col)
    head = F.split(line, " ", 4)  # address, '-', user, the rest from '[' on
    time = local_time_to_utc(F.substring_index(F.substr(head[3], F.lit(2)), "]", 1))
    quoted = F.split(line, '"')
    numbers = F.split(F.trim(F.element_at(quoted, -7)), " ")
    # a line of the right form whose date is none is a reject, not an error
    formed = F.coalesce(line.rlike(MAIN_FORMAT), F.lit(False))
    fields = F.struct(
        head[0].alias("remote_addr"),
        head[2].alias("remote_user"),
        F.when(formed, time).alias("time_local"),
        F.element_at(quoted, -8).alias("request"),
        numbers[0].try_cast("int").alias("status"),
        F.when(numbers[1] != "-", numbers[1].try_cast("bigint")).alias("body_bytes_sent"),
        F.element_at(quoted, -6).alias("referer"),
        F.element_at(quoted, -4).alias("user_agent"),
        F.element_at(quoted, -2).alias("x_forwarded_for"),
    )
    # one row a line through a generator: a filter on its output stays above it, so a line is taken apart once
    taken = lines.select(*keep_cols, line.alias("_line"), F.inline(F.array(F.when(formed, fields))))
    parsed = taken.where(F.col("time_local").isNotNull()).drop("_line")
    stamped = lines.select("*", F.explode(F.array(F.when(formed, time))).alias("_time"))
    rejects = stamped.where(F.col("_time").isNull()).drop("_time")
    return parsed, rejects


def read_access_log(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Scan access-log files (one record per line) into (parsed, rejects)."""
    return parse_access_log(spark.read.text(paths), "value")
