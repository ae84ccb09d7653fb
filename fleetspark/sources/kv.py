"""Key/value configs (S2), inline assignments, XML property lists (S3) and
blocks of indented keys (S7), all as ``config(file, section, key, value,
line_no)`` rows.

Section and block ids are running values over the file's explicit line order
(W5): ``last(section, ignorenulls)`` / a running count of block headers, in a
window partitioned by file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspark.operators.lines import to_lines

KV_LINE = r"^\s*([^=\s#!;\[][^=]*?)\s*=\s*(.*?)\s*$"
SECTION_LINE = r"^\s*\[([^\]]+)\]\s*$"
COMMENT_LINE = r"^\s*([#!;].*)?$"
BLOCK_LINE = r"^\s+([A-Za-z0-9_.-]+):\s*(.*?)\s*$"


def _unquote(c):
    return F.regexp_replace(c, r"""^(["'])(.*)\1$""", "$2")


def parse_kv_lines(lines: DataFrame, file_col: str = "file", line_col: str = "line",
                   no_col: str = "line_no") -> DataFrame:
    """Lines -> ``config`` rows: blank and ``#``/``!``/``;`` comment lines skipped,
    split on the first ``=``, quotes stripped, ``[section]`` remembered (S2, W5)."""
    w = Window.partitionBy(file_col).orderBy(no_col).rowsBetween(Window.unboundedPreceding, 0)
    sec = F.when(F.col(line_col).rlike(SECTION_LINE), F.regexp_extract(F.col(line_col), SECTION_LINE, 1))
    return kv_columns(lines.withColumn("section", F.last(sec, ignorenulls=True).over(w)), file_col, line_col, no_col)


def kv_columns(tagged: DataFrame, file_col: str, line_col: str, no_col: str) -> DataFrame:
    """``config`` rows of lines that know their ``section``."""
    kv = tagged.where(~F.col(line_col).rlike(COMMENT_LINE) & F.col(line_col).rlike(KV_LINE))
    return kv.select(F.col(file_col).alias("file"), "section",
                     F.regexp_extract(F.col(line_col), KV_LINE, 1).alias("key"),
                     _unquote(F.regexp_extract(F.col(line_col), KV_LINE, 2)).alias("value"),
                     F.col(no_col).alias("line_no"))


def read_kv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Scan key/value config files (one file per config) into ``config`` rows.

    ``wholetext`` keeps each file in one row so its line order is explicit; a
    config file is small, and files are spread over tasks.
    """
    files = spark.read.text(paths, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("text"))
    return parse_kv_lines(to_lines(files, "text", ["file"]))


def inline_assignments(lines: DataFrame, pattern: str, key_cols: Sequence[str]) -> DataFrame:
    """Every ``key = "value"`` match inside lines (group 1 key, group 2 value)."""
    ks = F.regexp_extract_all(F.col("line"), F.lit(pattern), 1)
    vs = F.regexp_extract_all(F.col("line"), F.lit(pattern), 2)
    hits = lines.where(F.col("line").rlike(pattern))
    return hits.select(*key_cols, F.inline(F.arrays_zip(ks.alias("key"), vs.alias("value"))))


def last_wins_config(config: DataFrame, key_cols: Sequence[str] = ("file", "key"),
                     order_col: str = "line_no") -> DataFrame:
    """A key set twice keeps the later value (A4), by ``max_by`` per key."""
    return config.groupBy(*key_cols).agg(
        F.max_by(F.col("value"), F.struct(F.col(order_col), F.col("value"))).alias("value"),
        F.max(order_col).alias(order_col))


def xml_properties(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``<property><name/><value/></property>`` files -> (file, line_no, key, value) (S3).

    Each file is read whole so the document order of its properties is explicit
    (``posexplode`` of the XPath results), never the read order.
    """
    files = spark.read.text(paths, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("xml"))
    return xml_property_strings(files, "xml", ["file"])


def xml_property_strings(df: DataFrame, xml_col: str, key_cols: Sequence[str]) -> DataFrame:
    """Property lists held in a string column -> key/value rows, in document order (S3)."""
    names = F.xpath(F.col(xml_col), F.lit("//property/name/text()"))
    values = F.xpath(F.col(xml_col), F.lit("//property/value/text()"))
    return df.select(*key_cols, F.posexplode(F.arrays_zip(names.alias("key"), values.alias("value"))).alias(
        "pos", "kv")).select(*key_cols, (F.col("pos") + 1).alias("line_no"), F.col("kv.key").alias("key"),
                             F.col("kv.value").alias("value"))


def block_entry():
    """Functions of a line column: whether it is an indented ``key: value``, its key, its value."""
    return (lambda x: x.rlike(BLOCK_LINE)), (lambda x: F.regexp_extract(x, BLOCK_LINE, 1)), (
        lambda x: F.regexp_extract(x, BLOCK_LINE, 2))


def blocks(lines: DataFrame, header: str, file_col: str = "file", line_col: str = "line",
           no_col: str = "line_no", keys: Sequence[str] | None = None) -> DataFrame:
    """Repeated ``header:`` blocks with indented ``key: value`` lines -> one row per
    block (S7).  The block id is a running count of header lines (W5)."""
    w = Window.partitionBy(file_col).orderBy(no_col).rowsBetween(Window.unboundedPreceding, 0)
    is_header = F.trim(F.col(line_col)) == F.lit(header + ":")
    b = lines.withColumn("block", F.sum(F.when(is_header, 1).otherwise(0)).over(w))
    is_entry, key, value = block_entry()
    kv = b.where((F.col("block") > 0) & ~is_header & is_entry(F.col(line_col))).select(
        file_col, "block", key(F.col(line_col)).alias("key"), value(F.col(line_col)).alias("value"), no_col)
    piv = kv.groupBy(file_col, "block").pivot("key", list(keys) if keys else None).agg(
        F.max_by("value", no_col))
    return piv
