"""Edits and scans that depend on earlier lines (W3, S2, S7), folded inside the text's row.

The twins in ``operators.lines`` and ``sources.kv`` order a file's lines in a
window, so every file is shuffled to one task.  Here a text never leaves its row:

- W3: each line gives one character (matches or not); one left-to-right regular
  expression over these characters is the state machine, since "a matching line
  takes the next one with it" is ``1`` followed by any character.
- S2, S7: the text is cut at its section or block heads into segments, each a
  slice of the line array, so what a head says is known to all its lines.

Work grows with the text's length; there is no window, no shuffle and no state
between rows.  A file must be one row: a null text has no lines, an empty one has
one empty line, and rows that repeat a key are texts of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.text import lines_array
from fleetspark.sources.kv import SECTION_LINE, block_entry, kv_columns

MATCH, OTHER, TRIGGER, EDITED = "1", "0", "t", "e"


def edit_after_match(df: DataFrame, text_col: str, key_cols: Sequence[str], pattern: str,
                     edit: Callable[[Column], Column]) -> DataFrame:
    """``sed '/pattern/!b;n;<edit>'`` (W3) of whole texts: ``line_no``, ``line``, ``edited``."""
    split = df.select(*key_cols, lines_array(F.col(text_col)).alias("_lines"))
    flags = F.array_join(F.transform("_lines", lambda x: F.when(x.rlike(pattern), MATCH).otherwise(OTHER)), "")
    steps = F.split(F.regexp_replace(flags, f"{MATCH}[{MATCH}{OTHER}]", TRIGGER + EDITED), "")
    rows = split.select(*key_cols, F.posexplode(F.arrays_zip(F.col("_lines").alias("line"), steps.alias("step"))).alias("_pos", "_z"))
    hit, line = F.col("_z.step") == EDITED, F.col("_z.line")
    return rows.select(*key_cols, (F.col("_pos") + 1).alias("line_no"), F.when(hit, edit(line)).otherwise(line).alias("line"),
                       hit.alias("edited"))


def segments(df: DataFrame, text_col: str, key_cols: Sequence[str], is_head: Callable[[Column], Column]) -> DataFrame:
    """Texts cut at their head lines: ``segment`` (0: the lines before the first head), ``head`` (null for 0),
    ``head_no`` (its line number, 0 for none) and ``body``, the lines up to the next head."""
    split = df.select(*key_cols, lines_array(F.col(text_col)).alias("_lines"))
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(is_head(x), i + 1)), lambda no: no.isNotNull())
    bounds = split.select(*key_cols, "_lines", F.concat(F.array(F.lit(0)), heads).alias("_heads"))
    bounds = bounds.select(*key_cols, "_lines", F.arrays_zip(
        F.col("_heads").alias("no"), F.concat(F.slice("_heads", F.lit(2), F.size("_heads")), F.array(F.size("_lines") + 1)).alias("next")
    ).alias("_cuts"))
    # the bodies are cut before the segments become rows, so no row carries the whole text
    cut = F.transform("_cuts", lambda c: F.struct(
        c["no"].alias("no"), F.get(F.col("_lines"), c["no"] - 1).alias("head"),
        F.slice(F.col("_lines"), c["no"] + 1, c["next"] - c["no"] - 1).alias("body")))
    return bounds.select(*key_cols, F.posexplode(cut).alias("segment", "_s")).select(
        *key_cols, "segment", F.col("_s.head").alias("head"), F.col("_s.no").alias("head_no"), F.col("_s.body").alias("body"))


def kv_rows(df: DataFrame, text_col: str, file_col: str = "file") -> DataFrame:
    """Key/value texts -> ``config`` rows, as ``sources.kv.parse_kv_lines`` gives them."""
    cut = segments(df, text_col, [file_col], lambda x: x.rlike(SECTION_LINE))
    section = F.when(F.col("segment") > 0, F.regexp_extract("head", SECTION_LINE, 1))
    lines = cut.select(F.col(file_col).alias("file"), section.alias("section"), "head_no", F.posexplode("body").alias("_pos", "line"))
    return kv_columns(lines.withColumn("line_no", F.col("head_no") + F.col("_pos") + 1), "file", "line", "line_no")


def block_rows(df: DataFrame, text_col: str, header: str, keys: Sequence[str], file_col: str = "file") -> DataFrame:
    """``header:`` blocks -> one row per block, as ``sources.kv.blocks`` with ``keys`` gives them."""
    is_entry, key, value = block_entry()
    cut = segments(df, text_col, [file_col], lambda x: F.trim(x) == F.lit(header + ":")).where(F.col("segment") > 0)
    entries = F.transform(F.filter("body", is_entry), lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    found = cut.select(file_col, F.col("segment").cast("long").alias("block"), entries.alias("_entries")).where(F.size("_entries") > 0)

    def last(name: str) -> Column:
        return F.try_element_at(F.filter("_entries", lambda e: e["key"] == name), F.lit(-1))["value"].alias(name)

    return found.select(file_col, "block", *[last(k) for k in keys])
