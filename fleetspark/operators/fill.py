"""Placeholders filled from a table of parameters (F5 per host).

``fill_placeholders`` folds one literal list into every text; here each host has its own parameters, as rows
(host, name, value).  A text is split at its placeholders, the names are looked up among its host's
parameters, and pieces and values are joined again, in one pass: a value that looks like a placeholder is
not filled in turn.  A name its host has no parameter for (or a null value) stays as it is, for the audit of
leftovers (F6).  Of several rows of one (host, name) the last by ``order_cols`` wins, ties by value.

Hosts with up to ``max_names`` names get one map row, joined to their texts (broadcast when the maps are
counted small).  Beyond it no map is built: a text's own distinct names are looked up row by row, on (host,
name), and gathered per text, so nothing grows with the host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.operators.audit import PLACEHOLDER
from fleetspark.operators.sizing import DEFAULT_BROADCAST_ROWS

MAX_NAMES = 10_000


def fill_from_map(text: Column | str, values: Column | str, pattern: str = PLACEHOLDER) -> Column:
    """``text`` with every match of ``pattern`` (group 1: the name) replaced by its entry of the map ``values``."""
    text = F.col(text) if isinstance(text, str) else text
    values = F.col(values) if isinstance(values, str) else values
    pieces = F.split(text, pattern, -1)
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    wholes = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    filled = F.zip_with(names, wholes, lambda n, w: F.coalesce(F.try_element_at(values, n), w))
    return F.array_join(F.zip_with(pieces, filled, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def last_parameters(params: DataFrame, host_col: str, name_col: str, value_col: str,
                    order_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (``_host``, ``_name``) with ``_value``; rows without a host or a name are dropped."""
    rows = params.select(F.col(host_col).alias("_host"), F.col(name_col).alias("_name"),
                         F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                                  F.col(value_col).alias("_value")).alias("_last"))
    rows = rows.where(F.col("_host").isNotNull() & F.col("_name").isNotNull())
    return rows.groupBy("_host", "_name").agg(F.max("_last")["_value"].alias("_value")).where(F.col("_value").isNotNull())


def fill_from_table(texts: DataFrame, params: DataFrame, host_col: str, key_cols: Sequence[str], text_col: str = "text",
                    param_host_col: str | None = None, name_col: str = "name", value_col: str = "value",
                    order_cols: Sequence[str] = (), pattern: str = PLACEHOLDER, out_col: str = "filled",
                    max_names: int = MAX_NAMES) -> DataFrame:
    """``texts`` with ``out_col``, its text filled from its host's parameters.

    ``key_cols`` names a text (only used for hosts beyond ``max_names``; rows that repeat a key with the same
    host and text are one text there too, and each keeps its row).  A text of a null host is returned as it
    is, a null text as null.
    """
    last = last_parameters(params, param_host_col or host_col, name_col, value_col, order_cols)
    sizes = last.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
    seen = sizes.agg(F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    most, total = seen["most"] or 0, seen["rows"] or 0
    columns = [*[F.col(c) for c in texts.columns if c != out_col]]

    small = last if most <= max_names else last.join(sizes.where(F.col("_n") <= max_names).select("_host"), "_host", "left_semi")
    maps = small.groupBy("_host").agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("_map"))
    if total <= DEFAULT_BROADCAST_ROWS:
        maps = F.broadcast(maps)
    out = texts.join(maps, F.col(host_col) == F.col("_host"), "left").drop("_host")
    if most > max_names:
        large = last.join(sizes.where(F.col("_n") > max_names).select("_host"), "_host", "left_semi")
        keys = [*key_cols, host_col]
        asked = texts.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(
            F.col(text_col), F.lit(pattern), F.lit(1)))).alias("_asked")).distinct()
        found = asked.join(large, (F.col(host_col) == F.col("_host")) & (F.col("_asked") == F.col("_name"))).groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("_own"))
        found = found.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(keys)})
        same = F.col(f"_k{len(keys) - 1}") == F.col(host_col)
        for i, c in enumerate(key_cols):
            same = same & F.col(f"_k{i}").eqNullSafe(F.col(c))
        out = out.join(found, same, "left").withColumn("_map", F.coalesce("_own", "_map"))
    filled = F.when(F.col("_map").isNull(), F.col(text_col)).otherwise(fill_from_map(text_col, "_map", pattern))
    return out.select(*columns, filled.alias(out_col))
