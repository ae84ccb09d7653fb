"""JSON helpers: double-encoded fields (F14), map lookup (F15), nested paths (F16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_inner(js, outer_path: str, inner_schema: str) -> Column:
    """``jq -r .field | jq ...``: a string field that itself holds JSON.

    ``outer_path`` is a JSONPath (``$.reservations``); the extracted text is parsed
    with ``inner_schema`` (DDL); malformed input gives null.
    """
    return F.from_json(F.get_json_object(_c(js), outer_path), inner_schema)


def map_get(m, key) -> Column:
    """``$map[key]`` with null when absent."""
    k = key if isinstance(key, Column) else F.lit(key)
    return F.try_element_at(_c(m), k)


def path(col, dotted: str) -> Column:
    """``$a.1.b``: nested access, map keys and struct fields by name (F16)."""
    c = _c(col)
    for p in dotted.split("."):
        c = c[p]
    return c
