"""Predicates given as data (P4), globs (P5, P8), first-true mappings (P6),
threshold bands (P12).

``compile_predicate`` folds a prefix-array expression such as
``["and", ["==", "$node_type", "gpu_large"], ["==", "$a.1.b", "True"]]``
into one ordinary ``Column`` on the driver, so Catalyst sees a normal filter
and pushes it into the scan.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORTED_OPERATORS = ("and", "==", "=")


class PredicateError(ValueError):
    pass


def _resolve_path(path: str, schema: T.StructType | None) -> Column:
    parts = path.split(".")
    col = F.col(parts[0]) if schema is None else F.col(f"`{parts[0]}`")
    dtype = None
    if schema is not None:
        names = {f.name: f.dataType for f in schema.fields}
        if parts[0] not in names:
            raise PredicateError(f"unresolved name ${parts[0]}")
        dtype = names[parts[0]]
    for p in parts[1:]:
        if isinstance(dtype, T.ArrayType):
            col = F.get(col, int(p))
            dtype = dtype.elementType
        elif isinstance(dtype, T.StructType):
            col = col.getField(p)
            dtype = {f.name: f.dataType for f in dtype.fields}.get(p)
        elif isinstance(dtype, T.MapType):
            col = F.try_element_at(col, F.lit(p).cast(dtype.keyType))
            dtype = dtype.valueType
        else:
            col = col[p]
            dtype = None
    return col


def _literal_text(v) -> str:
    if isinstance(v, str):
        return v
    return json.dumps(v)


def compile_predicate(expr, df: DataFrame | None = None) -> Column:
    """Compile a prefix-array predicate to a Column.

    ``$name`` / ``$a.1.b`` are (nested) column paths, anything else is a
    literal; equality compares the string forms (``"True"`` is not ``true``).
    Unknown operators raise :class:`PredicateError`.
    """
    if isinstance(expr, str):
        expr = json.loads(expr)
    schema = df.schema if df is not None else None

    def operand(x) -> Column:
        if isinstance(x, str) and x.startswith("$") and len(x) > 1:
            return _resolve_path(x[1:], schema).cast("string")
        return F.lit(_literal_text(x))

    def walk(e) -> Column:
        if not isinstance(e, list) or not e:
            raise PredicateError(f"not a predicate: {e!r}")
        op = e[0]
        if op == "and":
            parts = [walk(x) for x in e[1:]]
            return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
        if op in ("==", "="):
            if len(e) != 3:
                raise PredicateError(f"{op} takes two operands: {e!r}")
            return operand(e[1]) == operand(e[2])
        raise PredicateError(f"unknown operator {op!r}")

    return walk(expr)


def unresolved_names(expr, df: DataFrame) -> list[str]:
    """``$names`` in the predicate that are not columns of ``df`` (a quoting slip
    such as a single-quoted ``$PHYSICAL`` shows up here)."""
    if isinstance(expr, str):
        expr = json.loads(expr)
    cols = set(df.columns)
    out: list[str] = []

    def walk(e):
        if isinstance(e, list):
            for x in e[1:]:
                walk(x)
        elif isinstance(e, str) and e.startswith("$"):
            root = e[1:].split(".")[0]
            if root not in cols:
                out.append(e)

    walk(expr)
    return out


def _bracket_end(glob: str, start: int) -> int:
    """Index of the ``]`` that closes the bracket expression at ``start``, -1 if none does (a ``]`` in first place is a member)."""
    first = start + 2 if glob[start + 1:start + 2] in ("!", "^") else start + 1
    return glob.find("]", first + 1)


def glob_to_regex(glob: str) -> str:
    """Shell glob -> anchored Java regex (``*`` any run, ``?`` one char, ``[a-c]`` one of, ``[!a-c]`` none of)."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        end = _bracket_end(glob, i) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            members = glob[i + 1:end]
            negated = members[:1] in ("!", "^")
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", members[negated:])
            out.append(f"[{'^' if negated else ''}{inner}]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return "^(?s)" + "".join(out) + "$"


def matches_glob(col, glob: str) -> Column:
    """``[[ $x == pattern ]]`` (P5, P8): equality without wildcards, prefix test for
    ``abc*``, regex otherwise."""
    c = F.col(col) if isinstance(col, str) else col
    if not any(ch in glob for ch in "*?["):
        return c == F.lit(glob)
    if glob.endswith("*") and not any(ch in glob[:-1] for ch in "*?["):
        return c.startswith(glob[:-1])
    return c.rlike(glob_to_regex(glob))


def first_true(cases) -> Column:
    """if / elif chain without else (P6): the first true branch wins, no match is null."""
    out = None
    for cond, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def threshold_band(pct, warn: float = 80, crit: float = 90) -> Column:
    """ok / warn (>= warn) / critical (>= crit) (P12); null stays null."""
    c = F.col(pct) if isinstance(pct, str) else pct
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(c >= crit, "critical").when(c >= warn, "warn").otherwise("ok"))
