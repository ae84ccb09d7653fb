"""Graph patterns as joined stars (J3, J4 on scanned triples).

The patterns that share a subject form a star.  A star is one aggregation over
``triples`` by (request, subject): a constant object becomes a flag, a variable
object the smallest value where a subject never has two, else the set of its
values, which is then exploded.  Stars are joined on their shared variables,
smallest counted size first, so a pattern set costs one scan and one shuffle per
star where :func:`~fleetspark.operators.graph.match_patterns` costs one of each
per pattern.

One counting job comes first: rows, subjects and the largest number of values of
a subject, per predicate.  A predicate some subject has more than ``max_values``
of (a link with a third of all interfaces) is never gathered into a set: it stays
a frame of its own and is joined like a star.

Triples are a set: a repeated triple counts once, and one with a null in
request, subject, predicate or object is none.  Every variable becomes a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.operators.graph import Pattern, _is_var

# A subject with up to this many values of a predicate is folded in one aggregation buffer.
MAX_VALUES = 1_000


@dataclass
class PredicateSize:
    rows: int = 0
    subjects: int = 0
    most: int = 0  # values of one subject, repeated triples included


@dataclass
class Star:
    """The patterns of one subject that one aggregation answers."""
    subject: str
    required: list[Pattern] = field(default_factory=list)
    optional: list[Pattern] = field(default_factory=list)


def _clean(triples: DataFrame, request_col: str) -> DataFrame:
    return triples.select(request_col, "subject", "predicate", "object").dropna()


def predicate_sizes(triples: DataFrame, predicates: Sequence[str], request_col: str = "request_id") -> dict[str, PredicateSize]:
    """Counts of each named predicate, in one job; one row per predicate reaches the driver."""
    wanted = sorted(set(predicates))
    per_subject = (_clean(triples, request_col).where(F.col("predicate").isin(wanted))
                   .groupBy("predicate", request_col, "subject").agg(F.count(F.lit(1)).alias("n")))
    found = per_subject.groupBy("predicate").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("subjects"),
                                                 F.max("n").alias("most")).collect()
    sizes = {p: PredicateSize() for p in wanted}
    sizes.update({r["predicate"]: PredicateSize(r["rows"], r["subjects"], r["most"]) for r in found})
    return sizes


def _check(pattern: Pattern) -> None:
    if _is_var(pattern[1]):
        raise ValueError(f"pattern {pattern}: a star needs a fixed predicate; use match_patterns")


def _variables(pattern: Pattern) -> set[str]:
    return {t[1:] for t in pattern if _is_var(t)}


def _frame(triples: DataFrame, pattern: Pattern, request_col: str) -> DataFrame:
    """The distinct bindings of one pattern."""
    subject, predicate, obj = pattern
    rows = _clean(triples, request_col).where(F.col("predicate") == predicate)
    if not _is_var(subject):
        rows = rows.where(F.col("subject") == subject)
    if not _is_var(obj):
        rows = rows.where(F.col("object") == obj)
    elif obj == subject:
        rows = rows.where(F.col("subject") == F.col("object"))
    named = {t[1:]: c for t, c in ((obj, "object"), (subject, "subject")) if _is_var(t)}
    return rows.select(request_col, *[F.col(c).alias(v) for v, c in named.items()]).distinct()


def _star_frame(triples: DataFrame, star: Star, sizes: dict[str, PredicateSize], request_col: str) -> DataFrame:
    """The distinct bindings of one star: one scan, one aggregation."""
    rows = _clean(triples, request_col).where(
        F.col("predicate").isin(sorted({p for _, p, _ in [*star.required, *star.optional]})))
    if not _is_var(star.subject):
        rows = rows.where(F.col("subject") == star.subject)
    aggs, flags, values = [], [], []
    for i, pattern in enumerate([*star.required, *star.optional]):
        _, predicate, obj = pattern
        here = F.col("predicate") == predicate
        needed = i < len(star.required)
        name = f"_v{i}"
        if not _is_var(obj) or obj == star.subject:
            same = F.col("subject") if _is_var(obj) else F.lit(obj)
            aggs.append(F.max(here & (F.col("object") == same)).alias(name))
            flags.append(name)
            continue
        single = sizes[predicate].most <= 1
        value = F.when(here, F.col("object"))
        aggs.append((F.min(value) if single else F.collect_set(value)).alias(name))
        values.append((name, obj[1:], single, needed))
    out = rows.groupBy(request_col, F.col("subject").alias("_s")).agg(*aggs)
    for name in flags:
        out = out.where(F.col(name))
    bound: set[str] = set()
    for name, variable, single, needed in values:
        if needed:
            out = out.where(F.col(name).isNotNull() if single else F.size(name) > 0)
        if variable in bound:  # the same object variable twice in a star
            out = out.where((F.col(name) == F.col(variable)) if single else F.array_contains(name, F.col(variable)))
        elif single:
            out = out.withColumn(variable, F.col(name))
        else:
            out = out.withColumn(variable, F.explode(name) if needed else F.explode_outer(name))
        bound.add(variable)
    subject = [F.col("_s").alias(star.subject[1:])] if _is_var(star.subject) else []
    out = out.select(request_col, *subject, *[F.col(v) for v in sorted(bound)])
    return out if subject else out.distinct()


def match_stars(triples: DataFrame, patterns: Sequence[Pattern], optional: Sequence[Pattern] = (),
                request_col: str = "request_id", max_values: int = MAX_VALUES,
                sizes: dict[str, PredicateSize] | None = None) -> DataFrame:
    """Distinct solutions of a basic graph pattern, with ``optional`` patterns as left joins.

    ``sizes`` (of :func:`predicate_sizes`) saves the counting job where a caller matches several pattern
    sets over the same triples.  A disconnected pattern set raises instead of becoming a cross join.
    """
    if not patterns:
        raise ValueError("need at least one pattern")
    for pattern in [*patterns, *optional]:
        _check(pattern)
    if sizes is None:
        sizes = predicate_sizes(triples, [p for _, p, _ in [*patterns, *optional]], request_col)
    required_vars = set().union(*[_variables(p) for p in patterns])

    stars: dict[str, Star] = {}
    parts: list[tuple[int, set[str], DataFrame]] = []  # counted size, variables, bindings
    for pattern in dict.fromkeys(patterns):
        subject, predicate, obj = pattern
        if _is_var(obj) and obj != subject and sizes[predicate].most > max_values:
            parts.append((sizes[predicate].rows, _variables(pattern), _frame(triples, pattern, request_col)))
        else:
            stars.setdefault(subject, Star(subject)).required.append(pattern)

    late: list[Pattern] = []  # optional patterns that are joined after everything else
    bound = set(required_vars)
    for pattern in dict.fromkeys(optional):
        subject, predicate, obj = pattern
        new = _variables(pattern) - bound
        if not _variables(pattern) & bound:
            raise ValueError(f"optional pattern {pattern} shares no variable")
        if not new:
            continue  # it binds nothing, and an optional pattern never drops a solution
        if subject in stars and obj[1:] in new and sizes[predicate].most <= max_values:
            stars[subject].optional.append(pattern)
        else:
            late.append(pattern)
        bound |= new

    for star in stars.values():
        n = min(sizes[p].subjects for _, p, _ in star.required)
        variables = set().union(*[_variables(p) for p in [*star.required, *star.optional]])
        parts.append((n, variables, _star_frame(triples, star, sizes, request_col)))

    parts.sort(key=lambda x: x[0])
    _, known, out = parts.pop(0)
    known = set(known)
    while parts:
        at = next((i for i, (_, variables, _) in enumerate(parts) if variables & known or not variables), None)
        if at is None:
            raise ValueError("patterns fall into parts that share no variable (would be a cross join)")
        _, variables, frame = parts.pop(at)
        shared = sorted(variables & known)
        out = out.join(frame, [request_col, *shared], "inner" if variables - known else "left_semi")
        known |= variables
    for pattern in late:
        frame = _frame(triples, pattern, request_col)
        out = out.join(frame, [request_col, *sorted(_variables(pattern) & known)], "left")
        known |= _variables(pattern)
    return out
