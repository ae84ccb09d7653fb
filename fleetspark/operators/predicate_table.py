"""Predicates given as a table (P4 for many leases at once): a counting match by equality joins.

``compile_predicate`` folds one predicate into a filter.  Here every lease brings its own:

1. ``split_predicates`` takes each text apart with regular expressions: the equality leaves
   become conjuncts, and what is left must be nested ``and`` lists, else the row is a reject;
2. leases with the same set of conjuncts share one *class*, so a predicate that a third of the
   leases use is matched once;
3. ``host_facts`` lists each host's (path, value) rows, nested properties included;
4. of each class the conjunct that the fewest hosts hold brings its hosts in by one equality join;
   a candidate stays if all conjuncts of its class hold on the host's own row (a count
   equal to the predicate's), in a semi join on the host's id;
5. the classes' hosts go back to their leases.

No condition is written per predicate, and only hosts of a class's rarest conjunct are looked at, so
the work grows with facts, conjuncts and matches.  Comparisons are those of ``compile_predicate``:
string forms, a null property equals nothing.

Defined results: a predicate without conjuncts (``["and"]``) holds for every host and is not
expanded; ``unconditional`` lists such leases.  A path that a host lacks fails there.  A lease row
that repeats comes out as often as it repeats; a host id that repeats matches if one of its rows does, and
comes out once; null host ids match nothing.  Nesting deeper than ``MAX_DEPTH`` is a reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.operators.sizing import write_once

MAX_DEPTH = 8
_STRING = r'"(?:[^"\\]|\\.)*"'
_OPERAND = rf'({_STRING}|-?\d[\d.eE+-]*|true|false|null)'
_LEAF = rf'\[\s*"==?"\s*,\s*{_OPERAND}\s*,\s*{_OPERAND}\s*\]'
_ALL_OF = r'\[\s*"and"\s*(?:,\s*@\s*)*\]'
_CONJUNCTS = "array<struct<path:string,other:string,value:string>>"


def _literal(json_text: Column) -> Column:
    """The string form of a JSON operand."""
    return F.coalesce(F.get(F.from_json(F.concat(F.lit("["), json_text, F.lit("]")), "array<string>"), 0), F.lit("null"))


def split_predicates(preds: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``conjuncts``, rejects).

    A conjunct is (path, '', value), or (path, other path, '') for two paths; an equality of two
    literals is left out where it holds, and is the path '' (which no host has) where it does not.
    """
    text = F.col(text_col)
    # @ stands for a part already recognised; outside strings the text has none of its own
    own = F.regexp_replace(text, _STRING, "").contains("@")
    rest = F.regexp_replace(text, _LEAF, "@")
    for _ in range(MAX_DEPTH):
        rest = F.regexp_replace(rest, _ALL_OF, "@")
    valid = F.coalesce((F.trim(rest) == "@") & ~own, F.lit(False))
    leaves = F.arrays_zip(F.regexp_extract_all(text, F.lit(_LEAF), F.lit(1)).alias("a"),
                          F.regexp_extract_all(text, F.lit(_LEAF), F.lit(2)).alias("b"))

    def conjunct(leaf: Column) -> Column:
        a, b = _literal(leaf["a"]), _literal(leaf["b"])
        is_path = [s.startswith('"$') & (F.length(x) > 1) for s, x in ((leaf["a"], a), (leaf["b"], b))]
        name = [F.substr(x, F.lit(2)) for x in (a, b)]
        none = F.lit("")
        return (F.when(is_path[0] & is_path[1], F.struct(F.least(*name).alias("path"), F.greatest(*name).alias("other"),
                                                         none.alias("value")))
                .when(is_path[0], F.struct(name[0].alias("path"), none.alias("other"), b.alias("value")))
                .when(is_path[1], F.struct(name[1].alias("path"), none.alias("other"), a.alias("value")))
                .when(a != b, F.struct(none.alias("path"), none.alias("other"), none.alias("value"))))

    parts = F.array_sort(F.array_distinct(F.filter(F.transform(leaves, conjunct), lambda c: c.isNotNull())))
    return (preds.where(valid).withColumn("conjuncts", parts.cast(_CONJUNCTS)), preds.where(~valid))


def unconditional(split: DataFrame) -> DataFrame:
    """The rows of ``split_predicates`` whose predicate holds for every host."""
    return split.where(F.size("conjuncts") == 0).drop("conjuncts")


def _facts(value: Column, kind: T.DataType, path: Column) -> Column:
    """array<struct<path, value>> of a column's leaves."""
    none = F.array().cast("array<struct<path:string,value:string>>")
    if isinstance(kind, T.StructType):
        inner = [_facts(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.concat(*inner) if inner else none
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x, i: _facts(x, kind.elementType, F.concat(path, F.lit("."), i.cast("string"))))
        return F.coalesce(F.flatten(each), none)
    if isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(value), lambda e: _facts(
            e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))
        return F.coalesce(F.flatten(each), none)
    one = F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))
    return F.when(value.isNotNull(), one).otherwise(none)


def host_facts(hosts: DataFrame, host_col: str) -> DataFrame:
    """One row per row of ``hosts``: its id and ``facts``, the (path, value) of every property that is not null."""
    every = F.concat(*[_facts(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in hosts.schema.fields])
    return hosts.where(F.col(host_col).isNotNull()).select(F.col(host_col).alias("_host"), every.alias("facts"))


def _holds(conjuncts: Column, properties: Column) -> Column:
    """Whether as many conjuncts hold as there are."""
    def of(path):
        return F.try_element_at(properties, path)

    met = F.filter(conjuncts, lambda c: F.when(c["other"] == "", of(c["path"]) == c["value"]).otherwise(
        of(c["path"]) == of(c["other"])))
    return F.size(met) == F.size(conjuncts)


def match_predicates(preds: DataFrame, text_col: str, hosts: DataFrame, host_col: str) -> tuple[DataFrame, DataFrame]:
    """(matches, rejects): the rows of ``preds`` with the id (``host_col``) of every host that meets their predicate."""
    split, rejects = split_predicates(preds, text_col)
    # no host has the path '', so a class that needs it has no match
    usable = split.where((F.size("conjuncts") > 0) & ~F.exists("conjuncts", lambda c: c["path"] == ""))
    classed = usable.withColumn("_class", F.sha2(F.to_json("conjuncts"), 256))
    classes = write_once(classed.groupBy("_class").agg(F.first("conjuncts").alias("conjuncts")), "predicate-classes")
    rows = write_once(host_facts(hosts, host_col), "host-facts")
    facts = rows.select("_host", F.explode("facts").alias("f")).select("_host", "f.path", "f.value")

    wanted = classes.select("_class", F.explode("conjuncts").alias("c")).where("c.other = ''").select(
        "_class", "c.path", "c.value")
    held = facts.join(wanted.select("path", "value").distinct(), ["path", "value"], "left_semi").distinct()
    sizes = held.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"))
    # a conjunct that no host holds drops out here and is met nowhere below
    rarest = wanted.join(sizes, ["path", "value"]).groupBy("_class").agg(
        F.min(F.struct("n", "path", "value")).alias("r")).select("_class", "r.path", "r.value")
    found = rarest.join(held, ["path", "value"]).select("_class", "_host")

    # classes that only compare paths: hosts by the pair of paths with one value
    pairs = classes.where(~F.exists("conjuncts", lambda c: c["other"] == "")).select(
        "_class", F.get("conjuncts", 0).alias("c")).select("_class", "c.path", "c.other")
    ends = pairs.select("path", "other").distinct()
    alike = (facts.join(ends, "path").select("_host", "path", "other", "value")
             .join(facts.select("_host", F.col("path").alias("other"), "value"), ["_host", "other", "value"])
             .select("path", "other", "_host").distinct())
    found = found.unionByName(pairs.join(alike, ["path", "other"]).select("_class", "_host"))

    properties = rows.select(F.col("_host").alias("_id"), F.map_from_entries(F.col("facts")).alias("_properties"))
    kept = found.join(classes, "_class").join(
        properties, (F.col("_host") == F.col("_id")) & _holds(F.col("conjuncts"), F.col("_properties")), "left_semi")
    matches = classed.drop("conjuncts").join(kept.select("_class", "_host"), "_class").drop("_class")
    return matches.withColumnRenamed("_host", host_col), rejects
