"""Graph patterns as joined stars against brute force over sets of triples."""

import random

import pytest

from fleetspark.operators.graph import match_patterns
from fleetspark.operators.stars import match_stars, predicate_sizes
from tests.conftest import rows

SCHEMA = "request_id string, subject string, predicate string, object string"


def solve(triples, patterns, optional=()):
    """Solutions per request by nested loops; optional patterns extend a solution or leave nulls."""
    def extend(solution, pattern, facts):
        for s, p, o in facts:
            if p != pattern[1]:
                continue
            new = dict(solution)
            if all(new.setdefault(t, v) == v if t.startswith("?") else t == v for t, v in ((pattern[0], s), (pattern[2], o))):
                yield new

    names = sorted({t for p in [*patterns, *optional] for t in p if t.startswith("?")})
    out = set()
    for request in {t[0] for t in triples if None not in t}:
        facts = {t[1:] for t in triples if t[0] == request and None not in t}
        solutions = [{}]
        for p in patterns:
            solutions = [n for s in solutions for n in extend(s, p, facts)]
        for p in optional:
            solutions = [n for s in solutions for n in (list(extend(s, p, facts)) or [s])]
        out |= {(request, *[s.get(n) for n in names]) for s in solutions}
    return sorted(out, key=repr)


def graph(seed):
    draw = random.Random(seed)
    made = [(draw.choice(["r1", "r2", "r2"]), draw.choice("abcdef"), draw.choice(["type", "in", "has", "label"]),
             draw.choice(["Node", "a", "b", "c", "d", "x"])) for _ in range(90)]
    return [*made, made[0], made[1], (None, "a", "type", "Node"), ("r1", None, "in", "a"), ("r1", "a", "has", None)]


SETS = [
    ([("?n", "type", "Node"), ("?n", "in", "?d"), ("?d", "has", "?r"), ("?r", "label", "?l")], []),
    ([("?n", "type", "?t"), ("?n", "in", "?t")], []),
    ([("?n", "in", "?n")], []),
    ([("?n", "type", "Node"), ("?n", "has", "?x"), ("?m", "in", "?x"), ("?m", "type", "a")], []),
    ([("?n", "type", "Node")], [("?n", "in", "?d"), ("?d", "label", "?l")]),
    ([("?n", "has", "?x")], [("?n", "label", "Node"), ("?m", "in", "?n")]),
    ([("a", "has", "?x"), ("?x", "in", "?y")], []),
    ([("?object", "has", "?subject"), ("?object", "in", "?predicate")], []),
]


@pytest.mark.parametrize("max_values", [0, 1, 1000])
@pytest.mark.parametrize("case", range(len(SETS)))
def test_against_nested_loops(spark, case, max_values):
    patterns, optional = SETS[case]
    facts = graph(case)
    got = match_stars(spark.createDataFrame(facts, SCHEMA), patterns, optional, max_values=max_values)
    names = sorted({t[1:] for p in [*patterns, *optional] for t in p if t.startswith("?")})
    assert rows(got.select("request_id", *names)) == solve(facts, patterns, optional)


def test_equals_joined_patterns_on_a_set(spark):
    facts = sorted({t for t in graph(11) if None not in t})
    df = spark.createDataFrame(facts, SCHEMA)
    patterns = SETS[0][0]
    cols = ["request_id", "n", "d", "r", "l"]
    assert rows(match_stars(df, patterns).select(*cols)) == rows(match_patterns(df, patterns).select(*cols))


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", object_kind string, n string")
    assert match_stars(df, SETS[0][0]).count() == 0


def test_sizes_show_a_hot_subject(spark):
    facts = [("r", "link", "has", f"i{k}") for k in range(3000)] + [("r", f"n{k}", "has", f"i{k}") for k in range(3000)]
    facts += [("r", "link", "type", "Link")] + [("r", f"n{k}", "type", "Node") for k in range(3000)]
    df = spark.createDataFrame(facts, SCHEMA)
    sizes = predicate_sizes(df, ["has", "type"])
    assert (sizes["has"].most, sizes["has"].subjects, sizes["type"].most) == (3000, 3001, 1)
    patterns = [("?n", "type", "Node"), ("?n", "has", "?i"), ("?l", "has", "?i"), ("?l", "type", "Link")]
    got = match_stars(df, patterns, sizes=sizes)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan  # the hot predicate is joined, not gathered
    assert got.where("l = 'link'").count() == 3000 and got.count() == 3000


def test_one_aggregation_per_star(spark):
    facts = [("r", f"n{k}", p, f"{p}{k}") for k in range(20) for p in ("a", "b", "c", "d")]
    df = spark.createDataFrame(facts, SCHEMA)
    plan = match_stars(df, [("?n", p, f"?{p}") for p in ("a", "b", "c", "d")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    for patterns, optional in (([], []), ([("?a", "?p", "?b")], []), ([("?a", "p", "?b"), ("?c", "p", "?d")], []),
                               ([("?a", "p", "?b")], [("?c", "p", "?d")])):
        with pytest.raises(ValueError):
            match_stars(df, patterns, optional)
