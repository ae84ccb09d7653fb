"""Predicates as a table, range sweeps, elementary intervals and rule bit vectors against brute force."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.functions.predicate import compile_predicate
from fleetspark.operators import graph, intervals, policy, sweep
from fleetspark.operators.predicate_table import match_predicates, split_predicates, unconditional
from fleetspark.operators.rule_bits import first_match_bits
from fleetspark.plans.q_policy import RULE_SCHEMA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Predicates as a table -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def hosts(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice("ab"), (draw.randint(0, 2), [draw.choice("xyz") for _ in range(draw.randint(0, 2))]),
             draw.choice([None, "0", "1", "2"]), {"k": draw.choice(["x", "y"])}) for i in range(60)]
    return spark.createDataFrame([*rows, (None, "a", (1, []), "1", {}), rows[0]],
                                 "host int, t string, p struct<n:int,l:array<string>>, q string, m map<string,string>")


def some_predicate(draw, depth=0):
    if depth < 3 and draw.random() < 0.6:
        return ["and", *[some_predicate(draw, depth + 1) for _ in range(draw.randint(1, 3))]]
    paths = ["$t", "$p.n", "$p.l.0", "$p.l.1", "$q", "$m.k", "$host"]
    literals = ["a", "b", "x", "y", "0", "1", "2", 1, 'quote"[,@', "z"]
    kind = draw.random()
    sides = [draw.choice(paths if kind < 0.6 or 0.75 <= kind < 0.95 else literals),
             draw.choice(literals if kind < 0.6 or kind >= 0.95 else paths)]
    return [draw.choice(["==", "="]), *sides]


def test_predicate_table_equals_each_predicate_compiled(spark, hosts):
    draw = random.Random(5)
    texts = [(i, json.dumps(some_predicate(draw))) for i in range(80)]
    texts += [(900, ' [ "and" , ["=" ,"$t", "a" ] ] '), (900, ' [ "and" , ["=" ,"$t", "a" ] ] '), (901, '["==","$zz","a"]')]
    texts += [(1000 + i, '["==","$p.n","1"]') for i in range(40)]  # a third of the leases share one predicate
    preds = spark.createDataFrame(texts, "lease int, pred string")
    matches, rejects = match_predicates(preds, "pred", hosts, "host")
    got = sorted((r["lease"], r["host"]) for r in matches.collect())
    split, _ = split_predicates(preds, "pred")
    free = {r["lease"] for r in unconditional(split).collect()}
    checked = [(lease, t) for lease, t in texts if lease != 901 and lease not in free]
    flags = hosts.where("host IS NOT NULL").dropDuplicates(["host"]).select("host", *[
        F.coalesce(compile_predicate(t, hosts), F.lit(False)).alias(f"e{i}") for i, (_, t) in enumerate(checked)]).collect()
    assert got == sorted((lease, r["host"]) for i, (lease, _) in enumerate(checked) for r in flags if r[f"e{i}"])
    assert rejects.count() == 0 and len(got) > 100


def test_predicates_that_are_none(spark, hosts):
    texts = ['["or",["==","$t","a"]]', None, '["==","$t"]', "@", '["and",@]', '["and",["==","$t","a"],"x"]', "", "[]",
             '["==","$t","a"] ["==","$t","b"]', '["and",["==",["==","$t","a"],"b"]]', '["and"' * 9 + "]" * 9]
    preds = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, '["and"]', '["==","@","@"]', '["==","a","b"]'])],
                                  "lease int, pred string")
    matches, rejects = match_predicates(preds, "pred", hosts, "host")
    assert matches.count() == 0 and sorted(r["lease"] for r in rejects.collect()) == list(range(len(texts)))
    split, _ = split_predicates(preds, "pred")
    assert sorted(r["lease"] for r in unconditional(split).collect()) == [len(texts), len(texts) + 1]


def test_no_condition_is_planned_per_predicate(spark, hosts):
    few, many = (spark.createDataFrame([(i, f'["==","$q","{i}"]') for i in range(n)], "lease int, pred string") for n in (3, 3000))
    sizes = [len(plan_of(match_predicates(p, "pred", hosts, "host")[0]).splitlines()) for p in (few, many)]
    assert abs(sizes[0] - sizes[1]) < 10  # joins may pick other sides to broadcast


# Overlapping ranges ------------------------------------------------------------------------------

@pytest.mark.parametrize("max_group_rows", [10**6, 5])
def test_overlaps_equal_listed_addresses(spark, max_group_rows):
    draw = random.Random(7)
    rows = []
    for _ in range(150):
        lo = draw.randint(0, 60)
        rows.append((draw.choice(["g", "g", "h", None]), lo, lo + draw.randint(-1, 12), draw.choice(["a", "b", "c", None])))
    rows += [("g", None, 4, "a"), ("g", 3, None, "a"), rows[0]]
    cover = defaultdict(set)
    for g, lo, hi, owner in rows:
        for x in range(lo, hi + 1) if lo is not None and hi is not None else ():
            cover[g, x].add(owner)
    want = []
    for g in ("g", "h", None):
        start = None
        for x in range(-1, 100):
            here, after = len(cover.get((g, x), ())), len(cover.get((g, x + 1), ()))
            if here != after:
                if here >= 2:
                    want.append((g, start, x, here))
                start = x + 1
    df = spark.createDataFrame(rows, "g string, lo int, hi int, o string")
    out = sweep.range_overlaps(df, ["g"], "lo", "hi", "o", max_group_rows=max_group_rows, n_partitions=5)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert sweep.range_overlaps(df.limit(0), ["g"], "lo", "hi", "o").count() == 0


def test_wide_ranges_list_no_address(spark):
    df = spark.createDataFrame([("g", 0, 1 << 40, "a"), ("g", 5, 1 << 41, "b")], "g string, lo long, hi long, o string")
    assert [tuple(r) for r in sweep.range_overlaps(df, ["g"], "lo", "hi", "o").collect()] == [("g", 5, 1 << 40, 2)]


# Elementary intervals ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def nested(spark):
    draw = random.Random(8)
    starts = [10 << 24, (10 << 24) + (1 << 16), 0, (1 << 32) - (1 << 20)]
    rows = [((draw.choice(starts) + draw.randint(0, 1 << 18)) & 0xFFFFFFFF,
             draw.choice([0, 1, 8, 12, 15, 16, 17, 20, 24, 28, 30, 31, 32, 33, None]), f"a{i}") for i in range(150)]
    prefixes = spark.createDataFrame([*rows, (None, 8, "n"), (10 << 24, 16, None)], "net long, prefix_len int, attr string")
    points = [(i, (draw.choice(starts) + draw.randint(-5, 1 << 18)) & 0xFFFFFFFF) for i in range(2000)]
    points += [(9000 + i, None) for i in range(5)] + [(9200 + i, (10 << 24) + 7) for i in range(1000)]  # one hot address
    return prefixes, spark.createDataFrame(points, "id int, ip long")


@pytest.mark.parametrize("lengths", ["true", "prefix_len >= 16", "prefix_len < 16"])
def test_intervals_equal_a_join_per_length(nested, lengths):
    prefixes, points = nested[0].where(lengths), nested[1]
    want = sorted((tuple(r) for r in policy.most_specific_prefix(points, "ip", prefixes).collect()), key=repr)
    for max_rows in (10**6, 200):
        got = intervals.deepest_prefix(points, "ip", prefixes, max_rows=max_rows)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_addresses_outside_and_empty_tables(spark, nested):
    prefixes, points = nested
    odd = spark.createDataFrame([(1, -1), (2, 1 << 33), (3, None)], "id int, ip long")
    assert {r["attr"] for r in intervals.deepest_prefix(odd, "ip", prefixes).collect()} == {None}
    none = intervals.deepest_prefix(points, "ip", prefixes.limit(0))
    assert none.count() == points.count() and none.where("attr IS NOT NULL").count() == 0
    assert intervals.deepest_prefix(points.limit(0), "ip", prefixes).count() == 0


def test_a_hot_address_is_dealt_over_salts(nested):
    prefixes, points = nested
    segments = intervals.prefix_segments(prefixes)
    text = plan_of(intervals.as_of(points.where("ip IS NOT NULL"), "ip", segments, "deepest", max_rows=100))
    joins = [line for line in text.splitlines() if "Join" in line]
    # the two joins are with the block counts, however many lengths the prefixes have
    assert len(joins) == 2 and all("Broadcast" in j for j in joins) and "_salt" in text


# Rule bit vectors -------------------------------------------------------------------------------

RULES = T.StructType([f for f in RULE_SCHEMA.fields if f.name not in ("seq", "op")] + [T.StructField("rank", T.IntegerType())])
FLOWS = "flow_id int, chain string, iface string, proto string, dst long, dport int, state string, tcp_flags string, syn boolean"
POLICIES = {"A": "DROP", "B": "ACCEPT"}


def random_rules(n, seed, ports, addresses):
    draw = random.Random(seed)

    def maybe(*xs):
        return draw.choice([None, None, *xs])

    out = []
    for i in range(n):
        lo = maybe(draw.randint(0, addresses), draw.randint(0, addresses))
        out.append((draw.choice("AB") if i % 50 else None, maybe("e0", "e1"), maybe("tcp"), lo,
                    None if lo is None else lo + draw.randint(-1, 60), maybe(*draw.sample(range(ports), 2)),
                    maybe(["N"], ["N", "E", None], []), maybe("x", "y"), maybe(True, False),
                    draw.choice(["ACCEPT", "DROP", None]), draw.choice([i, i // 3]) if i % 37 else None))
    return out


def random_flows(n, seed, ports, addresses):
    draw = random.Random(seed)
    return [(i, draw.choice(["A", "B", "B", "C", None]), draw.choice(["e0", "e1", "e2", None]), draw.choice(["tcp", "udp", None]),
             draw.choice([None, *[draw.randint(0, addresses) for _ in range(5)]]), draw.choice([None, *range(ports)]),
             draw.choice(["N", "E", None]), draw.choice(["x", "y", None]), draw.choice([True, False, None])) for i in range(n)]


def first_by_hand(flows, rules):
    order = sorted((r for r in rules if r[0] is not None and r[10] is not None), key=lambda r: (r[10], r[9] is not None, r[9] or ""))
    out = []
    for i, chain, iface, proto, dst, dport, state, flags, syn in flows:
        hit = next((r for r in order if r[0] == chain and r[1] in (None, iface) and r[2] in (None, proto)
                    and (r[3] is None or dst is not None and r[3] <= dst <= r[4]) and r[5] in (None, dport)
                    and (r[6] is None or state is not None and state in r[6]) and r[7] in (None, flags)
                    and (r[8] is None or r[8] == syn)), None)
        policy_verdict = POLICIES.get(chain)
        out.append((i, policy_verdict, None) if hit is None else (i, hit[9] or policy_verdict, hit[10]))
    return out


@pytest.mark.parametrize("n,ports,addresses", [(0, 5, 50), (1, 5, 50), (70, 3, 300), (900, 6, 500), (5000, 3000, 200_000)])
def test_bit_vectors_equal_a_scan_of_the_rules(spark, n, ports, addresses):
    rules, flows = random_rules(n, n, ports, addresses), random_flows(1500, n + 1, ports, addresses)
    policies = spark.createDataFrame(list(POLICIES.items()), "chain string, verdict string")
    out = first_match_bits(spark.createDataFrame(flows, FLOWS), spark.createDataFrame(rules, RULES), policies)
    got = [(r["flow_id"], r["verdict"], r["rule_rank"]) for r in out.orderBy("flow_id").collect()]
    assert got == first_by_hand(flows, rules)
    joins = sum("Join" in line for line in plan_of(out).splitlines())
    assert joins <= 7 + 9 + 1  # dimensions, sizes of address blocks, the rules' verdicts


def test_bounds_are_checked(spark):
    rules = spark.createDataFrame(random_rules(200, 3, 5, 50), RULES)
    flows = spark.createDataFrame(random_flows(5, 3, 5, 50), FLOWS)
    policies = spark.createDataFrame(list(POLICIES.items()), "chain string, verdict string")
    for bound in ({"max_rules": 20}, {"max_bytes": 100}):
        with pytest.raises(ValueError, match="strategy='join'"):
            first_match_bits(flows, rules, policies, **bound)


@pytest.mark.parametrize("n,ports,addresses,options", [
    (21_000, 3000, 200_000, {}), (300, 2, 100, {"slice_rules": 40}), (300, 3, 300, {"broadcast_bytes": 0})])
def test_a_list_of_any_length_is_taken(spark, n, ports, addresses, options):
    rules, flows = random_rules(n, 7, ports, addresses), random_flows(150, 8, ports, addresses)
    policies = spark.createDataFrame(list(POLICIES.items()), "chain string, verdict string")
    out = first_match_bits(spark.createDataFrame(flows, FLOWS), spark.createDataFrame(rules, RULES), policies, **options)
    got = [(r["flow_id"], r["verdict"], r["rule_rank"]) for r in out.orderBy("flow_id").collect()]
    assert got == first_by_hand(flows, rules)


def test_what_lies_before_the_sweeps_runs_once(spark):
    df = spark.createDataFrame([("g", 0, 9, "a"), ("g", 5, 12, "b")], "g string, lo long, hi long, o string")
    out = sweep.range_overlaps(df, ["g"], "lo", "hi", "o")
    text = plan_of(out)
    assert "FileScan" in text and "ExistingRDD" not in text and "LocalTableScan" not in text
    assert [tuple(r) for r in out.collect()] == [("g", 5, 9, 2)]


def test_an_address_is_split_once(spark):
    triples = [("r", "n", "type", "Node"), ("r", "n", "hasInterface", "i"), ("r", "l", "hasInterface", "i"),
               ("r", "l", "type", "BroadcastConnection"), ("r", "i", "localIPAddress", "a"), ("r", "a", "label_ID", "10.0.0.7")]
    df = spark.createDataFrame(triples, "request_id string, subject string, predicate string, object string")
    out = graph.node_link_ips(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [tuple(r) for r in out.collect()] == [("r", "n", "l", "10.0.0.7", (10 << 24) + 7)]
