"""Placeholders per host, daemon lists and the order of several listing files."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetspark.operators.audit import PLACEHOLDER, start_order, stop_order
from fleetspark.operators.fill import fill_from_table
from fleetspark.sources.listings import host_map, read_listing
from tests.conftest import rows

TEXTS = "id int, host string, text string, note string"
PARAMS = "host string, name string, value string, seq int"


def by_hand(texts, params):
    last = {}
    for host, name, value, seq in params:
        if host is not None and name is not None:
            key = (seq is not None, seq or 0, value is not None, value or "")
            if key >= last.get((host, name), ((),))[0]:
                last[host, name] = (key, value)
    values = {k: v for k, (_, v) in last.items() if v is not None}
    return sorted(((i, h, None if t is None else re.sub(PLACEHOLDER, lambda m: values.get((h, m[1]), m[0]), t))
                   for i, h, t, _ in texts), key=repr)


def made(seed, n):
    draw = random.Random(seed)
    names = ["A", "B_C", "D", "EE"]
    bits = ["<A>", "<B_C>", "<D>", "<EE>", "<none>", "<", ">", " x ", "\n", "é", "<<A>>", "$1", "\\1"]
    texts = [(i, draw.choice(["h1", "h1", "h2", "h3", None]), "".join(draw.choice(bits) for _ in range(draw.randint(0, 9))), "n")
             for i in range(n)]
    params = [(draw.choice(["h1", "h1", "h2", None]), draw.choice([*names, None]), draw.choice(["v", "<D>", "", "$0", "a\\b", None]),
               draw.choice([1, 2, 3, None])) for _ in range(25)]
    return [*texts, texts[0], (None, "h1", "<A>", None), (n, "h1", None, ""), (n + 1, "h1", "", None),
            (n + 2, "h1", "<A> " * 50_000, None)], params


@pytest.mark.parametrize("max_names", [0, 1, 2, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_substitution(spark, seed, max_names):
    texts, params = made(seed, 60)
    got = fill_from_table(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(params, PARAMS), "host", ["id"],
                          order_cols=["seq"], max_names=max_names)
    assert got.columns == ["id", "host", "text", "note", "filled"]
    assert rows(got, "id", "host", "filled") == by_hand(texts, params)


def test_empty_tables(spark):
    texts, params = made(3, 5)
    t, p = spark.createDataFrame(texts, TEXTS), spark.createDataFrame(params, PARAMS)
    assert fill_from_table(t.limit(0), p, "host", ["id"]).count() == 0
    assert rows(fill_from_table(t, p.limit(0), "host", ["id"]), "id", "host", "filled") == sorted(
        ((i, h, x) for i, h, x, _ in texts), key=repr)


DAEMONS = [("r1", "zebra", 1, 1), ("r1", "bgpd", 2, 2), ("r1", "ospfd", 3, 2), ("r1", "vtysh_enable", 4, 2), ("r1", "ripd", 5, 0)]


def test_daemon_lists(spark):
    df = spark.createDataFrame(DAEMONS, "host string, daemon string, pos int, prio int")
    names = lambda out, seq: [r["daemon"] for r in out.orderBy(seq).collect()]
    args = (df, "host", "daemon", "pos", "prio")
    assert names(start_order(*args), "start_seq") == ["zebra", "bgpd", "ospfd"]  # vtysh_enable is a setting
    assert names(stop_order(*args), "stop_seq") == ["bgpd", "ospfd", "zebra", "ripd"]
    assert names(start_order(*args, daemon_list=["ospfd", "bgpd", "ripd"]), "start_seq") == ["ospfd", "bgpd"]
    assert names(stop_order(*args, wanted=1, daemon_list=["vtysh_enable", "zebra", "absent"]), "stop_seq") == ["vtysh_enable", "zebra"]
    assert names(start_order(*args, daemon_list=[]), "start_seq") == []


def test_last_of_several_files(spark, tmp_path):
    for name, listed in (("a.json", [("h1", "old"), ("h2", "two"), ("h1", "older")]), ("b.json", [("h1", "new")])):
        (tmp_path / name).write_text(json.dumps([{"id": i, "hypervisor_hostname": n} for i, n in listed]))
    hosts = read_listing(spark, str(tmp_path), "id string, hypervisor_hostname string")
    assert rows(host_map(hosts), "key", "value") == [("h1", "new"), ("h2", "two")]
    assert rows(hosts.select(F.col("place.ord").alias("o"), "id").where("id = 'h1'")) == [(0, "h1"), (0, "h1"), (2, "h1")]
