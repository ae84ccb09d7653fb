"""Operator 13 against a dense matrix of Python integers."""

import collections
import random
import re

import numpy as np
import pytest

from fleetspark.llm import divergence, queries
from tests.llm.test_operators import AWKWARD, frame

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def f(p, q):
    return (p - q) ** 2 // (p + q)


def by_hand(rows, min_docs=10, top=10):
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        sources = [s for of, s in counts if of == lang]
        held = {s: {t: n for t, n in counts[lang, s].items() if t in kept} for s in sources}
        whole = sum((collections.Counter(h) for h in held.values()), collections.Counter())

        def priced(of):
            return {t: 1 + 10**9 * (of.get(t, 0) + 2) // (sum(of.values()) + 2 * len(kept)) for t in kept}

        p, q = {s: priced(held[s]) for s in sources}, priced(whole)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in held[s] if p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, i) for part, found in (("pair", pairs), ("term", terms))
                    for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def of(df):
    return [(r["text"], r["lang"], r["source"]) for r in df.select("text", "lang", "source").collect()]


@pytest.fixture(scope="module")
def many(spark):
    """30 sources, one with a third of the rows; null and empty languages and sources, one very long text."""
    draw = random.Random(13)
    words = [*"abcdefghij", "Été", "été", "日本", "x-y", "don't", "Straße", "ÅNGSTRÖM", "zz9zz"]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(0, 12))), draw.choice(["en", "en", "fr", None, ""]),
             "hot" if draw.random() < 0.33 else draw.choice([None, "", *[f"s{k}" for k in range(30)]])) for i in range(900)]
    rows += [(None, "ab cd " * 800_000, "en", "hot"), (1, "never kept alone", "xx", "s1"), (2, None, "xx", "s2"),
             (3, "", "yy", "only one source")]
    return frame(spark, rows)


@pytest.mark.parametrize("params", [{}, {"tile_cells": 20, "k": 2, "levels": 2}, {"tile_cells": 100, "k": 3, "levels": 2}])
def test_audit_by_hand(spark, many, params):
    assert sorted(map(tuple, divergence.audit(many, **params).collect())) == by_hand(of(many))


def test_no_kept_term_and_no_row(spark):
    odd = frame(spark, AWKWARD)
    got = sorted(map(tuple, divergence.audit(odd).collect()))
    assert got == by_hand(of(odd)) and got and {r[4] for r in got} == {0}
    assert sorted(map(tuple, divergence.audit(odd, min_docs=1, top=3).collect())) == by_hand(of(odd), 1, 3)
    empty = divergence.audit(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_query_on_its_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, queries.op13_source_divergence(spark, "/root/testdata/sf0.001").collect())) == by_hand(of(docs))


def test_counts_beyond_64_bits(spark):
    rows = [(0, 10, 3), (5, 10, 3), (9_000_000_000_000, 9_500_000_000_000, 70_000_000), (12_345_678_901, 98_765_432_109_876, 7)]
    df = spark.createDataFrame(rows, "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.price(df.n, df.total, df.v)).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in rows]


@pytest.mark.parametrize("k,levels", [(2, 3), (3, 2), (4, 1)])
def test_trees_hold_their_cells_and_walks_add_up(k, levels):
    draw = np.random.default_rng(5)
    side, n_cols = k ** levels, 3 * k ** levels

    def matrix(n_rows):
        m = np.where(draw.random((n_rows, n_cols)) < 0.1, draw.integers(1000, 10**6, (n_rows, n_cols)), 0)
        m[:, side:2 * side] = 0  # one square without a cell
        return m, draw.integers(1, 1000, n_rows)

    def tree(m):
        row, col = np.nonzero(m)
        return divergence.Tree(col // side, row, col % side, m[row, col], k, levels)

    (a, za), (b, zb) = matrix(side - 1), matrix(side)
    t = tree(a)
    assert sorted(t.values.tolist()) == sorted(a[a > 0].tolist()) and t.roots.tolist() == sorted(set((np.nonzero(a)[1] // side).tolist()))
    pa, pb = np.where(a > 0, a, za[:, None]), np.where(b > 0, b, zb[:, None])
    want = np.asarray([[sum(f(p, q) - f(x, y) for p, q in zip(u.tolist(), v.tolist())) for v, y in zip(pb, zb.tolist())]
                       for u, x in zip(pa, za.tolist())])
    for limit in (10, 1 << 20):
        assert (divergence.corrections(t, tree(b), za, zb, False, k, levels, limit) == want).all()
    own = np.asarray([[sum(f(p, q) - f(x, y) for p, q in zip(u.tolist(), v.tolist())) if i < j else 0
                       for j, (v, y) in enumerate(zip(pa, za.tolist()))] for i, (u, x) in enumerate(zip(pa, za.tolist()))])
    assert (divergence.corrections(t, t, za, za, True, k, levels) == own).all()
