"""Operator 11 against the contract spelled out text by text."""

import hashlib
import random

import pytest

from fleetspark.llm import fim, queries
from tests.llm.test_operators import AWKWARD, frame

MARKS = ("<P>", "<S>", "<M>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(doc_id, text):
    """(n, form, prefix characters, middle characters, output) with production parameters."""
    t, h = text or "", sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    parts = [*"ab <>PSM\né日\U0001F600", "<P", "S>", "<M>"]
    odd = [(100 + i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 14))), "en", "a") for i in range(1500)]
    # one text beyond a block; a third of the rows under one null id, and one id with different texts
    return [*AWKWARD, *odd, (9001, "énorme 日本 " * 400_000, "fr", "b"),
            *[(None, f"text {i} without an id", None, None) for i in range(700)], (7, "another text of id 7", "en", "b")]


def test_transform_and_restore_by_hand(spark, rows):
    out = fim.restore(fim.transform(frame(spark, rows), keep=["doc_id", "text", "key"])).collect()
    got = sorted([(r["doc_id"], r["text"], r["key"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"],
                   sha(r["output"]), sha(r["restored"])) for r in out], key=repr)
    want = []
    for d, t, *_ in rows:
        *meta, output = by_hand(d, t)
        want.append((d, t, 7, *meta, sha(output), sha(t or "")))
    assert got == sorted(want, key=repr)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_query_gives_the_contracts_digests(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_fill_in_middle(spark, str(tmp_path)).collect()), key=repr)
    want = [(d, *by_hand(d, t)[:4], sha(by_hand(d, t)[4]), sha(t or "")) for d, t, *_ in rows]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("unit", ["words", "lines"])
def test_other_units_cut_where_units_begin(spark, rows, unit):
    docs = frame(spark, rows[:-701])
    for r in fim.restore(fim.transform(docs, keep=["text"], unit=unit, plain_percent=0)).collect():
        t = r["text"] or ""
        assert r["restored"] == t
        if r["form"] != "plain":
            for cut in (r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]):
                ends = "\n" if unit == "lines" else " \t\n\v\f\r"
                assert cut in (0, len(t)) or t[cut - 1] in ends and (unit == "lines" or t[cut] not in ends)
        if unit == "lines":
            assert r["n"] == len(t.split("\n")) - (t == "" or t.endswith("\n"))


def test_shares_and_markers(spark):
    docs = frame(spark, [(i, "some words to cut in three", "en", "a") for i in range(3000)])
    forms = [r["form"] for r in fim.transform(docs, seed=7, plain_percent=30, spm_percent=50).collect()]
    assert abs(forms.count("plain") / 3000 - 0.3) < 0.04 and abs(forms.count("spm") / 3000 - 0.35) < 0.04
    own = fim.Markers("[pre]", "[suf]", "[mid]")
    cut = fim.restore(fim.transform(docs, markers=own), markers=own).where("restored <> 'some words to cut in three'")
    assert cut.count() == 0
    for bad in (("<P>", "<P>", ""), ("ab", "ba", "c"), ("x", "xy", "z"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fim.Markers(*bad)
    with pytest.raises(ValueError):
        fim.transform(docs, unit="bytes")


def test_empty_table(spark):
    out = fim.restore(fim.transform(frame(spark, [])))
    assert out.count() == 0
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
