"""Large counts, many languages, words put into notices, classes of null ids, hot null ids."""

import math
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fleetspark.llm import licenses, packing, ppm, simhash
from tests.llm.test_operators import frame


# 2: language --------------------------------------------------------------------------------------

def grams(text, order):
    """(gram, depth) of every byte of a text led by a blank."""
    data = b" " + text
    return [(sum(data[i - k] << (8 * k) for k in range(min(i, order) + 1)), min(i, order)) for i in range(len(data))]


class Tree:
    """PPM with escape method C and exclusion, in fractions, one language."""

    def __init__(self, text, times, order):
        data, self.counts, self.order = b" " + text, {}, order
        for i, b in enumerate(data):
            for k in range(min(i, order) + 1):
                of = self.counts.setdefault(data[i - k:i], {})
                of[b] = of.get(b, 0) + times

    def p(self, b, context):
        if context is None:
            return Fraction(1, 256)
        shorter = context[1:] if context else None
        seen = self.counts.get(context)
        if not seen:
            return self.p(b, shorter)
        n, d = sum(seen.values()), len(seen)
        if b in seen:
            return Fraction(seen[b], n + d)
        return Fraction(d, n + d) * self.p(b, shorter) / (1 - sum(self.p(s, shorter) for s in seen))

    def bits(self, text):
        data = b" " + text
        return sum(-math.log2(self.p(b, data[max(0, i - self.order):i])) for i, b in enumerate(data))


@pytest.mark.parametrize("times", [1, 500_000, 50_000_000])
def test_code_lengths_equal_a_brute_force_ppm(times):
    samples = [b"abracadabra abracadabra the cat sat", b"le chat est assis abracadabra ici"]
    order, rows = 3, {"gram": [], "depth": [], "n": [], "lang": []}
    for lang, text in enumerate(samples):
        for gram, depth in grams(text, order):
            for name, x in zip(rows, (gram, depth, times, lang), strict=True):
                rows[name].append(x)
    model = ppm.build(["x", "y"], {k: np.asarray(v) for k, v in rows.items()}, order, 1)
    texts = ["abracadabra", "the cat est assis", "zq zq", "chat", "abrabra the the", "cab"]
    got = model.code_lengths(texts) / ppm.BITS
    trees = [Tree(s, times, order) for s in samples]
    want = [[t.bits(x.encode()) for t in trees] for x in texts]
    assert np.allclose(got, want, atol=0.02)
    assert times == 1 or model.cost.max() / ppm.BITS > 64


def test_sixty_languages_each_keep_their_contexts(spark):
    """A language's contexts hang on its own counts, and a null id is scored but never learned from."""
    draw = np.random.default_rng(3)
    alphabet = list("abcdefghijklmnopqrstuvwxyz")
    words = {f"l{k:02}": ["".join(draw.choice(alphabet, 5)) for _ in range(12)] for k in range(60)}
    rows = [(i * 60 + k, " ".join(draw.choice(w, 25)), lang, "s") for i in range(14) for k, (lang, w) in enumerate(words.items())]
    rows += [(None, "nothing to learn " * 40, "never", "s")]
    df = frame(spark, rows)
    from pyspark.sql import functions as F
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    out = [(r["lang_pred"], (r["doc_id"] % 60) if r["doc_id"] is not None else None, r["held_out"])
           for r in ppm.identify(df, held, train_docs=50, min_context=8).collect()]
    tested = [(p, k) for p, k, h in out if h and k is not None]
    assert len(out) == len(rows) and len(tested) > 200
    assert sum(p == f"l{k:02}" for p, k in tested) >= 0.97 * len(tested)
    assert "never" not in {p for p, _, _ in out}


# 9: licences --------------------------------------------------------------------------------------

@pytest.mark.parametrize("label", ["mit", "apache-2", "gpl", "lgpl", "bsd", "isc", "mpl-2", "unlicense"])
def test_words_put_into_a_notice_keep_its_label(spark, label):
    notice = max((t for x, t in licenses.NOTICES if x == label), key=len).split()
    rows = []
    for k in (0, 1, 2, 3, 5, 10):
        half = len(notice) // 2
        rows.append((k, " ".join(["Before it.", *notice[:half], *[f"own{i}" for i in range(k)], *notice[half:], "after"]), "en", "a"))
        rows.append((100 + k, " ".join([*notice[:half], *["x"] * k, *notice[half:]] * 2), "en", "a"))  # two copies
    rows.append((500, " ".join(notice[:len(notice) // 3] + ["and then quite another text"] * 5), "en", "a"))
    rows.append((501, " ".join([*notice[len(notice) // 2:], *notice[:len(notice) // 2]]), "en", "a"))
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).collect()}
    for k in (0, 1, 2, 3, 5, 10):
        assert label in got[k]["labels"].split(",") and label in got[100 + k]["labels"].split(","), k
        assert got[k]["score"] >= 0.7
    assert got[0]["score"] == 1 and got[500]["score"] < 0.7


def test_a_notice_is_not_taken_for_its_neighbours(spark):
    both = {"gpl": {"gpl", "lgpl"}}  # all but one word of the lesser licence's notice stands in it
    rows = [(i, text, "en", "a") for i, (_, text) in enumerate(licenses.NOTICES)]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(frame(spark, rows)).collect()}
    for i, (label, _) in enumerate(licenses.NOTICES):
        assert got[i] == both.get(label, {label}), i


# 5: SimHash ---------------------------------------------------------------------------------------

def test_a_class_of_null_ids_keeps_one_row(spark):
    text = " ".join(f"w{i}" for i in range(60))
    tries = {i: text.replace("w59", f"w{i}") for i in range(400, 520)}
    prints = simhash.fingerprints(frame(spark, [(1, text, "en", "a"), *[(i, t, "en", "a") for i, t in tries.items()]]), 3)
    fps = {r["doc_id"]: r["fp"] for r in prints.collect()}
    near = tries[next(i for i in tries if 1 <= ((fps[i] ^ fps[1]) & ((1 << 64) - 1)).bit_count() <= 2)]
    rows = [(None, t, "en", "a") for t in [text, near] * 4] + [(None, "something else again", "en", "a")]
    assert sorted(r["text"] == "something else again" for r in simhash.one_of_each(frame(spark, rows)).collect()) == [False, True]
    with_id = [*rows, (9, near, "en", "a"), (4, text, "en", "b"), (4, text, "en", "b")]
    kept = simhash.one_of_each(frame(spark, with_id)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 4]


# 6: packing ---------------------------------------------------------------------------------------

def test_rows_of_one_null_id_spread_over_groups(spark, monkeypatch):
    pieces = [(None if i % 2 else i, 0, 0, 40 + i % 7, zlib.crc32(str(i % 3).encode())) for i in range(4000)]
    df = spark.createDataFrame(pieces, packing.PIECE_SCHEMA)
    level = packing._pack_level(packing.written(df, "pieces"), 512, 64, 40, 0, False)
    sizes = [r["count"] for r in level.groupBy("group_id").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 200
    placed = packing.pack_pieces(df, capacity=512, open_bins=16, group_rows=100).collect()
    assert len(placed) == 4000
    bins = {}
    for r in placed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in bins.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= 1.05 * 4000 / 11  # eleven pieces to a sequence
