"""The ten operators against brute force, held-out accuracy and round trips, and on awkward rows."""

import hashlib
import io
import contextlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from fleetspark.llm import (components, licenses, mixing, omh, outliers, packing, ppm, queries, simhash, suffix, token_files,
                            warc)
from fleetspark.llm.common import scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "one", None, "a"), (5, "x" * 5000, "en", "b"),
    (6, "the same text again " * 30, "en", "b"), (6, "the same text again " * 30, "en", "b"), (7, "the same text again " * 30, "en", "b"),
    (None, "no id at all, but words enough to count as a text of ten words", "en", "b"),
    (8, "a  b \n\n c d\x1ce <|endoftext|> 日本語 café CAFÉ's", "fr", "c"),
    (9, "Released under the MIT License. Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "en", "a"),
]
EXTRA = "doc_id long, text string, lang string, source string, key long, size long, fp long, words string, rest long, range int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, "x", 7, 7) for r in rows], EXTRA)


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, AWKWARD)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def encoded(path, values):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([v or "" for v in values], add_special_tokens=False)]


# 1, 6: tokens -------------------------------------------------------------------------------------

@pytest.mark.parametrize("path,words", [(BYTE_BPE, False), (WORD_BPE, True)])
def test_chunked_encoding_is_exact(path, words):
    draw = random.Random(1)
    parts = [*"abZÉéß.,!?;:'- \n\t 12<|>\x1c\x01́İΣ日\r", "'s", "<|endoftext|>", "  ", "\n\n", "thonre"]
    e = token_files.ChunkEncoder(path, words)
    for _ in range(5000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert e.encode([t])[0] == np.asarray(e._ids(t), dtype="<u4").tobytes(), repr(t)


def test_blocks_of_texts_encode_like_each_text():
    draw = random.Random(2)
    parts = [*"abZÉé.,! \n\t1\r", "  ", "thonre", "thonre,", " word", "\u3000"]
    texts = [None, "", *["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(3000)], "x" * 5000]
    e = token_files.ChunkEncoder(BYTE_BPE, False)
    got = []
    for first, block in token_files.text_blocks(pa.array(texts), max_bytes=500):
        assert first == len(got)
        ids, n = e.encode_block(block)
        got += [part.tolist() for part in np.split(ids, np.cumsum(n)[:-1])]
    assert [[*ids, 0] for ids in got] == encoded(BYTE_BPE, texts)


@pytest.mark.parametrize("path,words", [(BYTE_BPE, False), (WORD_BPE, True)])
def test_added_tokens_like_the_librarys_default_call(path, words):
    draw = random.Random(3)
    parts = [*"abÉ.,! \n\t1\x1c", "  ", "thonre", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endof"]
    texts = ["a <|endoftext|> b", "", *["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(3000)]]
    plain = Tokenizer.from_file(path)
    got = token_files.ChunkEncoder(path, words, added=True).encode(texts)
    assert got == [np.asarray(e.ids, dtype="<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_queries_encode_added_tokens(spark, tmp_path):
    frame(spark, [(1, "a <|endoftext|> b", "en", "a")]).write.parquet(f"{tmp_path}/documents.parquet")
    for query, path in ((queries.op1_token_files, BYTE_BPE), (queries.op6_best_fit_packing, WORD_BPE)):
        ids = Tokenizer.from_file(path).encode("a <|endoftext|> b", add_special_tokens=False).ids + [0]
        assert [r["ids_crc32"] for r in query(spark, str(tmp_path)).collect()] == [crc(ids)]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_token_index_counts_all_ids(spark, awkward, docs, nothing):
    for df in (awkward, docs):
        rows = by_id((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
        got = by_id(tuple(r) for r in token_files.tokenize_to_files(df, BYTE_BPE).collect())
        ids = encoded(BYTE_BPE, [t for _, t in rows])
        assert [(r[0], r[2], r[3]) for r in got] == [(d, len(i), crc(i)) for (d, _), i in zip(rows, ids, strict=True)]
        assert [r[1] for r in got] == [0, *np.cumsum([len(i) for i in ids])[:-1]]
    assert token_files.tokenize_to_files(nothing, BYTE_BPE).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_layout_and_selective_reads(spark, docs, encoding):
    path = scratch(spark, "test-tokens")
    token_files.write_tokens(docs, path, BYTE_BPE, encoding=encoding, row_group_bytes=1 << 20, page_bytes=16 << 10)
    file = next(f for f in duckdb.sql(f"SELECT file FROM glob('{path.removeprefix('file:')}/*.parquet')").fetchall())[0]
    column = pq.ParquetFile(file).metadata.row_group(0).column(4)
    kinds = " ".join(map(str, column.encodings))
    assert column.path_in_schema == "ids.list.element" and column.has_offset_index
    assert ("DICTIONARY" in kinds) == (encoding == "dictionary") and ("DELTA_BINARY_PACKED" in kinds) == (encoding == "delta")
    some = token_files.read_tokens(spark, path, ["doc_id", "n_tokens"], "doc_id = 7")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        some.explain("formatted")
    assert "EqualTo(doc_id,7)" in out.getvalue() and "ids" not in out.getvalue().split("ReadSchema")[1].split("\n")[0]
    whole = {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, path).collect()}
    assert whole[7] == encoded(BYTE_BPE, [docs.where("doc_id = 7").first()["text"]])[0]


def test_packing_places_every_piece(spark, awkward, docs, nothing):
    for df in (awkward, docs):
        rows = df.select("doc_id", "text").collect()
        want = []
        for d, ids in zip([r["doc_id"] for r in rows], encoded(WORD_BPE, [r["text"] for r in rows]), strict=True):
            want += [(d, k, at, len(ids[at:at + 2048]), crc(ids[at:at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
        pieces = packing.token_pieces(df, WORD_BPE)
        for group_rows, open_bins in ((65_536, 2048), (60, 8), (20, 64)):
            got = packing.pack_pieces(pieces, open_bins=open_bins, group_rows=group_rows).collect()
            assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
            bins: dict = {}
            for r in got:
                bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for spots in bins.values():
                at = 0
                for offset, length in sorted(spots):
                    assert offset == at
                    at += length
                assert at <= 2048
            assert len(bins) <= (1.1 if group_rows > 20 else 2) * sum(r["length"] for r in got) / 2048 + 1
    assert packing.pack_pieces(packing.token_pieces(nothing, WORD_BPE)).count() == 0


def test_best_fit_closes_the_fullest_first():
    packer = packing.BestFit(10, 2)
    assert [packer.add(n) for n in (6, 7, 3, 8, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    packer = packing.BestFit(10, 2)
    assert [packer.add(n) for n in (6, 7, 9, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]  # 7 was closed


# 2: language --------------------------------------------------------------------------------------

def test_language_held_out_and_undetermined(spark, docs, awkward, nothing, texts):
    got = queries.op2_ppm_language(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    model = ppm.fit(docs, docs.doc_id >= 0)
    out = {r["doc_id"]: r for r in ppm.predict(awkward, model, ["doc_id"]).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[8]["lang_pred"] != "und"
    assert ppm.predict(nothing, model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in ppm.identify(awkward, awkward.doc_id.isNotNull() | awkward.doc_id.isNull()).collect()} == {"und"}


def test_language_probabilities_add_up():
    data = b" abracadabra abracadabra"
    gram = np.asarray([sum(data[i - k] << (8 * k) for k in range(min(i, 2) + 1)) for i in range(len(data))])
    depth = np.minimum(np.arange(len(data)), 2)
    rows = {"gram": gram, "depth": depth, "n": np.ones(len(data), dtype=int), "lang": np.zeros(len(data), dtype=int)}
    m = ppm.build(["x"], rows, order=2, min_context=1)
    p = np.exp2(-m.cost.reshape(-1, m.n_symbols).astype(float) / ppm.BITS)
    assert np.allclose(p[:, 1:].sum(axis=1) + p[:, 0] * (256 - (m.n_symbols - 1)), 1, atol=5e-3)


# 3: WARC ------------------------------------------------------------------------------------------

def test_warc_round_trip_and_revisits(spark):
    big, odd = "<p>" + "y" * 1200, "a\r\n\r\nWARC/1.1\r\n\r\n" * 80 + "\r\n"
    pages = [(1, "http://a/", big), (2, "http://b/ x\r\ny", big), (3, None, big), (4, "http://c", "small"), (5, "http://d", "small"),
             (6, "http://e", None), (7, "http://f", odd), (8, "http://g", odd), (8, "http://g", odd), (9, "u", "é" * 600), (None, "n", big)]
    df = spark.createDataFrame([(*p, "x", 5) for p in pages], "page_id long, url string, html string, payload string, original long")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in warc.archive(df).collect()), key=str)
    want = []
    for i, _, body in pages:
        raw = (body or "").encode()
        first = max((j for j, _, b in pages if b == body and j is not None), default=None)
        again = len(raw) >= 1000 and i != first
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive(df.limit(0)).count() == 0


# 4: outliers --------------------------------------------------------------------------------------

def counts_by_hand(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
    lines = [ln for ln in (text or "").split("\n") if WORD.search(ln)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_statistics_by_hand(texts):
    for text in [*[t for t in texts.values() if len(t) < 3000], *[r[1] for r in AWKWARD], "a\nb\na\n\n \na", "# $%é|"]:
        assert outliers.count_text(text)[:5] == counts_by_hand(text)


def test_outliers_are_rejected_whatever_their_number(spark, awkward, nothing):
    draw = random.Random(5)
    words = ["the", "of", "and", "to", "in", "river", "stone", "because", "another", "small", "wonderful"]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(i, prose(draw.randint(40, 400)), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "$$$" for w in prose(100).split()), "en", "a") for i in range(60)]  # a sixth of the group
    judged = {r["doc_id"]: r["kept"] for r in outliers.quality(frame(spark, rows)).collect()}
    assert not any(judged[1000 + i] for i in range(60))
    assert sum(judged[i] for i in range(300)) >= 295  # some words repeat by chance
    odd = outliers.quality(awkward).collect()
    assert len(odd) == len(AWKWARD) and [r["base_failed"] for r in odd if r["doc_id"] in (1, 2, 3, 4, 5)] == [True] * 5
    assert outliers.quality(nothing).count() == 0


def test_small_groups_are_judged_by_pools(spark):
    draw = random.Random(6)
    words = ["the", "of", "and", "to", "in", "river", "stone", "because", "another", "small", "wonderful"]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    junk = lambda: " ".join(w + "$$$" for w in prose(100).split())
    groups = [("en", f"rare{i // 4}") for i in range(60)]  # by language: no source has min_group rows
    groups += [(f"l{i}", "shared") for i in range(60)]  # by source: no language has
    groups += [(f"m{i}", f"own{i}") for i in range(5)] + [(None, None)]  # by all rows
    rows = [(i, prose(draw.randint(60, 300)), *g) for i, g in enumerate(groups)]
    bad = [(1000 + i, junk(), *g) for i, g in enumerate([("en", "five")] * 5 + [("x", "shared"), ("y", "alone"), (None, "z"), (None, None)])]
    judged = {r["doc_id"]: r for r in outliers.quality(frame(spark, rows + bad)).collect()}
    assert len(judged) == len(rows + bad) and all(r["distance"] is not None for r in judged.values() if not r["base_failed"])
    assert not any(judged[1000 + i]["base_failed"] or judged[1000 + i]["kept"] for i in range(len(bad)))
    assert sum(judged[i]["kept"] for i in range(len(rows))) >= len(rows) - 3


def test_milder_junk_is_rejected_and_clean_tables_stay(spark):
    draw = random.Random(7)
    words = [a + b for a in "the of and to in river stone because another small".split() for b in ["", "er", "ing", "s", "ness"]]
    prose = lambda n: [[draw.choice(words) for _ in range(8)] for _ in range(n)]
    text = lambda lines: "\n".join(" ".join(w).capitalize() + "." for w in lines)
    every = lambda k, change: [[change(w) if i % k == 0 else w for i, w in enumerate(ln)] for ln in prose(20)]
    mild = {"numbers": lambda: text(every(3, lambda w: str(draw.randint(1000, 99999)))),
            "capitals": lambda: "\n".join(map(" ".join, every(2, str.upper))),
            "symbols": lambda: text(every(2, lambda w: w + "|")),
            "lines": lambda: text([x for ln in prose(20) for x in (ln, ["see", "also"])][:-10])}
    clean = [(i, text(prose(draw.randint(6, 40))), "en", "a") for i in range(300)]
    rows = clean + [(1000 * k + i, make(), "en", "a") for k, make in enumerate(mild.values(), 1) for i in range(10)]
    judged = {r["doc_id"]: r for r in outliers.quality(frame(spark, rows)).collect()}
    assert not any(r["base_failed"] for r in judged.values())
    assert {k for k in range(1, 5) for i in range(10) if judged[1000 * k + i]["kept"]} == set()
    assert sum(judged[i]["kept"] for i in range(300)) >= 294
    alone = outliers.quality(frame(spark, clean)).where("kept").count()
    assert alone >= 294


# 5: SimHash ---------------------------------------------------------------------------------------

def fingerprint_by_hand(text):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_by_hand(awkward, texts, docs):
    for df in (awkward, docs.where("length(text) < 2000")):
        for r in df.select("text").distinct().collect():
            assert int(simhash.majority_bits([simhash.shingle_hashes(r["text"], 3)])[0]) == fingerprint_by_hand(r["text"])


def root_of(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.mark.parametrize("radius", [1, 2])
def test_links_and_components_equal_brute_force(spark, radius):
    draw = random.Random(radius)
    values = set()
    for _ in range(60):  # clouds, one of them dense in two bytes
        centre = draw.getrandbits(64)
        for _ in range(12):
            x = centre
            for _ in range(draw.randint(0, 4)):
                x ^= 1 << draw.randrange(64)
            values.add(x)
    dense = draw.getrandbits(64)
    values |= {dense ^ v for v in range(300)}
    values = sorted(values)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(values) for b in values[i + 1:] if (a ^ b).bit_count() <= radius}
    table = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = simhash.links(table, radius).collect()
    assert {frozenset((r["a"], r["b"])) for r in found} == want and len(found) == len(want)
    parent = {signed(v): signed(v) for v in values}
    for pair in want:
        a, b = (root_of(parent, x) for x in pair)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(found)).collect()}
    assert got == {x: root_of(parent, x) for pair in want for x in pair}


def test_long_chains_of_links(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {r["root"] for r in components.connected_components(df).collect()} == {0}


def test_near_duplicate_classes(spark, awkward, nothing):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(awkward).collect() if r["doc_id"]}
    assert got[1] == got[2] == got[3] == 1 and got[6] == got[7] == 6
    stay = sorted((r["doc_id"] or 0) for r in simhash.one_of_each(awkward).collect())
    assert stay == [0, 1, 4, 5, 6, 8, 9]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0


# 7: Order MinHash ---------------------------------------------------------------------------------

def test_occurrences_and_signatures(spark, awkward, texts):
    out = omh.fingerprint_pairs(awkward, parts=3).collect()
    assert len(out) == len(AWKWARD)
    same = {r["fingerprint"] for r in out if r["doc_id"] in (6, 7)}
    assert len(same) == 1 and len({r["fingerprint"] for r in out}) >= 7
    # k-mers are numbered by occurrence: without numbers both texts would have the same two of them
    few, many = (spark.createDataFrame([("a b " * n,)], "t string") for n in (3, 40))
    size = lambda df: len(omh.with_signature(df, "t", "s").first()["s"])
    assert size(few) <= 5 and size(many) > 20
    pairs = [("a b c d e f g h " * 9, "a b c d e f g h " * 9), ("one two three four five six", "four five six one two three"),
             ("p q r s t u v w x y z", "1 2 3 4 5 6 7 8 9 10 11")]
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    like = [r[0] for r in omh.with_signature(omh.with_signature(df, "a", "x"), "b", "y").select(omh.likeness("x", "y")).collect()]
    assert like[0] == 1 and 0 < like[1] < 1 and like[2] == 0


def test_edited_texts_and_next_documents(spark, docs, awkward, nothing):
    for df in (docs, awkward.where("doc_id IS NOT NULL")):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), reverse=True)
        want = []
        for i, (d, t) in enumerate(rows):
            nxt, half = rows[(i + 1) % len(rows)][1], len(t) // 2
            want.append((d, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
        for parts in (1, 7):
            out = omh.fingerprint_pairs(df, parts=parts).collect()
            assert sorted(tuple(r)[:3] for r in out) == sorted(want)
            assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    long = [r for r in omh.fingerprint_pairs(docs).collect() if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.95
    assert omh.fingerprint_pairs(nothing).count() == 0


# 8: suffix dedup ----------------------------------------------------------------------------------

def removal_by_hand(rows):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        hit = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 99):
            if seen.setdefault(raw[s:s + 100], (d, s)) != (d, s):
                hit[s:s + 100] = True
        left = bytes(np.frombuffer(raw, dtype=np.uint8)[~hit])
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out[d] = (len(raw), int(hit.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def test_removed_bytes_equal_brute_force(spark, docs, awkward, nothing):
    draw = random.Random(8)
    line = "a line that many of the documents share, longer than a window of one hundred bytes, word for word to its end\n"
    rows = []
    for i in range(60):
        own = "".join(draw.choice("abcd éü") for _ in range(draw.randint(0, 400)))
        rows.append((i, draw.choice(["", own, own + line, line + own, line[5:95] + own, "ab" * 150 + own, own + "z" * 350, own + rows[-1][1][:250] if rows else own])))
    for df in (frame(spark, [(d, t, "en", "a") for d, t in rows]), awkward, docs):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.deduplicated(df).collect()}
        assert got == removal_by_hand([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    kept = suffix.deduplicated(awkward, with_text=True)
    assert kept.columns[:4] == ["doc_id", "lang", "source", "key"] and kept.count() == len(AWKWARD)
    assert suffix.deduplicated(nothing).count() == 0


# 9: licences --------------------------------------------------------------------------------------

def test_licence_places_and_labels(spark, awkward, docs, nothing):
    extra = [(20, "cc by nc cc by nc; under the mit\nLICENSE", "en", "a"), (21, "under the mit licenses", "en", "a"),
             (22, "This work is kindly licensed under the GNU General Public License, version 3.", "en", "a"),
             (23, "mit license the under", "en", "a"), (24, None, "en", "a")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for df in (awkward.unionByName(frame(spark, extra)), docs):
        got = sorted((tuple(r)[:6] for r in licenses.scan(df).collect()), key=str)
        want = []
        for r in df.collect():
            w = word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or ""))
            at = sorted((i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()]
                        for i in range(len(w)) if w[i:i + len(p)] == p)
            want.append((r["doc_id"], len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None,
                         ",".join(sorted({x for _, x in at}))))
        assert got == sorted(want, key=str)
    found = {r["doc_id"]: r["labels"] for r in licenses.scan(frame(spark, extra)).collect()}
    assert found == {20: "cc-by-nc,mit", 21: "", 22: "gpl-3", 23: "", 24: ""}
    assert licenses.scan(nothing).count() == 0


# 10: mixing ---------------------------------------------------------------------------------------

def test_targets_stop_at_three_epochs(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 0, None: 7}
    df = spark.createDataFrame([(k, v, 5) for k, v in sizes.items()], "source string, source_size long, n_docs long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    left, free = float(sum(sizes.values())), dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True))
    want = {}
    while True:
        share = left / sum(free.values())
        over = [k for k, w in free.items() if w * share > 3 * sizes[k]]
        if not over:
            break
        for k in over:
            want[k] = 3.0 * sizes[k]
            left -= want[k]
            del free[k]
    want |= {k: w * share for k, w in free.items()}
    assert got == pytest.approx(want)


def test_mix_meets_targets_and_reruns_agree(spark, docs, awkward, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sized = docs.select("doc_id", "source", mixing.word_count(docs.text).alias("size"), docs.lang.alias("rest"))
    for chunk_rows in (4096, 3):
        rows = mixing.mix(sized, chunk_rows=chunk_rows).collect()
        if chunk_rows == 4096:
            first = {r["doc_id"]: r["taken"] for r in rows}
        assert {r["doc_id"]: r["taken"] for r in rows} == first and len(rows) == docs.count()
        assert all(r["taken"] <= 3 * r["size"] for r in rows)
        for s in {r["source"] for r in rows}:
            mine = [r for r in rows if r["source"] == s]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
    odd = mixing.mix_documents(awkward, labels).collect()
    assert len(odd) == len(AWKWARD) and mixing.mix_documents(nothing, labels).count() == 0
    assert [r["size"] for r in odd if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]


# the registered SQL -------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    from tools.oracle_check import rows as norm_rows

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert norm_rows(queries.QUERIES[name](spark, SF).toPandas()) == norm_rows(con.execute(queries.ORACLE[name]).df())
