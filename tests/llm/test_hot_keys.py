"""Rows of one id or one payload that hold a third of a table, and Order MinHash against a brute-force form."""

import random
import re

import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from fleetspark.llm import omh, token_files, warc
from fleetspark.llm.common import scratch


def test_rows_of_one_id_spread_over_token_files(spark):
    # a third under a null id, each its own text; a third the same row again and again
    data = [(None, f"text {i}") for i in range(400)] + [(7, "the same text")] * 400 + [(i + 10, f"other {i}") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    path, small = scratch(spark, "test-hot-tokens"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(small)
    try:
        spark.conf.set(small, "false")  # these few rows would else be put together again
        token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    finally:
        spark.conf.set(small, before)
    files = {}
    for r in token_files.read_tokens(spark, path, ["doc_id", "part"]).collect():
        files.setdefault(r["part"], []).append(r["doc_id"])
    assert sum(map(len, files.values())) == 1200 and max(map(len, files.values())) < 2 * 1200 / len(files)
    assert len(files) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [d for part in sorted(files) for d in files[part]]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    got = sorted(token_files.token_index(spark, path).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == order


def test_a_payload_that_a_third_share(spark):
    rnd = random.Random(3)
    copy, other = "c" * 1500, ["".join(rnd.choice("ab") for _ in range(1200)) for _ in range(20)]
    data = [(i, None, copy) for i in range(300)] + [(None, "u", copy)] * 3 + [(300 + i, None, other[i % 20]) for i in range(300)]
    data += [(900, "small", "s"), (901, "small", "s"), (299, None, copy), (902, None, None), (299, None, other[0])]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    best = {}
    for page, _, html in data:
        if html and page is not None:
            best[html] = max(best.get(html, -1), page)
    want = []
    for page, url, html in data:
        html = html or ""
        again = len(html) >= 1000 and best[html] != page
        want.append((page, url, html, "revisit" if again else "response", best[html] if again else None))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (threshold, "-1"):  # also where the references are past the broadcast bound
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            got = warc.plan_records(pages).select("page_id", "url", F.col("payload").cast("string"), "record_type", "refers_to")
            assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def chained(*values):
    """XXH64 of several values, the hash of each the seed of the next."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little")
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h


def signature(text):
    """{bin: 24 bits of its tuple} with one loop over the k-mers."""
    words = re.split("[\x20\x09-\x0d]+", text.strip(" \t\n\x0b\x0c\r"))
    seen, rows = {}, []
    for at in range(max(len(words) - omh.K + 1, 1)):
        h = chained(*words[at:at + omh.K]) >> 28
        times = seen[h] = seen.get(h, -1) + 1
        rows.append((chained((h, 8), (times, 4)) >> 28 if times else h, at))
    bins = {}
    for h, at in sorted(rows):
        bins.setdefault(h >> (36 - omh.BIN_BITS), []).append((at, h))
    return {b: chained(*[(h, 8) for _, h in sorted(least[:2])]) & 0xFFFFFF for b, least in bins.items()}


def test_signatures_and_likeness_equal_brute_force(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(12)] + ["é", "日本"]
    texts = ["", "one", " \n one  two\t", "a a a a a a", "x y " * 3_000]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randrange(2, 300))) for _ in range(40)]
    pairs = [(i, t, texts[(i * 7 + 1) % len(texts)]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(pairs, "i long, a string, b string")
    got = omh.with_signature(omh.with_signature(df, "a", "x"), "b", "y").select("i", "x", "y", omh.likeness("x", "y").alias("like"))
    for i, x, y, like in got.collect():
        one, two = signature(pairs[i][1]), signature(pairs[i][2])
        assert {c >> 24: c & 0xFFFFFF for c in x} == one and {c >> 24: c & 0xFFFFFF for c in y} == two
        assert like == sum(one.get(b) == t for b, t in two.items()) / len({*one, *two})
