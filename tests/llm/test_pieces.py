"""Operator 12 against the sentencepiece library on whole texts."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from fleetspark.llm import pieces, queries
from fleetspark.llm.token_files import text_blocks
from tests.llm.test_operators import AWKWARD, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(12)
    parts = [*"abé ▁\n\t日\x00\U0001F600'.,1 　�́", "<s>", "</s>", "<unk>", "<0x0A>", "the", "  ", " and", "ing",
             " " * 17, "▁▁", "ment"]
    fixed = ["", " ", "  ", "a ", " a", "▁", "▁▁a", "x▁ y", " " * 40, "a" * 3000, "x" * 200 + " y", "\n", "<s> </s>"]
    return fixed + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(5000)]


def test_ids_are_the_librarys(library, texts):
    table = pieces.ChunkTable(MODEL)
    assert not table.whole
    for first, block in text_blocks(pa.array(texts), max_bytes=2000):
        ids, n = table.encode(block)
        want = library.encode(texts[first:first + len(block)])
        assert ids.tolist() == [i for one in want for i in one] and n.tolist() == [len(one) for one in want]


def test_a_small_table_starts_anew_and_whole_texts_agree(library, texts):
    small, whole = pieces.ChunkTable(MODEL, max_entries=5, longest=3), pieces.ChunkTable(MODEL)
    whole.whole = True  # as for a model whose pieces cross markers
    for first, block in text_blocks(pa.array(texts), max_bytes=5000):
        a, b = small.encode(block), whole.encode(block)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert max(map(len, small.ids)) <= 3


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    table, seen = pieces.ChunkTable(MODEL), []

    class Counting:
        def encode(self, chunks, num_threads):
            seen.extend(chunks)
            return [[5]] * len(chunks)

    monkeypatch.setattr(table, "library", Counting())
    for _ in range(3):
        ids, n = table.encode(pa.array(["one two one", "", "two  two one"]))
        assert ids.tolist() == [5] * 6 and n.tolist() == [3, 0, 3]
    assert sorted(seen) == [" two", "one", "two"]


def digests(library, text):
    ids = library.encode(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_query_on_awkward_rows(spark, library, texts, tmp_path):
    rows = [*AWKWARD, *[(1000 + i, t, "en", "a") for i, t in enumerate(texts[:800])],
            (2, "one id with another text", None, None), *[(None, f"no id {i}  of ours", "en", "b") for i in range(400)],
            (5000, "a very long text, longer than a block ▁ " * 150_000, "en", "b"), (5001, "z" * 300_000, "en", "b")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_sentencepiece(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(d, *digests(library, t)) for d, t, *_ in rows], key=repr)


def test_decode_takes_any_ids(spark, library):
    lists = [None, [], [264], [28705, 29142], [13, 13], [232, 100, 300, 3], [1, 264, 2], [259, 264]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in pieces.decode(df, MODEL, block_ids=3).collect()}
    assert got == {i: library.decode(x or []) for i, x in enumerate(lists)}


def test_empty_table(spark):
    out = pieces.decode(pieces.encode(frame(spark, []), MODEL, keep=["doc_id", "key"]), MODEL)
    assert out.count() == 0 and out.columns == ["doc_id", "key", "n_tokens", "ids", "decoded"]
