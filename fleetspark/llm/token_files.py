"""Operator 1: token-id output as Parquet list columns.

``write_tokens`` encodes every whole text, sorts by ``doc_id`` and writes one
Parquet row per document: metadata columns (``doc_id``, ``part``,
``local_start``, ``n_tokens``) beside ``ids`` (a list column).  The ids are
dictionary encoded (a vocabulary of 50k fits one dictionary page, so an id takes
16 bits before compression) or, with ``encoding="delta"``, delta-binary-packed
(Parquet v2 pages without dictionary).  Row groups and pages are sized by
options, and the column and offset indexes that the writer adds let a reader
fetch some documents' ids, or only metadata, without reading the rest
(``read_tokens``).

``ChunkEncoder`` calls the ``tokenizers`` library for each distinct chunk between
white space once and keeps its ids; a block of texts is split into chunks and
numbered by Arrow, so Python looks up each distinct chunk of a block once. Texts
whose white space could make the result depend on more than one chunk go through
the library whole.

Defined results: a null text counts as empty (only the end id); rows are ordered
by ``doc_id`` with nulls first, rows of one ``doc_id`` by the hash of their text;
repeated rows are kept, each with its own ``start``; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import scratch

END_ID = 0
TOKEN_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
_ODD = "\x1c\x1d\x1e\x1f"
_MARKS = ".,!?;:"


def _shown_bytes() -> list[str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_SHOWN = _shown_bytes()


class _Chunks(dict):
    """Id bytes by chunk; a chunk that is not there is encoded and, if short, kept."""

    def __init__(self, encode, longest: int):
        super().__init__()
        self.encode, self.longest = encode, longest

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self.encode(chunk)
        if len(chunk) <= self.longest and chunk[:1] != "\n":  # a line's first chunk has its own entry
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Exact ``tokenizers`` ids as little-endian uint32 bytes, cached by chunk.

    ``words=True`` is for vocabularies that lower-case and drop white space (every
    chunk is independent); ``words=False`` for byte-level ones, where a blank
    belongs to the chunk after it and a chunk that holds or borders on other white
    space than one blank or line feed has no ids of its own.  A chunk of letters, with or without marks after
    it, goes straight to the vocabulary's model; anything else through the whole
    tokenizer.  At most ``max_entries`` chunks of ``longest`` characters are kept; beyond
    that the cache starts anew.

    ``added=True`` gives the ids of the library's default call, in which the string of an
    added token (``<|endoftext|>``) is that token; a text that holds one goes through the
    library whole. Otherwise such strings are ordinary text.
    """

    def __init__(self, path: str, words: bool, max_entries: int = 1_300_000, longest: int = 40,
                 added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.model = self.tokenizer.model
        self.words, self.max_entries = words, max_entries
        self.tails: dict[str, bytes] = {"": b""}
        self.led = _Chunks(lambda c: self._chunk(c, not words), longest)  # chunks after a blank (or all, if words)
        self.first = _Chunks(lambda c: self._chunk(c, False), longest)  # chunks that begin a line
        self.newline = self._bytes(self._ids("\n"))

    @classmethod
    def of_worker(cls, path: str, words: bool, added: bool = False) -> ChunkEncoder:
        """The Python worker's encoder, which later tasks use again."""
        if (path, words, added) not in _ENCODERS:
            _ENCODERS[path, words, added] = cls(path, words, added=added)
        return _ENCODERS[path, words, added]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        """Id bytes of a whole text, added tokens as ``added`` says."""
        self.tokenizer.encode_special_tokens = not self.added
        try:
            return self._bytes(self._ids(text))
        finally:
            self.tokenizer.encode_special_tokens = True

    @staticmethod
    def _bytes(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str, led: bool) -> bytes | None:
        if not self.words:
            line = chunk[1:] if chunk[:1] == "\n" else chunk
            if line.split() != [line]:
                return None
            if line is not chunk:
                return self.newline + self.first[line]
        stem = chunk.rstrip(_MARKS)
        if not stem.isalpha() or self.words and max(stem) > "\xff":
            return self._bytes(self._ids(" " + chunk if led else chunk))
        shown = stem.lower() if self.words else stem
        if not shown.isascii():
            shown = "".join([_SHOWN[b] for b in shown.encode()])
        tail = chunk[len(stem):]
        ids = (self.led if led or self.words else self.first).get(stem) if tail else None
        if ids is None:
            ids = self._bytes([t.id for t in self.model.tokenize(_SHOWN[32] + shown if led else shown)])
        if tail not in self.tails:
            self.tails[tail] = self._bytes(self._ids(tail))
        return ids + self.tails[tail]

    def _bound(self) -> None:
        if len(self.led) + len(self.first) > self.max_entries:
            self.led.clear()
            self.first.clear()
        if len(self.tails) > 10_000:
            self.tails = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Id bytes of each text."""
        self._bound()
        if self.words:
            return [self._words(t) for t in texts]
        ids, n = self.encode_block(pa.array(texts, type=pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(n)[:-1])]

    def _words(self, text: str) -> bytes:
        if any(c in text for c in _ODD) or any(t in text for t in self.added):  # _ODD: white space to Python only
            return self._whole(text)
        return b"".join(map(self.led.__getitem__, text.split()))

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has (``words=False``; no nulls)."""
        self._bound()
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        n_pieces = pc.list_value_length(pieces).to_numpy().astype(np.int64)
        heads = np.cumsum(n_pieces) - n_pieces
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = coded.indices.to_numpy().astype(np.int64)
        table = [self.led[chunk] for chunk in distinct]
        whole = np.logical_or.reduceat(np.asarray([ids is None for ids in table])[codes], heads)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        # a text's first piece follows no blank: it, or the whole text, has an entry of its own
        first = [self._whole(texts[i].as_py()) if alone else self.first[distinct[code]]
                 for i, (alone, code) in enumerate(zip(whole.tolist(), codes[heads].tolist(), strict=True))]
        codes[heads] = len(table) + np.arange(len(first))
        if whole.any():
            kept = ~np.repeat(whole, n_pieces)
            kept[heads] = True
            codes, n_pieces = codes[kept], np.where(whole, 1, n_pieces)
            heads = np.cumsum(n_pieces) - n_pieces
        table = [ids or b"" for ids in table] + first
        sizes = np.asarray([len(ids) // 4 for ids in table], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        n = sizes[codes]
        at = np.repeat(begins[codes] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(table), dtype="<i4")[at], np.add.reduceat(n, heads)


_ENCODERS: dict[tuple[str, bool, bool], ChunkEncoder] = {}


def text_blocks(texts: pa.Array, max_bytes: int = 4 << 20):
    """(first row, texts) blocks of about ``max_bytes`` bytes; null counts as empty."""
    texts = pc.fill_null(texts, "")
    before = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(texts)]
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > first:
            yield first, texts.slice(first, end - first)


def _encoder_map(path: str, end_id: int, added: bool):
    def encode(batches):
        encoder = ChunkEncoder.of_worker(path, words=False, added=added)
        part, local = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in text_blocks(batch.column("text")):
                ids, n = encoder.encode_block(texts)
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                ends = np.cumsum(n)
                start = local + ends - n
                local += int(ends[-1])
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)).cast(pa.int64()),
                     pa.array(np.full(len(texts), part, dtype=np.int32)), pa.array(start), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, encoding: str = "dictionary",
                 row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000,
                 added: bool = False) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write the token files in ``doc_id`` order.

    ``added`` as for ``ChunkEncoder``.

    ``part`` numbers the files in ``doc_id`` order; ``local_start`` counts the ids
    before a document within its file.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding: {encoding}")
    # ranges by id, text and, for rows alike in both, their number in the input: one id may hold a third of all rows
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    ordered = placed.repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "text")
    (ordered.select("doc_id", "text").mapInArrow(_encoder_map(tokenizer, end_id, added), TOKEN_SCHEMA)
     .write.option("compression", "zstd")
     .option("parquet.block.size", row_group_bytes)
     .option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", page_rows)
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .option("parquet.dictionary.page.size", 2 << 20)
     .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
     .parquet(path))


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """Selective read: only ``columns`` reach the scan; ``where`` is pushed to row groups and pages."""
    df = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("local_start"), batch.column("n_tokens"),
             pa.array(crc, type=pa.int64())],
            names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: each document's global ``start``, ``n_tokens`` and the crc32 of its ids.

    The files' totals (one row a file) come from the metadata columns alone.
    """
    totals = read_tokens(spark, path, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    crc = read_tokens(spark, path).mapInArrow(
        _checksums, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return crc.join(offsets, "part").select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_to_files(docs: DataFrame, tokenizer: str, added: bool = False) -> DataFrame:
    """Write ``docs`` as token files into the shared folder and return their index."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer, added=added)
    return token_index(spark, path)
