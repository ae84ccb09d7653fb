"""Operator 12: SentencePiece encoding and decoding by a table of distinct chunks.

White space is written as the marker U+2581, and in a model none of whose pieces has a
marker after another character no piece can cross from one marked word (a run of
markers and the characters up to the next marker) into the next.  So the segmentation of a
text is that of its marked words, one after the other.  Per block of texts:

1. the marked words are slices of the block's bytes, numbered by Arrow's dictionary: the
   table of the block's distinct chunks, and each position's place in it;
2. each distinct chunk is looked up in the Python worker's table and, if it is new there,
   segmented by the ``sentencepiece`` library (all new chunks of a block in one call);
3. the ids are joined back by position: two array look-ups spread each chunk's ids over
   all places where it stands.

A worker's table keeps at most ``max_entries`` chunks of up to ``longest`` bytes and then starts
anew; longer chunks are segmented where they stand.  Nothing is shuffled: a table for the whole
corpus would have to be joined back to every block, so it would shuffle a row per block
and distinct word, while segmenting a word once more in each worker costs microseconds.

``encode`` checks the model first (``ChunkTable.independent``): piece types, markers
within pieces, normalizer and white-space options.  A model that does not allow the split is
used on whole texts.  ``decode`` calls the library's ``decode`` on each row's whole id list.

Defined results: a null or empty text has no ids and decodes to the empty text; U+2581 in a
text is white space, as in the library, so it decodes to a blank; repeated rows are each encoded;
null ids and ties are of no account (rows are independent); extra columns are ignored unless named
in ``keep``; an empty table gives an empty result.  Blocks hold about ``BLOCK`` bytes of text
or one longer text, whose ids are in memory at once.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.token_files import text_blocks

BLOCK = 4 << 20
MARKER = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # piece types of the model file


class ChunkTable:
    """Ids of marked words (written with blanks for markers), segmented once each."""

    def __init__(self, path: str, max_entries: int = 500_000, longest: int = 64):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.max_entries, self.longest = max_entries, longest
        self.whole = not self.independent()
        self.blank = [] if self.whole else [self.library.piece_to_id(MARKER)]  # of a chunk that is one marker alone
        self.ids: dict[str, bytes] = {}

    def independent(self) -> bool:
        """Whether segmentation cannot cross from one marked word into the next."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        rules, trained = model.normalizer_spec, model.trainer_spec
        return (not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
                and rules.escape_whitespaces and not trained.treat_whitespace_as_suffix
                and trained.model_type == trained.BPE
                and any(p.piece == MARKER and p.type == _NORMAL for p in model.pieces)
                and all(p.type in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) and MARKER not in p.piece.lstrip(MARKER)
                        for p in model.pieces))

    @classmethod
    def of_worker(cls, path: str) -> ChunkTable:
        """The Python worker's table, which later tasks use again."""
        if path not in _TABLES:
            _TABLES[path] = cls(path)
        return _TABLES[path]

    def lookup(self, chunks: list[str]) -> list[bytes]:
        """Ids (as 32-bit integers) of distinct chunks, each led by at least one blank."""
        if len(self.ids) > self.max_entries:
            self.ids.clear()
        out = list(map(self.ids.get, chunks))
        new = [i for i, ids in enumerate(out) if ids is None]
        # the library puts one marker before what it encodes, so a chunk goes in without its first blank
        segmented = self.library.encode([chunks[i][1:] for i in new], num_threads=1)
        for i, ids in zip(new, segmented, strict=True):
            out[i] = array("i", ids if len(chunks[i]) > 1 else self.blank).tobytes()
            if len(chunks[i]) <= self.longest:
                self.ids[chunks[i]] = out[i]
        return out

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) in a row, and how many each text has."""
        if self.whole:
            ids = self.library.encode(texts.to_pylist(), num_threads=1)
            return (np.asarray([i for one in ids for i in one], dtype=np.int32),
                    np.asarray([len(one) for one in ids], dtype=np.int64))
        led = pc.binary_join_element_wise("", pc.replace_substring(texts, MARKER, " "), " ")
        chunks, n_chunks = marked_words(led)
        coded = chunks.dictionary_encode()
        table = self.lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.asarray(list(map(len, table)), dtype=np.int64) // 4
        begins = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        at = np.repeat(begins[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        ids = np.frombuffer(b"".join(table), dtype=np.int32)[at]
        before = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(n_chunks)
        return ids, before[ends] - before[ends - n_chunks]


_TABLES: dict[str, ChunkTable] = {}


def marked_words(led: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The marked words of texts that each begin with a blank, and how many each text has (an empty one none)."""
    offsets = np.frombuffer(led.buffers()[1], dtype=np.int32)[led.offset:led.offset + len(led) + 1]
    data = np.frombuffer(led.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    blank = data == 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[offsets[:-1] - offsets[0]] = True
    at = np.flatnonzero(begins).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at + offsets[0], offsets[-1]).astype(np.int32)),
                                        led.buffers()[2])
    n = np.diff(np.searchsorted(at, offsets - offsets[0]))
    empty = np.diff(offsets) == 1  # the leading blank alone
    if empty.any():
        words = words.filter(pa.array(~np.repeat(empty, n)))
        n = np.where(empty, 0, n)
    return words, n


def encode(docs: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (``doc_id``) of ``docs`` (``doc_id``, ``text``), ``n_tokens`` and ``ids`` of each whole text.

    As the library encodes with no begin or end ids and no sampling.
    """
    keep = ["doc_id"] if keep is None else keep
    names = [f"__keep_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").alias("__text"))

    def of_batches(batches):
        table = ChunkTable.of_worker(model)
        for batch in batches:
            for first, texts in text_blocks(batch.column("__text"), BLOCK):
                ids, n = table.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(first, len(texts)) for c in names], pa.array(n),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))],
                    names=[*names, "n_tokens", "ids"])

    kept = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    out = rows.mapInArrow(of_batches, ", ".join([*kept, "n_tokens long, ids array<int>"]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "n_tokens", "ids")


def decode(encoded: DataFrame, model: str, column: str = "decoded", block_ids: int = 1 << 19) -> DataFrame:
    """``encoded`` with the text of each row's whole ``ids``, by the library's ``decode`` (null ids: empty)."""
    names = encoded.columns

    def of_batches(batches):
        library = ChunkTable.of_worker(model).library
        for batch in batches:
            lists = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(counts) // block_ids)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(counts)], strict=True):
                part = lists.slice(low, high - low)
                flat = part.flatten().to_pylist()
                ends = np.cumsum(counts[low:high]).tolist()
                texts = library.decode([flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], num_threads=1)
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, pa.array(texts, type=pa.string())],
                                                 names=[*names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(of_batches, f"{fields}, {column} string")
