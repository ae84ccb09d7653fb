"""Operator 6: bounded-space online best-fit packing of token sequences.

A packer keeps a fixed number of open bins.  A bitset (one Python integer) has
bit ``f`` set while some open bin has ``f`` tokens free, so the fullest bin that
still takes a piece is the lowest set bit at or above the piece's length.  A bin
closes when it is full; when a new one would exceed the fixed number, the
fullest open one closes first.

Spark deals the pieces by a hash of all their columns and their place in the written table (so
repeated rows spread too) into groups of about ``group_rows`` pieces, each
packed as one online stream.  Bins that still have a twentieth free at a group's
end are undone: their pieces go on to the next level, where far fewer groups remain,
until one group is left, or until a level undoes more than half of its pieces (then groups hold
fewer bins than ``open_bins``, or pieces too long to share a bin, and a further level would gain
little).  So no task sees more than a group, and only the last level's groups leave
partly filled bins behind, at most ``open_bins`` each.

Defined results: a null text is empty (one piece with the end id only); repeated
rows are packed each; null ``doc_id`` values stay null; pieces of equal hash are taken in the order of
their columns; a text of any length is cut, and only its last piece may be short; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import written
from fleetspark.llm.token_files import END_ID, ChunkEncoder, text_blocks

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = PIECE_SCHEMA + ", level int, group_id long, sequence_id long, offset long"
SEQUENCE_TOKENS = 2048


class BestFit:
    """Online best-fit over ``capacity`` with at most ``open_bins`` open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit f: some open bin has f free
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_id

    def add(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``capacity`` tokens."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_id = self.capacity, self.n_bins
            self.n_bins += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(bin_id)
            self.bits |= 1 << rest
            self.n_open += 1
        return bin_id, self.capacity - free

    def still_open(self, least_free: int = 1) -> set[int]:
        return {b for stack in self.by_free[least_free:] for b in stack}


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID,
                 with_ids: bool = False, added: bool = False) -> DataFrame:
    """Cut each document's ids (plus the end id) into pieces of at most ``max_tokens``.

    ``with_ids`` adds the ids themselves, for writers of packed sequences;
    ``added`` as for ``ChunkEncoder``.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches):
        encoder = ChunkEncoder.of_worker(tokenizer, words=True, added=added)
        step = 4 * max_tokens
        for batch in batches:
            for first, texts in text_blocks(batch.column("text"), 2 << 20):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(encoder.encode(texts.to_pylist())):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), step)):
                        part = raw[at:at + step]
                        row.append(first + i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, dtype="<i4"))
                arrays = [batch.column("doc_id").take(pa.array(row, type=pa.int64())).cast(pa.int64()),
                          pa.array(piece, type=pa.int32()), pa.array(start, type=pa.int64()),
                          pa.array(length, type=pa.int64()), pa.array(crc, type=pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(ids, type=pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, open_bins: int = 2048,
                group_rows: int = 65_536) -> DataFrame:
    """Place every piece: adds ``sequence_id`` (any number) and ``offset`` (gapless from 0).

    ``pieces`` has the columns of ``PIECE_SCHEMA``; it is written once before it is dealt.
    """
    rest = written(pieces, "pieces")
    placed, level, before = [], 0, None
    while True:
        n = rest.count()
        groups = max(1, -(-n // group_rows))
        # the last level: one group, or undone bins did not become fewer (a group smaller than its open bins)
        last = groups == 1 or before is not None and 2 * n > before
        out = written(_pack_level(rest, capacity, open_bins, groups, level, last), "placed")
        placed.append(out.where("sequence_id IS NOT NULL"))
        if last:
            break
        before = n
        rest = out.where("sequence_id IS NULL").select("doc_id", "piece", "start", "length", "ids_crc32")
        level += 1
    result = placed[0]
    for more in placed[1:]:
        result = result.unionByName(more)
    return result.drop("level", "group_id")


def _pack_level(pieces: DataFrame, capacity: int, open_bins: int, groups: int, level: int,
                last: bool) -> DataFrame:
    almost_full = capacity // 20  # a bin with no more free than this is not worth undoing

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        # a fixed order, unrelated to length, that does not hang on how rows arrived
        pdf = pdf.sort_values(["order", "doc_id", "piece", "start", "length", "ids_crc32"], kind="stable")
        packer = BestFit(capacity, open_bins)
        spots = [packer.add(n) for n in pdf["length"].tolist()]
        bins = np.fromiter((b for b, _ in spots), dtype=np.int64, count=len(spots))
        group = int(pdf["group_id"].iloc[0])
        out = pdf.drop(columns="order")
        sequence = pd.Series((level << 58) + (group << 26) + bins, index=out.index, dtype="Int64")
        if not last:
            sequence[np.isin(bins, np.fromiter(packer.still_open(almost_full + 1), dtype=np.int64))] = pd.NA
        return out.assign(level=level, sequence_id=sequence, offset=[o for _, o in spots])[
            [c.split(" ")[0] for c in PLACED_SCHEMA.split(", ")]].astype({"doc_id": "Int64"})

    # the place in the written table: the same in a retry, which reads the same file splits
    keyed = pieces.withColumn("order", F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32",
                                                  F.monotonically_increasing_id(), F.lit(level)))
    keyed = keyed.withColumn("group_id", F.pmod(F.xxhash64("order"), F.lit(groups)))
    return keyed.groupBy("group_id").applyInPandas(pack, PLACED_SCHEMA)
