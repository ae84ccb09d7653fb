"""Operator 8: removal of repeated 100-byte strings by bucket-pointer refinement.

Two suffixes match over ``LENGTH`` bytes if and only if they fall into one bucket when
all suffixes are bucketed by their first ``LENGTH`` bytes.  The buckets are refined in
three rounds, and what a round settles does not enter the next:

1. Initial q-gram buckets.  Each window of ``LENGTH`` bytes is put into the bucket of one
   of its q-grams: the one with the smallest hash, leftmost first.  Equal windows
   choose the same q-gram, and neighbouring windows mostly share it, so a text is
   a row of *runs* (about one per 34 bytes), each with one bucket identifier.
2. Whole runs.  Within a bucket, runs are sorted by an identifier of all bytes
   their windows reach (128 bits with the bucket's).  Of equal runs only the first
   (smallest document, then offset) keeps its windows; all windows of the others
   start earlier elsewhere.  Buckets with one kind of run are settled.
3. Later offsets.  The first runs of the other buckets are cut into windows;
   each is sorted on the bucket identifier of its first half, and where that is
   shared, on the identifier of the half that starts ``LENGTH`` / 2 bytes later.  All
   but the first window of a bucket start earlier elsewhere.

Runs and windows travel as packed numpy arrays, a few rows per task and bucket;
each task first settles what repeats within its own rows, so a passage that a
third of all documents share reaches its bucket once per task.  Texts are shuffled
once, by document, and serve rounds 3 and the removal.

Defined results: a null text is empty; texts under ``LENGTH`` bytes lose nothing; a null
``doc_id`` stands before all others; rows of one ``doc_id`` are ordered by the hash of
their text, equal rows are one document (neither is earlier than the other); extra columns
pass through ``deduplicated``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import shuffle_partitions, written

LENGTH, Q = 100, 32
_SEGMENT_BITS = 20  # windows are hashed a megabyte at a time
_MASK = np.uint64((1 << _SEGMENT_BITS) - 1)
_FLUSH = 300_000  # runs or windows a task gathers before it settles and sends them
_PACKED = "bucket int, kind int, packed binary"
RUNS, SPANS, WINDOWS = 0, 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_TABLE = _mixed((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_BASE))


class Hasher:
    """Polynomial hashes (modulo 2**64, odd base) of any part of a segment in constant time."""

    def __init__(self):
        n = 1 << _SEGMENT_BITS
        self.power = self._powers(_BASE, n)
        self.inverse = self._powers(pow(_BASE, -1, 1 << 64), n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def prefix(self, seg: np.ndarray) -> np.ndarray:
        out = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[seg] * self.power[:len(seg)], out=out[1:])
        return out

    def part(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((prefix[end] - prefix[begin]) * self.inverse[begin])

    def grams(self, prefix: np.ndarray, q: int) -> np.ndarray:
        return _mixed((prefix[q:] - prefix[:-q]) * self.inverse[:len(prefix) - q])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:len(values) - (width - have)], values[width - have:]) if width > have else values


def _valid(offsets: np.ndarray) -> np.ndarray:
    """Which positions of concatenated texts start a window within their text."""
    ok = np.ones(int(offsets[-1]), dtype=bool)
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ok[max(begin, end - LENGTH + 1):end] = False
    return ok


def runs_of(data: np.ndarray, offsets: np.ndarray, hasher: Hasher):
    """(bucket id, run id, first window, number of windows) of every run; windows as positions in ``data``."""
    ok, width = _valid(offsets), LENGTH - Q + 1
    step = (1 << _SEGMENT_BITS) - LENGTH
    out = []
    for lo in range(0, len(data), step):
        seg = data[lo:lo + step + LENGTH - 1]
        here = ok[lo:lo + max(0, len(seg) - LENGTH + 1)]
        if not here.any():
            continue
        prefix = hasher.prefix(seg)
        gram = hasher.grams(prefix, Q)
        place = np.arange(len(gram), dtype=np.uint64)
        chosen = (_smallest((gram & ~_MASK) | place, width) & _MASK).astype(np.int64)
        new = here.copy()
        new[1:] &= ~here[:-1] | (chosen[1:] != chosen[:-1])
        last = here.copy()
        last[:-1] &= ~here[1:] | (chosen[1:] != chosen[:-1])
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        anchor = chosen[a]
        shape = ((anchor - a).astype(np.uint64) << np.uint64(8)) | (b - a).astype(np.uint64)
        run = _mixed(hasher.part(prefix, a, b + LENGTH) + _mixed(shape + np.uint64(1)))
        out.append((gram[anchor], run, a + lo, b - a + 1))
    if not out:
        return [np.empty(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64)]
    return [np.concatenate(x) for x in zip(*out, strict=True)]


_LAYOUT = {RUNS: ("<u8", "<u8", "<i8", "<i4", "<i4"), SPANS: ("<i8", "<i4", "<i4"), WINDOWS: ("<u8", "<u8", "<i8", "<i4")}
#: runs: bucket id, run id, document, first window, windows; spans: document, first byte, last byte + 1;
#: windows: identifiers of the two halves, document, position


def _pack(kind: int, columns: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(c, dtype=t).tobytes() for c, t in zip(columns, _LAYOUT[kind], strict=True))


def _unpack(kind: int, blobs: list[bytes]) -> list[np.ndarray]:
    types = [np.dtype(t) for t in _LAYOUT[kind]]
    row = sum(t.itemsize for t in types)
    columns: list[list[np.ndarray]] = [[] for _ in types]
    for blob in blobs:
        n, at = len(blob) // row, 0
        for c, t in zip(columns, types, strict=True):
            c.append(np.frombuffer(blob, dtype=t, count=n, offset=at))
            at += n * t.itemsize
    return [np.concatenate(c) if c else np.empty(0, dtype=t) for c, t in zip(columns, types, strict=True)]


def _dealt(kind: int, bucket: np.ndarray, columns: list[np.ndarray]):
    """One packed row per bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    end = np.concatenate([begin[1:], [len(bucket)]])
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[begin], type=pa.int32()), pa.array(np.full(len(begin), kind), type=pa.int32()),
         pa.array([_pack(kind, [c[i:j] for c in columns]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)],
                  type=pa.binary())], names=["bucket", "kind", "packed"])


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Spans sorted by document and joined where they touch."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    shift = (np.cumsum(first) - 1) * np.int64(1 << 32)  # documents apart, so one running maximum does
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], begin[1:] + shift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    stop = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], begin[at], (reach[stop] - shift[stop]).astype(end.dtype)


def _spans(doc, begin, end, docs_in: int):
    doc, begin, end = _merged(np.asarray(doc, dtype=np.int64), np.asarray(begin, dtype=np.int64),
                              np.asarray(end, dtype=np.int64))
    yield from _dealt(SPANS, np.mod(doc, docs_in), [doc, begin, end])


def _equal_runs(columns: list[np.ndarray]):
    """Sort runs by (bucket, run, document, place): sorted columns, first of its kind, repeats an earlier one."""
    order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    g, run, doc, at = columns[:4]
    first = np.concatenate([[True], (g[1:] != g[:-1]) | (run[1:] != run[:-1])]) if len(g) else np.empty(0, dtype=bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    return columns, first, (doc != doc[head]) | (at != at[head])


def _gather_runs(buckets: int, docs_in: int):
    def send(parts):
        columns, first, repeats = _equal_runs([np.concatenate(x) for x in zip(*parts, strict=True)])
        yield from _spans(columns[2][repeats], columns[3][repeats],
                          (columns[3] + columns[4])[repeats] + LENGTH - 1, docs_in)
        kept = [c[first] for c in columns]
        yield from _dealt(RUNS, (kept[0] % np.uint64(buckets)).astype(np.int64), kept)

    def gather(batches):
        hasher, parts, held = Hasher(), [], 0
        for batch in batches:
            ids = batch.column("key").to_numpy()
            column = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
            if not len(column) or offsets[-1] == offsets[0]:
                continue
            data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
            offsets = offsets - offsets[0]
            g, run, at, n = runs_of(data, offsets, hasher)
            of = np.searchsorted(offsets, at, side="right") - 1
            for i in range(0, len(g), _FLUSH):
                j = i + _FLUSH
                parts.append((g[i:j], run[i:j], ids[of[i:j]], at[i:j] - offsets[of[i:j]], n[i:j]))
                held += len(parts[-1][0])
                if held >= _FLUSH:
                    yield from send(parts)
                    parts, held = [], 0
        if parts:
            yield from send(parts)

    return gather


def _by_bucket(batches, settle):
    """Call ``settle(bucket, {kind: blobs})`` for every bucket of rows sorted by bucket."""
    now, blobs = None, {}
    for batch in batches:
        for bucket, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(),
                                      batch.column("packed"), strict=True):
            if bucket != now and blobs:
                yield from settle(now, blobs)
                blobs = {}
            now = bucket
            blobs.setdefault(kind, []).append(blob.as_py())
    if blobs:
        yield from settle(now, blobs)


def _settle_runs(docs_in: int):
    def settle(bucket, blobs):
        for blob in blobs.get(SPANS, []):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], type=pa.int32()), pa.array([SPANS], type=pa.int32()),
                                              pa.array([blob], type=pa.binary())], names=["bucket", "kind", "packed"])
        if RUNS not in blobs:
            return
        columns, first, repeats = _equal_runs(_unpack(RUNS, blobs[RUNS]))
        yield from _spans(columns[2][repeats], columns[3][repeats].astype(np.int64),
                          (columns[3].astype(np.int64) + columns[4])[repeats] + LENGTH - 1, docs_in)
        kinds = [c[first] for c in columns]  # the first run of each kind
        g = kinds[0]
        group = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1
        open_ = np.bincount(group)[group] > 1
        if open_.any():
            kinds = [c[open_] for c in kinds]
            yield from _dealt(RUNS, np.mod(kinds[2], docs_in), kinds)

    return lambda batches: _by_bucket(batches, settle)


def _cut_windows(buckets: int, docs_in: int):
    """Round 3, per group of documents: the windows of runs that are still open."""
    hasher = Hasher()
    half = LENGTH // 2

    def cut(texts: pa.Table, rows: pa.Table) -> pa.Table:
        _, _, doc, at, n = _unpack(RUNS, rows.column("packed").to_pylist())
        out = []
        if len(doc):
            order = np.lexsort((at, doc))
            doc, at, n = doc[order], at[order], n[order]
            ids = texts.column("key").to_numpy()
            parts = []
            for i, text in sorted({int(k): i for i, k in enumerate(ids.tolist())}.items()):
                lo, hi = np.searchsorted(doc, i, "left"), np.searchsorted(doc, i, "right")
                if lo == hi:
                    continue
                data = np.frombuffer(texts.column("text")[text].as_py().encode(), dtype=np.uint8)
                start = np.repeat(at[lo:hi].astype(np.int64), n[lo:hi])
                start += np.arange(len(start)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
                step = (1 << _SEGMENT_BITS) - LENGTH
                for base in range(0, len(data), step):
                    mine = start[(start >= base) & (start < base + step)]
                    if len(mine):
                        prefix = hasher.prefix(data[base:base + step + LENGTH])
                        s = mine - base
                        parts.append((hasher.part(prefix, s, s + half), hasher.part(prefix, s + half, s + LENGTH),
                                      np.full(len(s), i, dtype=np.int64), mine))
            if parts:
                columns, first, repeats = _equal_runs([np.concatenate(x) for x in zip(*parts, strict=True)])
                out += _spans(columns[2][repeats], columns[3][repeats], columns[3][repeats] + LENGTH, docs_in)
                kept = [c[first] for c in columns]
                out += _dealt(WINDOWS, (kept[0] % np.uint64(buckets)).astype(np.int64), kept)
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary())])
        return pa.Table.from_batches(out, schema=schema)

    return cut


def _settle_windows(docs_in: int):
    def settle(bucket, blobs):
        for blob in blobs.get(SPANS, []):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], type=pa.int32()), pa.array([SPANS], type=pa.int32()),
                                              pa.array([blob], type=pa.binary())], names=["bucket", "kind", "packed"])
        if WINDOWS not in blobs:
            return
        columns = _unpack(WINDOWS, blobs[WINDOWS])
        # first halves alone settle most windows
        _, group, size = np.unique(columns[0], return_inverse=True, return_counts=True)
        shared = size[group] > 1
        columns, _, repeats = _equal_runs([c[shared] for c in columns])
        at = columns[3][repeats].astype(np.int64)
        yield from _spans(columns[2][repeats], at, at + LENGTH, docs_in)

    return lambda batches: _by_bucket(batches, settle)


def _remove(columns: list[str], with_text: bool):
    """Take the spans out of each text of a group of documents."""
    def remove(texts: pa.Table, rows: pa.Table) -> pa.Table:
        doc, begin, end = _merged(*[x.astype(np.int64) for x in _unpack(SPANS, rows.column("packed").to_pylist())])
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for key, text in zip(texts.column("key").to_pylist(), texts.column("text"), strict=True):
            raw = text.as_py().encode()
            lo, hi = np.searchsorted(doc, key, "left"), np.searchsorted(doc, key, "right")
            kept, at = [], 0
            for a, b in zip(begin[lo:hi].tolist(), end[lo:hi].tolist(), strict=True):
                kept.append(raw[at:a])
                at = b
            left = b"".join([*kept, raw[at:]])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(left))
            out["n_spans"].append(int(hi - lo))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            if with_text:
                out["kept_text"].append(left.decode(errors="ignore"))
        arrays = [texts.column(c) for c in columns] + [
            pa.array(out[c], type=pa.string() if c.startswith("kept") else pa.int64())
            for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else []))]
        names = [*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])]
        return pa.Table.from_arrays(arrays, names=names)

    return remove


def _prime_from(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def with_keys(docs: DataFrame) -> DataFrame:
    """Adds ``key``: the document's number in removal order; its ``doc_id`` where those are unique and not null."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    n = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"]:
        return docs.withColumn("key", F.col("doc_id"))
    order = ["has_id", "id", "of_text"]
    each = docs.select(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                       F.xxhash64("text").alias("of_text"))
    ranged = written(each.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ids")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("start")
    keys = written(ranged.join(starts, "part").select(*order, number.cast("long").alias("key")), "keys")
    marked = docs.withColumn("has_id", F.col("doc_id").isNotNull()).withColumn(
        "id", F.coalesce("doc_id", F.lit(0))).withColumn("of_text", F.xxhash64("text"))
    return marked.join(keys, order).drop(*order)


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text and any more columns): sizes, spans and digest of what is left.

    ``with_text`` adds ``kept_text``; a character of which only some bytes stay is
    left out of it.  ``text`` itself is dropped.
    """
    spark = docs.sparkSession
    buckets = 2 * shuffle_partitions(spark)
    docs_in = _prime_from(shuffle_partitions(spark) + 1)  # a group of documents sends a row per bucket
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       *[F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(more)])
    keyed = with_keys(rows)
    packed = keyed.select("key", "text").mapInArrow(_gather_runs(buckets, docs_in), _PACKED)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    rounds = written(dealt.mapInArrow(_settle_runs(docs_in), _PACKED), "runs")
    texts = keyed.withColumn("docs_in", F.pmod(F.col("key"), F.lit(docs_in)).cast("int"))
    grouped = texts.groupBy("docs_in")
    still = rounds.where(F.col("kind") == RUNS)
    windows = grouped.cogroup(still.groupBy("bucket")).applyInArrow(_cut_windows(buckets, docs_in), _PACKED)
    late = (windows.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(_settle_windows(docs_in), _PACKED))
    spans = rounds.where(F.col("kind") == SPANS).unionByName(late)
    columns = ["doc_id", *[f"carry_{i}" for i in range(len(more))]]
    fields = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    schema = ", ".join([f"{c} {fields[c]}" for c in columns] + [
        "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + (["kept_text string"] if with_text else []))
    out = grouped.cogroup(spans.groupBy("bucket")).applyInArrow(_remove(columns, with_text), schema)
    return out.select("doc_id", *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(more)], "n_bytes", "n_removed",
                      "n_spans", "kept_sha256", *(["kept_text"] if with_text else []))
