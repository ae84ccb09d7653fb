"""Operator 5: SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit set where more than half of its shingles' XXH64
values have it.  Distinct fingerprints are dealt to buckets: the 64 bits form
eight bytes, and for every choice of ``radius`` bytes a bucket holds the
fingerprints that agree in all others.  Two fingerprints at most ``radius`` bits
apart differ in at most so many bytes, so they meet in some bucket; the link is
reported by the first such choice only.  A bucket has at most 256 ** radius
fingerprints, whatever the data, since they are distinct.

In a bucket the free bits are stored vertically: one machine word holds the same
bit of 64 fingerprints.  Comparing one fingerprint with 64 others is then an
exclusive or per plane, added up by carry-save bitwise counters; a block of 64 is
abandoned as soon as all its distances exceed the radius.

Links go to ``connected_components``; copies of one fingerprint are never paired,
they share their class.  Defined results: a null or blank text has fingerprint
zero, linked like any other; repeated rows share their class; a null ``doc_id`` is
never the smallest of a class that has another; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import written
from fleetspark.llm.components import connected_components

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of every run of ``words`` words (fewer words: of all of them; none: empty)."""
    parts = (text or "").encode().translate(_LOWER).split()  # ASCII white space
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends, at = [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:], strict=False)]


def majority_bits(hashes: list[list[int]]) -> np.ndarray:
    """One fingerprint (uint64) per list of hashes."""
    counts = np.asarray([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype="<u8")
    full = np.flatnonzero(counts)
    if len(full):
        flat = np.asarray([x for h in hashes for x in h], dtype="<u8")
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        sums = np.zeros((len(full), 64), dtype=np.int64)
        step = 1 << 17  # hashes unpacked at a time
        owner = np.repeat(np.arange(len(full)), counts[full])
        for at in range(0, len(flat), step):
            bits = np.unpackbits(flat[at:at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            mine = owner[at:at + step]
            begin = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            sums[mine[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        del starts
        bits = (2 * sums > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_hash and fingerprint (``fp``, the 64 bits as a long) of each row of ``docs``."""
    def compute(batches):
        for batch in batches:
            fps, some, size = [], [], 0
            for value in batch.column("text"):
                some.append(shingle_hashes(value.as_py(), words))
                size += len(some[-1])
                if size > 1 << 17:
                    fps.append(majority_bits(some))
                    some, size = [], 0
            fps.append(majority_bits(some))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.concatenate(fps).view("<i8"))],
                names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(compute, "doc_id long, text_hash long, fp long")


class Buckets:
    """Choices of ``radius`` of the eight bytes, and the first choice that covers a set of bytes."""

    def __init__(self, radius: int):
        self.radius = radius
        self.choices = list(combinations(range(8), radius))
        self.first = np.full(256, -1, dtype=np.int64)
        for t, choice in reversed(list(enumerate(self.choices))):
            covered = sum(1 << b for b in choice)
            for s in range(256):
                if s & covered == s:
                    self.first[s] = t

    def fixed_mask(self, t: int) -> int:
        """The bits that all fingerprints of a bucket of choice ``t`` share, as a signed long."""
        mask = sum(255 << (8 * b) for b in range(8) if b not in self.choices[t])
        return mask - (1 << 64) if mask >> 63 else mask


def compare_bucketed(t: np.ndarray, key: np.ndarray, fp: np.ndarray, buckets: Buckets, chunk: int = 1 << 16):
    """Links (a, b) among rows sorted by bucket (``t``, ``key``), found on bit planes."""
    radius, free_bits = buckets.radius, 8 * buckets.radius
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    several = size[group] > 1
    if not several.any():
        return np.empty(0, dtype=fp.dtype), np.empty(0, dtype=fp.dtype)
    t, fp, group = t[several], fp[several].view("<u8"), group[several]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([begin, [len(fp)]]))
    local = np.arange(len(fp)) - np.repeat(begin, size)
    lane = (local % 64).astype(np.uint64)
    # the free bits of each row, packed
    value = np.zeros(len(fp), dtype=np.uint64)
    choice = np.asarray(buckets.choices, dtype=np.uint64)
    for k in range(radius):
        value |= ((fp >> (choice[t, k] * np.uint64(8))) & np.uint64(255)) << np.uint64(8 * k)
    # words of 64 rows and their bit planes
    word_begin = np.flatnonzero(local % 64 == 0)
    word_of = np.cumsum(local % 64 == 0) - 1
    planes = np.empty((free_bits, len(word_begin)), dtype=np.uint64)
    for k in range(free_bits):
        planes[k] = np.bitwise_or.reduceat(((value >> np.uint64(k)) & np.uint64(1)) << lane, word_begin)
    valid = np.bitwise_or.reduceat(np.uint64(1) << lane, word_begin)
    words_in = -(-size // 64)
    last_word = np.repeat(np.cumsum(words_in), size)  # one past the group's last word
    n_words = last_word - word_of  # a row is compared with its own word and the later ones
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = (radius + 1).bit_length()
    found_a, found_b = [], []
    ends = np.cumsum(n_words)
    first_row = 0
    while first_row < len(fp):
        stop = max(first_row + 1, int(np.searchsorted(ends, (ends[first_row - 1] if first_row else 0) + chunk, "right")))
        rows = np.arange(first_row, stop)
        q = np.repeat(rows, n_words[rows])
        w = word_of[q] + np.arange(len(q)) - np.repeat(np.cumsum(n_words[rows]) - n_words[rows], n_words[rows])
        alive = valid[w]
        own = w == word_of[q]
        later = np.where(lane[q] == 63, np.uint64(0), ones << np.minimum(lane[q] + np.uint64(1), np.uint64(63)))
        alive = np.where(own, alive & later, alive)
        c = [np.zeros(len(q), dtype=np.uint64) for _ in range(counters)]
        over = np.zeros(len(q), dtype=np.uint64)
        v = value[q]
        for k in range(free_bits):
            carry = planes[k][w] ^ (np.uint64(0) - ((v >> np.uint64(k)) & np.uint64(1)))
            for i in range(counters):
                c[i], carry = c[i] ^ carry, c[i] & carry
            over |= carry
            if k % 4 == 3:
                live = np.flatnonzero(alive & ~_above(c, over, radius, ones))
                if len(live) < len(q):  # these blocks exceed the radius everywhere
                    q, w, v, alive, over = q[live], w[live], v[live], alive[live], over[live]
                    c = [x[live] for x in c]
        hits = alive & ~_above(c, over, radius, ones)
        for b in range(64):
            at = np.flatnonzero(hits >> np.uint64(b) & np.uint64(1))
            if len(at):
                a_row, b_row = q[at], word_begin[w[at]] + b
                apart = fp[a_row] ^ fp[b_row]
                touched = np.zeros(len(at), dtype=np.int64)
                for k in range(8):
                    touched |= ((apart >> np.uint64(8 * k)) & np.uint64(255) > 0).astype(np.int64) << k
                here = buckets.first[touched] == t[a_row]
                found_a.append(fp[a_row][here])
                found_b.append(fp[b_row][here])
        first_row = stop
    join = lambda x: np.concatenate(x).view("<i8") if x else np.empty(0, dtype="<i8")
    return join(found_a), join(found_b)


def _above(c: list[np.ndarray], over: np.ndarray, radius: int, ones: np.uint64) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``."""
    above, equal = over.copy(), np.full(len(over), ones)
    for i in reversed(range(len(c))):
        if radius >> i & 1:
            equal &= c[i]
        else:
            above |= equal & c[i]
            equal &= ~c[i]
    return above


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) for every two different fingerprints (``fp``, distinct) at most ``radius`` bits apart."""
    buckets = Buckets(radius)

    def compare(batches):
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("t", "key", "fp")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if len(now[0]) == 0:
                continue
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0  # the last bucket may go on
            rest = [x[cut:] for x in now]
            if cut:
                a, b = compare_bucketed(*[x[:cut] for x in now], buckets)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if rest is not None and len(rest[0]):
            a, b = compare_bucketed(*rest, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(buckets.fixed_mask(t))).alias("key"))
        for t in range(len(buckets.choices))])).alias("b")).select("b.t", "b.key", "fp")
    return (keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
            .mapInArrow(compare, "a long, b long"))


def classes(prints: DataFrame, radius: int = 2) -> DataFrame:
    """fp -> root (one fingerprint of its class) and component_id (smallest doc_id reachable by links, null if all are).

    ``prints`` is a written table of fingerprints.
    """
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    pairs = written(links(distinct.select("fp"), radius), "pairs")
    if pairs.isEmpty():
        return distinct.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    roots = written(connected_components(pairs).withColumnRenamed("node", "fp"), "roots")
    least = written(distinct.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id")), "least")
    linked = written(roots.join(least, "root").select("fp", "root", "component_id"), "linked")
    return written(distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, text_hash, fp and component_id of every row of ``docs`` (doc_id, text)."""
    prints = written(fingerprints(docs, words), "fingerprints")
    return prints.join(classes(prints, radius), "fp")


def hex_print(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest ``doc_id`` (nulls last).

    A class of null ids only keeps one row too, that with the smallest text hash; of rows
    that repeat the chosen id and text one stays.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    of_fp = classes(prints, radius)
    nothing = F.lit((1 << 63) - 1)
    key = F.struct(F.coalesce("doc_id", nothing).alias("id"), "text_hash", F.col("fp").alias("own"))
    firsts = written(prints.groupBy("fp").agg(F.min(key).alias("first")), "firsts")
    chosen = firsts.join(of_fp, "fp").groupBy("root").agg(F.min("first").alias("first")).select(
        "first.id", "first.text_hash")
    stay = written(chosen, "stay")
    marked = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), nothing)).withColumn(
        "__hash", F.xxhash64("text"))
    kept = marked.join(stay.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")),
                       ["__id", "__hash"], "left_semi")
    return kept.dropDuplicates(["__id", "__hash"]).select(*docs.columns)
