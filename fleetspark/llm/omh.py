"""Operator 7: Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are runs of ``K`` words, each numbered by its occurrence (the third
"of the" differs from the first), hashed and dealt to ``BINS`` bins by the leading
bits of the hash (one permutation split into bins stands for ``BINS`` hash
functions).  Each bin keeps its ``L`` = 2 smallest hashes, puts them in the order in
which they stand in the text, and hashes the ordered tuple; the tuples of all
bins are the signature.  Moving a passage changes the order in tuples, so the
signature reacts to edits that a MinHash of the set does not see.

The likeness of two signatures is the share of equal tuples among the bins that
either fills.

All of it is array functions within a row: k-mers are packed as (36 hash bits, 27
position bits) in one long, sorted; the occurrence number is the distance to the
first equal hash, found by binary steps.  ``with_next`` puts each document beside
the next one in descending ``doc_id`` order with one shuffle: ranges bounded by
actual ids, the first row of each range copied to the range before it.

Defined results: a null text is empty; an empty text has one (empty) word; a null
``doc_id`` ranks below all others; rows of one ``doc_id`` are ordered by text, and equal
rows follow each other; a single row is its own next; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import shuffle_partitions

K, BIN_BITS = 2, 6
_POS_BITS, _HASH_BITS = 27, 36
_BIN_SHIFT = _POS_BITS + _HASH_BITS - BIN_BITS
_SPACE = "[\\x20\\x09-\\x0D]+"
_STEPS = [1 << b for b in range(_POS_BITS - 1, -1, -1)]
_LOWEST = -(1 << 63)


def _packed(h: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 64 - _HASH_BITS), _POS_BITS).bitwiseOR(position.cast("long"))


def _hash_of(x: Column) -> Column:
    return F.shiftright(x, _POS_BITS)


def with_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the signature of column ``text`` as array<int>, (bin, 24 tuple bits) per filled bin.

    Helper columns come and go; each is used more than once by the next one, so
    Spark computes it once a row.
    """
    w, a, b, c = "__words", "__sorted", "__numbered", "__chosen"
    trimmed = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    df = df.withColumn(w, F.split(trimmed, _SPACE))
    words, kmers = F.col(w), F.slice(F.col(w), F.lit(1), F.greatest(F.size(w) - (K - 1), F.lit(1)))
    df = df.withColumn(a, F.sort_array(F.transform(kmers, lambda x, i: _packed(
        F.xxhash64(x, *[F.get(words, i + j) for j in range(1, K)]), i))))
    ordered = F.col(a)

    def numbered(x: Column, i: Column) -> Column:
        run = F.aggregate(F.array(*[F.lit(s) for s in _STEPS]), i, lambda lo, step: F.when(
            (lo >= step) & (_hash_of(F.get(ordered, lo - step)) == _hash_of(x)), lo - step).otherwise(lo))
        repeated = (i > 0) & (_hash_of(F.get(ordered, i - 1)) == _hash_of(x))
        position = x.bitwiseAND(F.lit((1 << _POS_BITS) - 1))
        return F.when(repeated, _packed(F.xxhash64(_hash_of(x), i - run), position)).otherwise(x)

    df = df.withColumn(b, F.sort_array(F.transform(ordered, numbered)))
    rows = F.col(b)
    bin_of = lambda x: F.shiftright(x, _BIN_SHIFT)
    df = df.withColumn(c, F.filter(rows, lambda x, i: (i < 2) | (bin_of(F.get(rows, i - 2)) != bin_of(x))))
    chosen = F.col(c)
    position = lambda x: x.bitwiseAND(F.lit((1 << _POS_BITS) - 1))

    def ordered_tuple(x: Column, i: Column) -> Column:
        y = F.get(chosen, i + 1)
        pair = F.when(bin_of(y) == bin_of(x), F.when(
            position(x) < position(y), F.xxhash64(_hash_of(x), _hash_of(y))).otherwise(
            F.xxhash64(_hash_of(y), _hash_of(x)))).otherwise(F.xxhash64(_hash_of(x)))
        first = (i == 0) | (bin_of(F.get(chosen, i - 1)) != bin_of(x))
        code = F.shiftleft(bin_of(x), 24).bitwiseOR(pair.bitwiseAND(F.lit((1 << 24) - 1))).cast("int")
        return F.when(first, code).otherwise(F.lit(-1))

    return df.withColumn(name, F.filter(F.transform(chosen, ordered_tuple), lambda x: x >= 0)).drop(w, a, b, c)


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples among the bins that either signature fills."""
    bins = lambda c: F.transform(F.col(c), lambda x: F.shiftright(x, 24))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(bins(a), bins(b))), F.lit(1))


def as_string(name: str) -> Column:
    """Eight hex digits a filled bin: two for the bin, six for the tuple."""
    return F.array_join(F.transform(F.col(name), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def range_bounds(ids: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts`` values of ``column``, descending, the largest first, that cut it into even ranges."""
    shares = [i / parts for i in range(1, parts + 1)]
    row = ids.agg(F.percentile_approx(column, shares, 20 * parts).alias("q"), F.max(column).alias("top")).first()
    return sorted({*(row["q"] or []), *([] if row["top"] is None else [row["top"]])}, reverse=True) or [0]


def _range_of(value: Column, bounds: list[int], block: int = 256) -> Column:
    """How many of the descending ``bounds`` are at least ``value``, less one, in two steps."""
    table = F.array(*[F.lit(b) for b in bounds])
    if len(bounds) <= block:
        return F.size(F.filter(table, lambda b: b >= value)) - 1
    heads = F.array(*[F.lit(b) for b in bounds[::block]])
    at = (F.size(F.filter(heads, lambda b: b >= value)) - 1) * block
    return at + F.size(F.filter(F.slice(table, at + 1, F.lit(block)), lambda b: b >= value)) - 1


def with_next(docs: DataFrame, carried: list[str], parts: int | None = None) -> DataFrame:
    """Adds ``next_<c>`` for each column c of ``carried``: that of the next row in descending ``doc_id`` order.

    ``docs`` needs ``doc_id`` and ``text``; the last row's next is the first.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    parts = parts or shuffle_partitions(docs.sparkSession)
    bounds = range_bounds(docs.select(key.alias("k")), "k", parts)
    last = len(bounds) - 1
    keyed = docs.withColumn("__key", key)
    own = _range_of(F.col("__key"), bounds)
    keyed = keyed.withColumn("__range", own)
    is_head = F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("__range") + 1) == F.col("__key")
    before = F.when(F.col("__range") == 0, F.lit(last)).otherwise(F.col("__range") - 1)
    places = F.when(is_head, F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("ghost")),
                                     F.struct(before.alias("r"), F.lit(1).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("ghost"))))
    placed = keyed.withColumn("__at", F.explode(places)).withColumn("__r", F.col("__at.r")).withColumn(
        "__ghost", F.col("__at.ghost"))
    w = Window.partitionBy("__r").orderBy("__ghost", F.desc("__key"), F.xxhash64("text"), "text")
    for c in carried:
        placed = placed.withColumn(f"next_{c}", F.lead(c).over(w))
    return placed.where("__ghost = 0").drop("__key", "__range", "__at", "__r", "__ghost")


def fingerprint_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Signatures of each text, of its edited form and the likenesses to that and to the next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = with_next(with_signature(rows, "text", "signature"), ["text", "signature"], parts)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    signed = signed.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("text", "next_text")
    signed = with_signature(signed, "edited", "edited_signature")
    return signed.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string("signature").alias("fingerprint"),
        as_string("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"))
