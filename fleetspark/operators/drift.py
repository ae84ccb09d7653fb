"""Drift between two copies of many files (J9, U2) that splits only what differs.

Each text first becomes an order-free digest inside its row: its number of lines
and four sums of line hashes (two 64-bit hashes, in halves, so that no sum
overflows).  Digests add up, so a file may be held in several rows.  Only files
whose digests differ are split into lines and compared exactly
(``operators.lines.line_drift``); of equal trees, however large, only a few
numbers a file are shuffled.  Two files with the same digest are taken as equal
(128 bits of hash).

A null text has no lines, as a missing file; null keys are one file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.text import lines_array
from fleetspark.operators.lines import line_drift, to_lines
from fleetspark.operators.sizing import write_once

_LOW = 0xFFFFFFFF
_SUMS = ["_n", "_h0", "_h1", "_h2", "_h3"]


def _digest(text_col: str) -> list[Column]:
    """Line count and sums of the halves of two line hashes."""
    def total(part):
        return F.aggregate("_lines", F.lit(0).cast("long"), lambda acc, x: acc + part(x))

    hashes = (lambda x: F.xxhash64(x), lambda x: F.xxhash64(F.lit(1), x))
    parts = [total(lambda x, h=h: h(x).bitwiseAND(F.lit(_LOW).cast("long"))) for h in hashes]
    parts += [total(lambda x, h=h: F.shiftrightunsigned(h(x), 32)) for h in hashes]
    return [c.alias(n) for c, n in zip([F.size("_lines").cast("long"), *parts], _SUMS)]


def file_digests(texts: DataFrame, text_col: str, key_cols: Sequence[str]) -> DataFrame:
    """One row per file that has lines: its keys and its digest, whatever the order of its lines."""
    split = texts.where(F.col(text_col).isNotNull()).select(*key_cols, lines_array(F.col(text_col)).alias("_lines"))
    return split.select(*key_cols, *_digest(text_col)).groupBy(*key_cols).agg(*[F.sum(n).alias(n) for n in _SUMS])


def differing_files(a: DataFrame, b: DataFrame, text_col: str, key_cols: Sequence[str]) -> DataFrame:
    """Keys of the files whose lines are not the same multiset in both copies.

    The digests of ``b`` count negative: a file is equal in both where every sum is zero."""
    minus = file_digests(b, text_col, key_cols).select(*key_cols, *[(-F.col(n)).alias(n) for n in _SUMS])
    sums = file_digests(a, text_col, key_cols).unionByName(minus).groupBy(*key_cols).agg(*[F.sum(n).alias(n) for n in _SUMS])
    differs = F.lit(False)
    for n in _SUMS:
        differs = differs | (F.col(n) != 0)
    return sums.where(differs).select(*key_cols)


def text_drift(a: DataFrame, b: DataFrame, text_col: str, key_cols: Sequence[str],
               a_name: str = "only_a", b_name: str = "only_b") -> DataFrame:
    """``line_drift`` of two frames of texts: only files whose digests differ are split into lines.

    The differing keys are written once, so both sides are filtered by the same rows; Spark broadcasts
    them where their measured size is small."""
    keys = write_once(differing_files(a, b, text_col, key_cols), "differing-files").select(
        *[F.col(k).alias(f"_k_{k}") for k in key_cols])
    same = F.lit(True)
    for k in key_cols:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))

    def lines(texts):
        return to_lines(texts.select(*key_cols, text_col).join(keys, same, "left_semi"), text_col, key_cols)

    return line_drift(lines(a), lines(b), key_cols, a_name=a_name, b_name=b_name)
