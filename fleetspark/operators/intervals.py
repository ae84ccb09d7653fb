"""Most specific prefix by elementary intervals (J7): one shuffle of the points, whatever lengths the table has.

Nested prefixes are cut into disjoint segments, each with its deepest prefix, and a point's prefix is
that of the last segment that begins at or before it.  Both steps work inside *blocks* of 2^16
addresses, of which IPv4 has 65,536 however much data there is:

* prefixes of up to 15 bits are reduced to the deepest one of each block they cover (at most 65,536 rows);
* the others lie in one block.  Along the block's starts and ends, one window keeps per length the last
  prefix begun; the longest that has not ended is the segment's;
* points and segments meet in one window per block and *salt*: a block with more points than
  ``max_rows`` is dealt over several salts by a hash of the rows, and its segments (at most 2^17) are
  copied to each, so a hot block, or one hot address, is split.

Every point keeps one row; a null address, or one outside IPv4, has no prefix and takes no part in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions.ip import prefix_mask
from fleetspark.operators.policy import normalize_prefixes
from fleetspark.operators.sizing import collect_bounded

_BITS = 16


def _block(address) -> Column:
    return F.shiftright(address, _BITS)


def prefix_segments(prefixes: DataFrame) -> DataFrame:
    """(block, pos, deepest): from ``pos`` on in its block, ``deepest`` (attr, prefix_len; null in a gap) holds.

    A block that no prefix covers has no row; before a block's first ``pos`` nothing holds.
    """
    p = normalize_prefixes(prefixes).withColumn(
        "after", F.col("net") + (F.lit(1 << 32) - prefix_mask(F.col("prefix_len"))))
    lengths = sorted(r[0] for r in collect_bounded(p.select("prefix_len").distinct(), 33, "prefix lengths"))
    found = F.struct("attr", "prefix_len")
    outer = (p.where(F.col("prefix_len") < _BITS)
             .select(F.explode(F.sequence(_block("net"), _block(F.col("after") - 1))).alias("block"), found.alias("deepest"))
             .groupBy("block").agg(F.max_by("deepest", "deepest.prefix_len").alias("deepest")))
    inner = p.where(F.col("prefix_len") >= _BITS).withColumn("block", _block("net"))
    two = F.array(F.struct(F.col("net").alias("pos"), F.col("prefix_len").alias("begins")),
                  F.struct(F.col("after").alias("pos"), F.lit(None).cast("int").alias("begins")))
    places = inner.select("block", "attr", "prefix_len", "after", F.explode(two).alias("c")).where(
        _block("c.pos") == F.col("block")).select("block", "c.pos", "c.begins", "attr", "prefix_len", "after")
    first = outer.select("block", F.shiftleft("block", _BITS).alias("pos"), F.lit(-1).alias("begins"), "deepest.attr",
                         "deepest.prefix_len", F.lit(None).cast("bigint").alias("after"))
    # all rows of one place see the same rows: the frame is by value
    w = Window.partitionBy("block").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def last_begun(length: int) -> Column:
        return F.last(F.when(F.col("begins") == length, F.struct("after", "attr", "prefix_len")), ignorenulls=True).over(w)

    deepest = []
    for length in reversed([x for x in lengths if x >= _BITS]):
        begun = last_begun(length)
        deepest.append(F.when(begun["after"] > F.col("pos"), F.struct(begun["attr"].alias("attr"),
                                                                       begun["prefix_len"].alias("prefix_len"))))
    whole = last_begun(-1)
    deepest.append(F.when(whole.isNotNull(), F.struct(whole["attr"].alias("attr"), whole["prefix_len"].alias("prefix_len"))))
    return (places.unionByName(first).select("block", "pos", F.coalesce(*deepest).alias("deepest"))
            .dropDuplicates(["block", "pos"]))


def as_of(points: DataFrame, ip_col: str, segments: DataFrame, value_col: str, max_rows: int = 1_000_000) -> DataFrame:
    """``points`` with ``value_col`` of the last segment (block, pos) of their block that begins at or before them.

    ``points`` have addresses of IPv4, none null.
    """
    at = F.col(ip_col).cast("bigint")
    names = points.columns
    counts = points.groupBy(_block(at).alias("_block")).agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536 rows
    salts = F.broadcast(counts.select("_block", F.ceil(F.col("_n") / max_rows).cast("bigint").alias("_salts")))
    dealt = (points.withColumns({"_block": _block(at), "_pos": at}).join(salts, "_block")
             .withColumn("_salt", F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(*names), F.col("_salts"))).otherwise(0))
             .select(*names, "_block", "_salt", "_pos", F.lit(1).alias("_is_point"),
                     F.lit(None).cast(segments.schema[value_col].dataType).alias("_value")))
    copies = (segments.join(salts, segments["block"] == F.col("_block"))
              .select("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)).alias("_salt"),
                      F.col("pos").alias("_pos"), F.lit(0).alias("_is_point"), F.col(value_col).alias("_value")))
    w = (Window.partitionBy("_block", "_salt").orderBy("_pos", "_is_point")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a segment's value may be null (a gap), so it is wrapped before nulls are skipped
    last = F.last(F.when(F.col("_is_point") == 0, F.struct(F.col("_value").alias("v"))), ignorenulls=True).over(w)
    return (dealt.unionByName(copies, allowMissingColumns=True).withColumn("_last", last).where("_is_point = 1")
            .select(*names, F.col("_last.v").alias(value_col)))


def deepest_prefix(points: DataFrame, ip_col: str, prefixes: DataFrame, attr_col: str = "attr",
                   len_col: str = "prefix_len", max_rows: int = 1_000_000) -> DataFrame:
    """Attribute and length of the longest prefix containing each address, null when none.

    The rows of ``policy.most_specific_prefix``, by one as-of lookup in place of a join per length.
    """
    names = points.columns
    known = F.coalesce(F.col(ip_col).cast("bigint").between(0, (1 << 32) - 1), F.lit(False))
    segments = prefix_segments(prefixes)
    found = as_of(points.where(known), ip_col, segments, "deepest", max_rows)
    others = points.where(~known).withColumn("deepest", F.lit(None).cast(segments.schema["deepest"].dataType))
    return found.unionByName(others).select(*names, F.col("deepest.attr").alias(attr_col),
                                            F.col("deepest.prefix_len").alias(len_col))
