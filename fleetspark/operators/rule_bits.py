"""First match by rule bit vectors (P11 for rule lists of any length).

Rules are dealt into *groups* by chain, destination and port: a destination range is cut into aligned address blocks
(``policy._range_blocks``), so a rule is in the group of each of its blocks, or of "anywhere", with its port or "any".
Inside a group rules that ask for the same interface, protocol, states, flags and syn keep the first in rank, since
the others can never be met first.  What is left is numbered in rank order, and every dimension has a table from a value to
the *bit vector* of the rules that this value satisfies or that do not ask for the dimension, as an array of words; a value in
no rule has the dimension's default vector.  A flow joins one group per block size, with its port and with any, whatever
combinations of columns the rules use: the lowest bit set in the AND of a group's vectors is its rule there, and the lowest
rank over the groups decides.

A vector is as long as its group, not as the list: groups over ``slice_rules`` rules are cut into slices in rank order,
each with vectors and a join of its own, so no row grows with the list.  Groups are built by shuffles and written
once.  The smallest sides are broadcast while their computed size stays within ``broadcast_bytes``; the
others are shuffle joins, which AQE splits where a block is hot.  No flow multiplies and none needs an identity, so it also
serves streams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.operators.policy import _broadcastable, _range_blocks, _with_policy
from fleetspark.operators.ranking import row_number_within
from fleetspark.operators.sizing import DEFAULT_BROADCAST_ROWS, write_once

BITS = 62  # per word: words stay positive, so lowest-bit arithmetic cannot overflow
SLICE_RULES = 16 * BITS
_ANYWHERE = -1  # the block size of a rule without destination
_EQUAL = ("iface", "proto", "tcp_flags", "syn")
_GROUP = ["chain", "lv", "blk", "port"]


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (number % BITS).cast("int"))


def _grouped(rules: DataFrame) -> DataFrame:
    """(chain, lv, blk, port, iface, proto, tcp_flags, syn, states, hit): the first rule of each group and combination."""
    lo, hi = F.col("dst_lo").cast("bigint"), F.col("dst_hi").cast("bigint")
    anywhere = F.array(F.struct(F.lit(_ANYWHERE).alias("lv"), F.lit(0).cast("bigint").alias("blk")))
    dst = F.when(lo.isNull(), anywhere).when(lo <= hi, _range_blocks(lo, hi))
    states = F.array_sort(F.filter(F.array_distinct("state"), lambda x: x.isNotNull()))
    each = rules.where(F.col("chain").isNotNull() & F.col("rank").isNotNull()).select(
        F.col("chain").cast("string").alias("chain"), F.col("dport").cast("string").alias("port"),
        *[F.col(c).cast("string").alias(c) for c in _EQUAL], states.alias("states"),
        F.struct(F.col("rank").cast("int").alias("rank"), F.col("verdict").cast("string").alias("verdict")).alias("hit"),
        F.explode(dst).alias("_d"))
    return each.where("states IS NULL OR size(states) > 0").select("*", "_d.lv", "_d.blk").groupBy(
        *_GROUP, *_EQUAL, "states").agg(F.min("hit").alias("hit"))


def _vectors(grouped: DataFrame, slice_rules: int) -> DataFrame:
    """(chain, lv, blk, port, slice, hits, and per dimension its vectors by value and its default): one row per slice of a group."""
    # the combination is part of the order, so reruns number alike
    numbered = row_number_within(grouped, _GROUP, ["hit", *_EQUAL, "states"], "_n")
    at = F.col("_n") - 1
    lists = numbered.select(
        *_GROUP, F.floor(at / slice_rules).cast("int").alias("slice"),
        F.struct(F.col("_n"), "hit", *_EQUAL, "states").alias("r")).groupBy(*_GROUP, "slice").agg(
        F.array_sort(F.collect_list("r")).alias("rs"))
    words = F.sequence(F.lit(0), F.floor((F.size("rs") - 1) / BITS).cast("int"))

    def vector(met) -> Column:
        """The words of the rules that ``met`` holds for."""
        return F.transform(words, lambda w: F.aggregate(
            F.transform(F.slice("rs", w * BITS + 1, F.lit(BITS)), lambda r, i: F.when(met(r), _bit(i)).otherwise(F.lit(0).cast("bigint"))),
            F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)))

    def by_value(values: Column, met) -> Column:
        return F.map_from_entries(F.transform(values, lambda v: F.struct(v, vector(lambda r: met(r, v)))))

    columns = []
    for c in _EQUAL:
        values = F.array_distinct(F.filter(F.transform("rs", lambda r: r[c]), lambda v: v.isNotNull()))
        columns += [by_value(values, lambda r, v: r[c].isNull() | (r[c] == v)).alias(f"m_{c}"),
                    vector(lambda r: r[c].isNull()).alias(f"d_{c}")]
    states = F.array_distinct(F.flatten(F.filter(F.transform("rs", lambda r: r["states"]), lambda s: s.isNotNull())))
    columns += [by_value(states, lambda r, v: r["states"].isNull() | F.array_contains(r["states"], v)).alias("m_state"),
                vector(lambda r: r["states"].isNull()).alias("d_state")]
    return lists.select(*_GROUP, "slice", F.transform("rs", lambda r: r["hit"]).alias("hits"), *columns)


def _row_bytes() -> Column:
    """About the bytes of a row of ``_vectors``."""
    values = sum((F.size(f"m_{c}") for c in (*_EQUAL, "state")), F.lit(len(_EQUAL) + 1))
    return (values * (F.size("d_state") * 8 + 32) + F.size("hits") * 40 + 200).cast("bigint")


def first_match_bits(flows: DataFrame, rules: DataFrame, policies: DataFrame, max_rules: int | None = None,
                     max_bytes: int | None = None, slice_rules: int = SLICE_RULES,
                     broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``verdict`` and ``rule_rank`` of every flow, as ``policy.first_match`` gives them.

    A null field of a flow meets only rules that do not ask for it; a destination range with swapped ends, or
    an empty list of states, is met by no flow; a rule without chain or rank matches nothing; of two rules
    with one rank the smaller verdict counts; with no rule at all the policies decide.  Lists of any length are taken;
    a caller who wants none beyond ``max_rules`` rules or ``max_bytes`` of vectors gets ``ValueError`` there.
    """
    if max_rules is not None and rules.where("chain IS NOT NULL AND rank IS NOT NULL").count() > max_rules:
        raise ValueError(f"more than {max_rules} rules; use first_match(strategy='join')")
    grouped = write_once(_grouped(rules), "grouped-rules")
    vectors = write_once(_vectors(grouped, slice_rules), "rule-vectors")
    # a row per block size, with and without port, and slice
    sizes = {(r["lv"], r["ported"], r["slice"]): r["b"] for r in vectors.groupBy(
        "lv", F.col("port").isNotNull().alias("ported"), "slice").agg(F.sum(_row_bytes()).alias("b")).collect()}
    if max_bytes is not None and sum(sizes.values()) > max_bytes:
        raise ValueError(f"vectors of more than {max_bytes} bytes; use first_match(strategy='join')")

    small, out = _broadcastable(sizes, broadcast_bytes), flows.withColumn("_best", F.lit(None).cast("struct<rank:int,verdict:string>"))
    for lv, ported, part in sorted(sizes):
        side = vectors.where((F.col("lv") == lv) & (F.col("port").isNotNull() == F.lit(ported)) & (F.col("slice") == part))
        side = side.drop("lv", "slice")
        side = side.withColumnsRenamed({c: f"_g_{c}" for c in side.columns})
        same = F.col("chain").cast("string") == F.col("_g_chain")
        if lv != _ANYWHERE:
            same = same & (F.shiftright(F.col("dst").cast("bigint"), lv) == F.col("_g_blk"))
        if ported:
            same = same & (F.col("dport").cast("string") == F.col("_g_port"))
        each = [F.coalesce(F.try_element_at(f"_g_m_{c}", F.col(c).cast("string")), F.col(f"_g_d_{c}")) for c in (*_EQUAL, "state")]
        met = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), each)
        lowest = F.array_min(F.transform(met, lambda w, i: F.when(
            w != 0, i * BITS + F.bit_count(F.bitwise_not(w).bitwiseAND(w - 1)))))
        out = out.join(F.broadcast(side) if (lv, ported, part) in small else side, same, "left")
        out = out.withColumn("_best", F.least("_best", F.get("_g_hits", lowest))).drop(*side.columns)
    out = _with_policy(out, policies, 64, DEFAULT_BROADCAST_ROWS)
    return (out.withColumn("verdict", F.coalesce("_best.verdict", "_policy")).withColumn("rule_rank", F.col("_best.rank"))
            .drop("_best", "_policy"))
