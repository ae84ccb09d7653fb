"""Policy evaluation: ordered first-match rules (P11), most specific prefix (J7),
CIDR / range membership (P9, P10).

Scale notes
* P11: a short rule list (``max_inline``) is folded into one CASE over the flow
  columns that finds the rule's place (verdict and rank are looked up there): no
  join, no shuffle, one pass.  A longer list is joined by key: rules that fix the
  same columns form one *shape*, a destination range is cut into aligned address
  blocks, and each shape keeps the lowest rank per key, so it is one left equality
  join that never multiplies a flow; the lowest rank over the shapes decides.  No
  window, no flow identity; both plans serve streams and give the same rows.
* J7: one left equality join per distinct prefix length (at most 33 for IPv4)
  on the masked address.  The smallest slices are broadcast while their sum is
  within the bound, and then the big side does not shuffle; larger slices are
  shuffle joins.  No row multiplies, so no window follows.
* P10: ranges are cut into aligned blocks, one left equality join per block size,
  so no nested-loop join is planned on the big side and a wide range costs no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.ip import network_key
from fleetspark.operators.ranking import row_number_within
from fleetspark.operators.sizing import DEFAULT_BROADCAST_ROWS, broadcast_if_small, collect_bounded


def _broadcastable(sizes: dict, max_rows: int) -> set:
    """The keys of the smallest sides that stay within ``max_rows`` rows all together."""
    room, small = max_rows, set()
    for at in sorted(sizes, key=lambda x: (sizes[x], str(x))):
        room -= sizes[at]
        if room >= 0:
            small.add(at)
    return small


# --------------------------------------------------------------------------- P11
def rank_rules(commands: DataFrame) -> DataFrame:
    """Resolve ``-A`` (append) / ``-I`` (insert at head) commands into ranks.

    ``commands`` has ``chain, seq, op`` plus the match columns; a later ``-I``
    goes before every earlier rule, a later ``-A`` after them.  A long chain is numbered
    in range partitions (``ranking``), not in one task.
    """
    key = F.when(F.upper(F.col("op")).isin("I", "-I", "INSERT"), -F.col("seq")).otherwise(F.col("seq"))
    ranked = row_number_within(commands.withColumn("_place", key), ["chain"], ["_place"], "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("op", "seq", "_place")


def _rule_condition_row(r: dict) -> Column:
    cond = F.col("chain") == F.lit(r["chain"])
    if r.get("iface") is not None:
        cond = cond & (F.col("iface") == F.lit(r["iface"]))
    if r.get("proto") is not None:
        cond = cond & (F.col("proto") == F.lit(r["proto"]))
    if r.get("dst_lo") is not None:
        cond = cond & F.col("dst").between(F.lit(r["dst_lo"]), F.lit(r["dst_hi"]))
    if r.get("dport") is not None:
        cond = cond & (F.col("dport") == F.lit(r["dport"]))
    if r.get("state") is not None:
        cond = cond & F.col("state").isin(list(r["state"]))
    if r.get("tcp_flags") is not None:
        cond = cond & (F.col("tcp_flags") == F.lit(r["tcp_flags"]))
    if r.get("syn") is not None:
        cond = cond & (F.col("syn") == F.lit(bool(r["syn"])))
    return F.coalesce(cond, F.lit(False))


# Aligned blocks of 2^0, 2^4, ... 2^60 addresses cover a destination range; few levels
# keep the number of joins small, and a range has at most 30 blocks of a level.
_LEVEL_STEP, _LEVELS = 4, 16
_KEY_COLUMNS = ("iface", "proto", "dport", "state", "tcp_flags", "syn")


def _range_blocks(lo: Column, hi: Column) -> Column:
    """The aligned blocks (``lv``, ``blk`` = address >> lv) that make up [lo, hi]: of each
    size those inside the range whose next larger block is not."""
    def of_level(lv: int) -> Column:
        first = F.shiftright(lo + F.lit((1 << lv) - 1), lv)
        last = F.shiftright(hi + F.lit(1), lv) - F.lit(1)
        if lv == _LEVEL_STEP * (_LEVELS - 1):
            blocks = F.when(first <= last, F.sequence(first, last))
        else:
            up = lv + _LEVEL_STEP
            # the larger blocks inside the range take [left, right) of this level
            left = F.shiftleft(F.shiftright(lo + F.lit((1 << up) - 1), up), _LEVEL_STEP)
            right = F.shiftleft(F.shiftright(hi + F.lit(1), up), _LEVEL_STEP)
            blocks = F.when(left >= right, F.when(first <= last, F.sequence(first, last))).otherwise(F.concat(
                F.when(first < left, F.sequence(first, left - 1)).otherwise(F.array().cast("array<bigint>")),
                F.when(right <= last, F.sequence(right, last)).otherwise(F.array().cast("array<bigint>"))))
        return F.transform(F.coalesce(blocks, F.array().cast("array<bigint>")),
                           lambda x: F.struct(F.lit(lv).alias("lv"), x.alias("blk")))

    return F.concat(*[of_level(_LEVEL_STEP * i) for i in range(_LEVELS)])


def _keyed_rules(rules: DataFrame) -> DataFrame:
    """Rules as rows of plain equality keys: ``shape`` (fixed columns), ``lv`` / ``blk`` (destination), columns."""
    r = rules.where(F.col("chain").isNotNull() & F.col("rank").isNotNull())
    anywhere = F.array(F.struct(F.lit(None).cast("int").alias("lv"), F.lit(None).cast("bigint").alias("blk")))
    lo, hi = F.col("dst_lo").cast("bigint"), F.col("dst_hi").cast("bigint")
    dst = F.when(lo.isNull(), anywhere).when(lo <= hi, _range_blocks(lo, hi))
    states = F.when(F.col("state").isNull(), F.array(F.lit(None).cast("string"))).otherwise(
        F.filter(F.array_distinct("state"), lambda x: x.isNotNull()))
    shape = F.concat(*[F.when(F.col(c).isNotNull(), F.lit("1")).otherwise(F.lit("0")) for c in _KEY_COLUMNS])
    r = r.select("chain", "rank", "verdict", "iface", "proto", "dport", "tcp_flags", "syn", shape.alias("shape"),
                 states.alias("_states"), F.explode(dst).alias("_d"))
    return r.select("chain", "rank", "verdict", "iface", "proto", "dport", "tcp_flags", "syn", "shape", "_d.lv", "_d.blk",
                    F.explode("_states").alias("state"))


def _first_match_joined(flows: DataFrame, rules: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """Add ``_hit`` = (rank, verdict) of the first matching rule by one left equality join per shape."""
    keyed = _keyed_rules(rules).groupBy("shape", "lv", "chain", "blk", *_KEY_COLUMNS).agg(
        F.min(F.struct("rank", "verdict")).alias("hit"))
    sizes = {(x["shape"], x["lv"]): x["count"] for x in collect_bounded(
        keyed.groupBy("shape", "lv").count(), 2 ** len(_KEY_COLUMNS) * (_LEVELS + 1), "rule shapes")}
    small, out, hits = _broadcastable(sizes, max_broadcast_rows), flows, []
    for i, (shape, lv) in enumerate(sorted(sizes, key=lambda x: (x[0], x[1] if x[1] is not None else -1))):
        fixed = ["chain", *[c for c, bit in zip(_KEY_COLUMNS, shape) if bit == "1"]]
        of_level = F.col("lv").isNull() if lv is None else F.col("lv") == lv
        side = keyed.where((F.col("shape") == shape) & of_level).select(
            *[F.col(c).alias(f"_k{i}_{c}") for c in fixed], F.col("blk").alias(f"_k{i}_blk"), F.col("hit").alias(f"_h{i}"))
        cond = F.lit(True)
        for c in fixed:
            cond = cond & (F.col(c) == F.col(f"_k{i}_{c}"))
        if lv is not None:
            cond = cond & (F.shiftright(F.col("dst").cast("bigint"), lv) == F.col(f"_k{i}_blk"))
        out = out.join(F.broadcast(side) if (shape, lv) in small else side, cond, "left")
        out = out.drop(*[f"_k{i}_{c}" for c in fixed], f"_k{i}_blk")
        hits.append(F.col(f"_h{i}"))
    first = F.least(*hits) if len(hits) > 1 else hits[0] if hits else F.lit(None).cast("struct<rank:int,verdict:string>")
    return out.withColumn("_hit", first).drop(*[f"_h{i}" for i in range(len(hits))])


def _with_policy(flows: DataFrame, policies: DataFrame, max_inline: int, max_broadcast_rows: int) -> DataFrame:
    """Add ``_policy``, the verdict of the flow's chain; of a chain listed twice the one that sorts last."""
    known = policies.where(F.col("chain").isNotNull()).groupBy(F.col("chain").alias("_pc")).agg(F.max("verdict").alias("_policy"))
    got = known.limit(max_inline + 1).collect()
    if len(got) > max_inline:
        side, _ = broadcast_if_small(known, max_broadcast_rows)
        return flows.join(side, F.col("chain") == F.col("_pc"), "left").drop("_pc")
    default = F.lit(None).cast("string")
    for p in got:
        default = F.when(F.col("chain") == p["_pc"], F.lit(p["_policy"])).otherwise(default)
    return flows.withColumn("_policy", default)


def first_match(flows: DataFrame, rules: DataFrame, policies: DataFrame, strategy: str = "auto",
                max_inline: int = 64, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Verdict of the first matching rule in rank order, else the chain policy.

    ``rules``: chain, rank, iface, proto, dst_lo, dst_hi, dport, state ARRAY,
    tcp_flags, syn, verdict (null = any).  ``policies``: chain, verdict.
    Adds ``verdict`` and ``rule_rank`` (null when the policy decided).  Every flow row
    gets one output row in either plan, whatever its id; a rule without a chain or
    rank matches nothing, and of two rules with one rank the smaller verdict counts.
    ``strategy``: ``inline`` (one CASE), ``join`` (keyed joins), or by the list's length.
    """
    got = [] if strategy == "join" else rules.limit(max_inline + 1).collect()
    if strategy == "inline" and len(got) > max_inline:
        raise ValueError("rule list too large to inline; use strategy='join'")
    if strategy == "join" or len(got) > max_inline:
        out = _with_policy(_first_match_joined(flows, rules, max_broadcast_rows), policies, max_inline, max_broadcast_rows)
        return (out.withColumn("verdict", F.when(F.col("_hit").isNull(), F.col("_policy")).otherwise(
                    F.coalesce(F.col("_hit.verdict"), F.col("_policy"))))
                .withColumn("rule_rank", F.col("_hit.rank").cast("int")).drop("_hit", "_policy"))
    rs = sorted((r.asDict() for r in got if r["chain"] is not None and r["rank"] is not None),
                key=lambda r: (r["chain"], r["rank"], r["verdict"] or ""))
    # one CASE finds the rule's place; its verdict and rank are looked up there
    place = F.lit(None).cast("int")
    if rs:
        place = F.when(_rule_condition_row(rs[0]), F.lit(1))
        for i, r in enumerate(rs[1:], 2):
            place = place.when(_rule_condition_row(r), F.lit(i))
    verdicts = F.array(*[F.lit(r["verdict"]).cast("string") for r in rs] or [F.lit(None).cast("string")])
    ranks = F.array(*[F.lit(int(r["rank"])) for r in rs] or [F.lit(None).cast("int")])
    out = _with_policy(flows.withColumn("_place", place), policies, max_inline, max_broadcast_rows)
    return (out.withColumn("verdict", F.coalesce(F.get(verdicts, F.col("_place") - 1), F.col("_policy")))
            .withColumn("rule_rank", F.get(ranks, F.col("_place") - 1)).drop("_place", "_policy"))


# --------------------------------------------------------------------------- J7
def normalize_prefixes(prefixes: DataFrame) -> DataFrame:
    """Mask host bits off ``net`` and keep one attribute per (net, len) (smallest, for determinism).

    Rows whose length is null or not 0 to 32, or whose network is null, cover nothing.
    """
    p = prefixes.where(F.col("prefix_len").between(0, 32) & F.col("net").isNotNull()).select(network_key(F.col("net"), F.col("prefix_len")).alias("net"),
                        F.col("prefix_len").cast("int").alias("prefix_len"), "attr")
    return p.groupBy("net", "prefix_len").agg(F.min("attr").alias("attr"))


def most_specific_prefix(points: DataFrame, ip_col: str, prefixes: DataFrame,
                         id_col: str | None = None, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                         attr_col: str = "attr", len_col: str = "prefix_len") -> DataFrame:
    """Attribute of the longest prefix containing each address; null when none.

    The prefix table is sized per length in one small job (at most 33 rows
    come back), and each length is one left equi-join on the masked address.
    A slice holds a network once, so no row multiplies and no row needs an
    identity (``id_col`` is accepted and not used).  The smallest slices are
    broadcast as long as all of them together stay within
    ``max_broadcast_rows``; the others are shuffle joins on the network, which
    AQE splits where an address is hot.  The same plan serves streams.
    """
    p = normalize_prefixes(prefixes)
    sizes = {int(r[0]): int(r[1]) for r in collect_bounded(
        p.groupBy("prefix_len").count(), 33, "prefix lengths")}
    small = _broadcastable(sizes, max_broadcast_rows)
    out, attrs, lens, drop = points, [], [], []
    for i, length in enumerate(sorted(sizes, reverse=True)):
        side = p.where(F.col("prefix_len") == length).select(F.col("net").alias(f"_n{i}"), F.col("attr").alias(f"_a{i}"))
        out = out.join(F.broadcast(side) if length in small else side,
                       network_key(F.col(ip_col), length) == F.col(f"_n{i}"), "left")
        attrs.append((F.col(f"_n{i}").isNotNull(), F.col(f"_a{i}")))
        lens.append(F.when(F.col(f"_n{i}").isNotNull(), F.lit(length)))
        drop += [f"_n{i}", f"_a{i}"]
    attr = F.lit(None).cast("string")
    for hit, value in reversed(attrs):
        attr = F.when(hit, value).otherwise(attr)
    longest = F.coalesce(*lens) if lens else F.lit(None)
    return out.withColumn(attr_col, attr).withColumn(len_col, longest.cast("int")).drop(*drop)


# --------------------------------------------------------------------------- P10
def range_membership(points: DataFrame, ip_col: str, ranges: DataFrame, name_col: str = "network",
                     lo_col: str = "lo", hi_col: str = "hi",
                     max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Left join of each address to every range containing it, both ends included (P10).

    Each range is cut into its aligned blocks, and each block size present (at most
    ``_LEVELS``) is one left equality join on the address's block, which holds the list of
    ranges around it, so no address multiplies before its ranges are listed, however
    wide or narrow the ranges are.  A range with a null end or its ends swapped contains
    nothing; an address in no range, or null, keeps one row with a null name.
    """
    lo, hi = F.col(lo_col).cast("bigint"), F.col(hi_col).cast("bigint")
    blocks = ranges.where(lo <= hi).select(F.struct(F.col(name_col).alias("name")).alias("r"), F.explode(_range_blocks(lo, hi)).alias("b"))
    blocks = blocks.groupBy("b.lv", "b.blk").agg(F.collect_list("r").alias("rs"))
    sizes = {r["lv"]: r["count"] for r in collect_bounded(blocks.groupBy("lv").count(), _LEVELS, "block sizes")}
    small, out, found = _broadcastable(sizes, max_broadcast_rows), points, []
    for lv in sorted(sizes):
        side = blocks.where(F.col("lv") == lv).select(F.col("blk").alias(f"_b{lv}"), F.col("rs").alias(f"_r{lv}"))
        out = out.join(F.broadcast(side) if lv in small else side,
                       F.shiftright(F.col(ip_col).cast("bigint"), lv) == F.col(f"_b{lv}"), "left").drop(f"_b{lv}")
        found.append(F.coalesce(F.col(f"_r{lv}"), F.array().cast(blocks.schema["rs"].dataType)))
    if not found:
        return out.withColumn(name_col, F.lit(None).cast(ranges.schema[name_col].dataType))
    listed = out.withColumn("_r", F.concat(*found)).drop(*[f"_r{lv}" for lv in sizes])
    return listed.withColumn("_r", F.explode_outer("_r")).withColumn(name_col, F.col("_r.name")).drop("_r")
