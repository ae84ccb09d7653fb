"""Graph patterns over ``triples`` (J2-J4), group expansion (G1), group sizes
(A1), ordered member lists (A2), host tables (U1), address conflicts (J8) and
cluster / link fan-out sizes (J5, J6 re-aimed).

Scale notes
* A basic graph pattern is a fold of inner equi-joins on the shared variables
  *and* ``request_id``, with a semi join for each pattern that binds nothing new; constant terms become filters that reach the scan.  A
  disconnected pattern is rejected instead of becoming a cross join.  Hot join
  values (one domain shared by every node) are split by AQE's skew join.
* J5 / J6 ask for every pair of hosts in a cluster / on a link, which grows with
  the square of the group.  We never emit those pairs: the operators return
  the group sizes and pair counts by aggregation.
* J8 finds addresses claimed by more than one owner by a ``groupBy`` on
  (request, address), so no self-join is planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.ip import ip_to_num, num_to_ip, octets_to_num
from fleetspark.functions.ranges import number_range
from fleetspark.operators.ranking import row_number_within

Pattern = tuple[str, str, str]


def _is_var(term: str) -> bool:
    return isinstance(term, str) and term.startswith("?")


def _pattern_frame(triples: DataFrame, pat: Pattern, request_col: str) -> DataFrame:
    df = triples
    seen: dict[str, str] = {}
    for pos, term in zip(("subject", "predicate", "object"), pat):
        if _is_var(term):
            if term in seen:  # same variable twice in one pattern
                df = df.where(F.col(pos) == F.col(seen[term]))
            else:
                seen[term] = pos
        else:
            df = df.where(F.col(pos) == F.lit(term))
    return df.select(F.col(request_col), *[F.col(pos).alias(v[1:]) for v, pos in seen.items()])


def match_patterns(triples: DataFrame, patterns: Sequence[Pattern], optional: Sequence[Pattern] = (),
                   request_col: str = "request_id") -> DataFrame:
    """Solutions of a basic graph pattern (J3), with optional patterns as left joins.

    Variables are ``?name`` terms; each becomes a column.  Every join also keys
    on ``request_id`` (graphs are per request).
    """
    if not patterns:
        raise ValueError("need at least one pattern")
    # start from a pattern that binds two variables, if there is one
    first = max(patterns, key=lambda p: len(set(filter(_is_var, p))))
    pending = list(patterns)
    pending.remove(first)
    out = _pattern_frame(triples, first, request_col)
    while pending:
        frames = [(pat, _pattern_frame(triples, pat, request_col)) for pat in pending]
        bound = [(pat, nxt) for pat, nxt in frames if set(nxt.columns) <= set(out.columns)]
        linked = [(pat, nxt) for pat, nxt in frames if set(nxt.columns) & set(out.columns) - {request_col}]
        if not linked:
            raise ValueError(f"patterns {pending} share no variable with the rest (would be a cross join)")
        # a pattern that binds nothing new only filters: as soon as it can, as a semi join
        pat, nxt = (bound or linked)[0]
        shared = [request_col, *[c for c in nxt.columns if c in out.columns and c != request_col]]
        out = out.join(nxt, shared, "left_semi" if bound else "inner")
        pending.remove(pat)
    for pat in optional:
        nxt = _pattern_frame(triples, pat, request_col)
        shared = [c for c in nxt.columns if c in out.columns and c != request_col]
        if not shared:
            raise ValueError(f"optional pattern {pat} shares no variable")
        out = out.join(nxt, [request_col, *shared], "left")
    return out


NODE_IP_PATTERNS: list[Pattern] = [
    ("?node", "type", "Node"),
    ("?node", "hasInterface", "?iface"),
    ("?link", "hasInterface", "?iface"),
    ("?link", "type", "BroadcastConnection"),
    ("?iface", "localIPAddress", "?addr"),
    ("?addr", "label_ID", "?ip"),
]


def node_link_ips(triples: DataFrame, request_col: str = "request_id") -> DataFrame:
    """``$Node.IP("Link")`` for every node and link (J2): one address per (node, link)."""
    m = match_patterns(triples, NODE_IP_PATTERNS, request_col=request_col)
    return m.withColumn("_parts", F.split("ip", r"\.")).select(request_col, "node", "link", "ip", octets_to_num("_parts").alias("ip_num"))


def expand_groups(groups: DataFrame, group_col: str, count_col: str, base_ip_col: str,
                  idx_col: str = "member_idx", member_col: str = "member", stride: int = 1) -> DataFrame:
    """``#foreach ($j in [0..$size-1])``: one row per member with its index and
    address base + index * stride (G1, G3).  Contiguous addresses
    (``stride=1``) are an inference from the requests, so it is a parameter."""
    n = F.col(count_col).cast("int")
    return (groups.withColumn(idx_col, F.explode(number_range(0, n - 1)))
            .withColumn(member_col, F.concat(F.col(group_col), F.lit("/"), F.col(idx_col).cast("string")))
            .withColumn("ip_num", ip_to_num(base_ip_col) + F.col(idx_col) * F.lit(stride))
            .withColumn("ip", num_to_ip("ip_num")))


def group_sizes(singles: DataFrame, groups: DataFrame, request_col: str = "request_id",
                count_col: str = "num_ce") -> DataFrame:
    """Machines per request = singles + sum of group sizes (A1)."""
    s = singles.groupBy(request_col).agg(F.count(F.lit(1)).alias("n_single"))
    g = groups.groupBy(request_col).agg(F.sum(F.col(count_col).cast("bigint")).alias("n_group_members"))
    out = s.join(g, request_col, "full")
    return out.select(request_col, F.coalesce("n_single", F.lit(0)).alias("n_single"),
                      F.coalesce("n_group_members", F.lit(0)).alias("n_group_members"),
                      (F.coalesce("n_single", F.lit(0)) + F.coalesce("n_group_members", F.lit(0))).alias("n_machines"))


def ordered_list(df: DataFrame, group_cols: Sequence[str], value: Column, order: Column,
                 sep: str = ",", out_col: str = "members") -> DataFrame:
    """``CLUSTER=a=…,b=…``: values joined in a fixed order per group (A2).

    The output is one string per group, so its size is the group's; this is
    meant for cluster member lists (a handful of brokers / peers)."""
    d = df.select(*group_cols, value.alias("_v"), order.alias("_o"))
    return d.groupBy(*group_cols).agg(
        F.expr(f"listagg(_v, '{sep}') WITHIN GROUP (ORDER BY _o, _v)").alias(out_col))


def ordered_list_pages(df: DataFrame, group_cols: Sequence[str], value: Column, order: Sequence[Column],
                       page_size: int, sep: str = ",", out_col: str = "members", page_col: str = "page") -> DataFrame:
    """``ordered_list`` for groups of any size (A2): pages of ``page_size`` members, numbered from 0, so no
    string grows with its group.  ``order`` must be total within a group; a null value is skipped."""
    d = df.select(*group_cols, value.alias("_v"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    numbered = row_number_within(d, group_cols, [f"_o{i}" for i in range(len(order))], "_rn")
    paged = numbered.withColumn(page_col, F.floor((F.col("_rn") - 1) / F.lit(page_size)).cast("bigint"))
    return paged.groupBy(*group_cols, page_col).agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("_rn", "_v"))), lambda x: x["_v"]), sep).alias(out_col))


def host_table(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``>> /etc/hosts`` from several sources, duplicates kept.

    Each part has (request_id, ip, hostname); the part name goes to ``source``."""
    out = None
    for name, df in parts:
        d = df.select("request_id", "ip", "hostname").withColumn("source", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def address_conflicts(owners: DataFrame, request_col: str = "request_id", ip_col: str = "ip_num",
                      owner_col: str = "owner") -> DataFrame:
    """Addresses claimed by two or more owners inside a request."""
    d = owners.select(request_col, ip_col, owner_col).distinct()
    g = d.groupBy(request_col, ip_col).agg(
        F.count(F.lit(1)).alias("n_owners"), F.min(owner_col).alias("first_owner"),
        F.max(owner_col).alias("last_owner"))
    return g.where(F.col("n_owners") >= 2).withColumn("ip", num_to_ip(ip_col))


def fanout_sizes(members: DataFrame, group_cols: Sequence[str], member_col: str,
                 include_self: bool) -> DataFrame:
    """Size of the all-pairs fan-out of each group, without emitting the pairs.

    ``include_self=True``: every member with every member, itself included
    (n*n, J5 full mesh).  ``False``: unordered pairs of distinct members
    (n*(n-1)/2, J6 hosts sharing a link)."""
    g = members.select(*group_cols, member_col).distinct().groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_hosts"))
    n = F.col("n_hosts")
    pairs = n * n if include_self else (n * (n - 1)) / 2
    return g.withColumn("n_pairs", pairs.cast("bigint"))
