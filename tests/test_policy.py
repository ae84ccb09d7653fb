from pyspark.sql import functions as F

from fleetspark.functions.ip import ip_to_num, parse_cidr
from fleetspark.operators.policy import _range_blocks, first_match, most_specific_prefix, range_membership
from fleetspark.plans.q_policy import policies_frame, rules_frame
from tests.conftest import rows

FLOW_SCHEMA = ("flow_id bigint, chain string, iface string, proto string, src bigint, dst bigint, dport int, "
               "state string, tcp_flags string, syn boolean")
LOCALHOST = 2130706433
HOST = 2886729729


def trap_flows(spark):
    return spark.createDataFrame([
        (1, "INPUT", "eth1", "tcp", HOST, HOST, 9999, "NEW", "ACK", False),   # head-inserted eth1 accept
        (2, "INPUT", "eth0", "tcp", HOST, HOST, 80, "NEW", "SYN", True),      # nothing matches -> policy
        (3, "INPUT", "eth0", "tcp", HOST, HOST, 22, "NEW", "SYN", True),      # ssh
        (4, "INPUT", "lo", "tcp", HOST, LOCALHOST, 80, "NEW", "SYN", True),   # loopback
        (5, "INPUT", "eth0", "tcp", HOST, LOCALHOST, 80, "NEW", "SYN", True), # 127/8 not on lo
    ], FLOW_SCHEMA)


EXPECTED = [(1, "ACCEPT"), (2, "DROP"), (3, "ACCEPT"), (4, "ACCEPT"), (5, "REJECT")]


def test_first_match_all_plans_agree(spark):
    f, r, p = trap_flows(spark), rules_frame(spark), policies_frame(spark)
    assert rows(first_match(f, r, p, strategy="inline"), "flow_id", "verdict") == EXPECTED
    assert rows(first_match(f, r, p, strategy="join"), "flow_id", "verdict") == EXPECTED
    shuffled = first_match(f, r, p, strategy="join", max_broadcast_rows=0)
    assert rows(shuffled, "flow_id", "verdict") == EXPECTED
    # repeated flow ids keep a row each, in either plan
    for how in ("inline", "join"):
        assert rows(first_match(f.unionByName(f), r, p, strategy=how), "flow_id", "verdict") == sorted(EXPECTED * 2)
    # the head-inserted rule is rank 1
    assert first_match(f, r, p, strategy="inline").where("flow_id = 1").first()["rule_rank"] == 1


def test_range_blocks_cover_a_range_once(spark):
    ranges = [(0, 0), (5, 5), (0, 15), (1, 16), (3, 300), (15, 16), (16, 31), (2886729728, 2886729728 + 65535),
              (2130706432, 2147483647), (0, (1 << 32) - 1), (7, 6), (123456, 9876543)]
    df = spark.createDataFrame(ranges, "lo bigint, hi bigint")
    got = df.select("lo", "hi", F.when(F.col("lo") <= F.col("hi"), _range_blocks(F.col("lo"), F.col("hi"))).alias("b")).collect()
    for r in got:
        spans = sorted((x["blk"] << x["lv"], (x["blk"] + 1) << x["lv"]) for x in r["b"] or [])
        if r["lo"] > r["hi"]:
            assert spans == []
            continue
        assert spans[0][0] == r["lo"] and spans[-1][1] == r["hi"] + 1
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_many_rules_one_answer(spark):
    """300 rules, some without a chain or rank and some that share a rank: the keyed joins equal the CASE."""
    r = spark.range(300).select(
        F.when(F.col("id") % 50 != 7, "INPUT").alias("chain"), F.when(F.col("id") % 60 != 9, (F.col("id") / 2).cast("int")).alias("rank"),
        F.when(F.col("id") % 3 == 0, "eth0").alias("iface"), F.when(F.col("id") % 2 == 0, "tcp").alias("proto"),
        F.when(F.col("id") % 5 < 2, F.col("id") * 7).alias("dst_lo"), F.when(F.col("id") % 5 < 2, F.col("id") * 7 + F.col("id") % 90).alias("dst_hi"),
        F.when(F.col("id") % 5 >= 1, (F.col("id") * 3 % 200).cast("int")).alias("dport"),
        F.when(F.col("id") % 4 == 0, F.array(F.lit("NEW"), F.lit("NEW"))).alias("state"), F.lit(None).cast("string").alias("tcp_flags"),
        F.lit(None).cast("boolean").alias("syn"), F.concat(F.lit("v"), F.col("id") % 9).alias("verdict"))
    f = spark.range(4000).select(
        (F.col("id") % 3000).alias("flow_id"), F.when(F.col("id") % 31 != 0, "INPUT").alias("chain"), F.lit("eth0").alias("iface"),
        F.when(F.col("id") % 3 == 0, "udp").otherwise("tcp").alias("proto"), (F.col("id") * 13 % 2300).alias("dst"),
        (F.col("id") % 211).cast("int").alias("dport"), F.when(F.col("id") % 2 == 0, "NEW").alias("state"),
        F.lit("ACK").alias("tcp_flags"), F.lit(False).alias("syn"))
    p = spark.createDataFrame([("INPUT", "DROP"), ("INPUT", "ACCEPT")], "chain string, verdict string")
    want = rows(first_match(f, r, p, strategy="inline", max_inline=300), "flow_id", "dst", "verdict", "rule_rank")
    assert len(want) == 4000 and sum(1 for w in want if w[3] is not None) > 500
    for bound in (0, 2_000_000):
        assert rows(first_match(f, r, p, max_broadcast_rows=bound), "flow_id", "dst", "verdict", "rule_rank") == want


def test_rule_after_first_match_changes_nothing(spark):
    f, r, p = trap_flows(spark), rules_frame(spark), policies_frame(spark)
    before = {k: v for k, v, rk in rows(first_match(f, r, p), "flow_id", "verdict", "rule_rank") if rk is not None}
    fixed = {"chain": F.lit("INPUT"), "rank": F.lit(100), "verdict": F.lit("REJECT")}
    extra = r.limit(1).select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in r.schema])
    after = {k: v for k, v in rows(first_match(f, r.unionByName(extra), p), "flow_id", "verdict")}
    assert all(after[k] == v for k, v in before.items())
    assert after[2] == "REJECT"  # only the flow that fell through is affected


def test_range_membership_both_ends(spark):
    pools = spark.createDataFrame([("pool", "192.168.200.51", "192.168.200.90")], "network string, a string, b string")
    pools = pools.select("network", ip_to_num("a").alias("lo"), ip_to_num("b").alias("hi"))
    pts = spark.createDataFrame([("192.168.200.51",), ("192.168.200.90",), ("192.168.200.91",)], "s string")
    pts = pts.select("s", ip_to_num("s").alias("n"))
    out = range_membership(pts, "n", pools)
    assert rows(out, "s", "network") == [("192.168.200.51", "pool"), ("192.168.200.90", "pool"),
                                         ("192.168.200.91", None)]
    # a /8-wide range next to a narrow one, then ranges that overlap, repeat, or are swapped
    wide = pools.unionByName(spark.createDataFrame([("ten", 10 << 24, (11 << 24) - 1)], "network string, lo bigint, hi bigint"))
    pts2 = pts.unionByName(spark.createDataFrame([("10.1.2.3", (10 << 24) + 66051)], "s string, n bigint"))
    got = rows(range_membership(pts2, "n", wide), "s", "network")
    assert ("10.1.2.3", "ten") in got and ("192.168.200.91", None) in got and len(got) == 4


def test_range_membership_matches_brute_force(spark):
    rs = [("all", 0, (1 << 32) - 1), ("a", 10, 300), ("a", 10, 300), ("b", 300, 300), ("c", 17, 4096), ("swapped", 9, 3), (None, 5, 5)]
    ips = [0, 5, 9, 10, 16, 17, 255, 256, 300, 301, 4096, 4097, 1 << 31, (1 << 32) - 1, 1 << 33, 10]
    rdf = spark.createDataFrame([*rs, ("open", None, 4)], "network string, lo bigint, hi bigint")
    pdf = spark.createDataFrame([(i,) for i in [*ips, None]], "ip bigint")
    want = sorted([(i, n) for i in ips for n, lo, hi in rs if lo <= i <= hi] + [(1 << 33, None), (None, None)], key=repr)
    for bound in (0, 3, 1000):
        assert rows(range_membership(pdf, "ip", rdf, max_broadcast_rows=bound), "ip", "network") == want
    assert rows(range_membership(pdf, "ip", rdf.limit(0)), "ip", "network") == sorted([(i, None) for i in [*ips, None]], key=repr)


def test_most_specific_prefix(spark):
    pf = spark.createDataFrame([(parse_cidr("172.16.0.0/16")[0], 16, "campus"),
                                (parse_cidr("172.16.1.0/24")[0], 24, "lab")], "net bigint, prefix_len int, attr string")
    pts = spark.createDataFrame([(1, "172.16.1.5"), (2, "172.16.2.5"), (3, "10.0.0.1")], "id int, s string")
    pts = pts.select("id", ip_to_num("s").alias("n"))
    expect = [(1, "lab", 24), (2, "campus", 16), (3, None, None)]
    assert rows(most_specific_prefix(pts, "n", pf), "id", "attr", "prefix_len") == expect
    big = most_specific_prefix(pts, "n", pf, id_col="id", max_broadcast_rows=0)
    assert rows(big, "id", "attr", "prefix_len") == expect
    # mixed: the /16 slice (1 row) is broadcast, the /24 slice (2 rows) goes through the shuffle path
    pf2 = pf.unionByName(spark.createDataFrame([(parse_cidr("172.16.3.0/24")[0], 24, "lab2")],
                                               "net bigint, prefix_len int, attr string"))
    mixed = most_specific_prefix(pts, "n", pf2, id_col="id", max_broadcast_rows=1)
    assert rows(mixed, "id", "attr", "prefix_len") == expect
