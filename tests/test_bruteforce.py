"""Operators whose plans are re-formulated for scale, checked against a direct
Python simulation of the reference semantics on random small inputs."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetspark.functions.text import replace_first
from fleetspark.operators.lines import edit_after_match, to_lines
from fleetspark.operators.policy import first_match, most_specific_prefix
from fleetspark.operators.retention import newest_within_budget
from fleetspark.streaming.deadline import deadline_batch

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
T0 = dt.datetime(2024, 1, 1)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.booleans(), st.integers(0, 900)), min_size=1, max_size=40))
def test_deadline_matches_brute_force(spark, evs):
    rows = [(u, "start" if s else "done", T0 + dt.timedelta(seconds=t), i) for i, (u, s, t) in enumerate(evs)]
    df = spark.createDataFrame(rows, "user int, kind string, ts timestamp_ntz, id int")
    out = deadline_batch(df.where("kind = 'start'"), df.where("kind = 'done'"), ["user"], "id", "ts", "ts", 120)
    got = {r["id"]: (r["done_at"], r["status"]) for r in out.collect()}
    want = {}
    for u, k, ts, i in rows:
        if k == "start":
            hits = [t for uu, kk, t, _ in rows if uu == u and kk == "done" and ts <= t <= ts + dt.timedelta(seconds=120)]
            want[i] = (min(hits), "done") if hits else (None, "timeout")
    assert got == want


RULE = st.fixed_dictionaries({
    "iface": st.sampled_from([None, "eth0", "eth1", "lo"]),
    "proto": st.sampled_from([None, "tcp", "udp"]),
    "dport": st.sampled_from([None, 22, 80]),
    "state": st.sampled_from([None, ["NEW"], ["ESTABLISHED", "RELATED"]]),
    "tcp_flags": st.sampled_from([None, "SYN", "NONE"]),
    "syn": st.sampled_from([None, True, False]),
    "dst": st.sampled_from([None, (0, 99), (50, 200)]),
    "verdict": st.sampled_from(["ACCEPT", "DROP", "REJECT"]),
})
FLOW = st.tuples(st.sampled_from(["eth0", "eth1", "lo"]), st.sampled_from(["tcp", "udp"]), st.sampled_from([22, 80, 443]),
                 st.sampled_from(["NEW", "ESTABLISHED"]), st.sampled_from(["SYN", "ACK", "NONE"]), st.booleans(),
                 st.integers(0, 250))


def _rule_matches(r, f):
    iface, proto, dport, state, flags, syn, dst = f
    return ((r["iface"] is None or r["iface"] == iface) and (r["proto"] is None or r["proto"] == proto)
            and (r["dport"] is None or r["dport"] == dport) and (r["state"] is None or state in r["state"])
            and (r["tcp_flags"] is None or r["tcp_flags"] == flags) and (r["syn"] is None or r["syn"] == syn)
            and (r["dst"] is None or r["dst"][0] <= dst <= r["dst"][1]))


@SETTINGS
@given(st.lists(RULE, max_size=6), st.lists(FLOW, min_size=1, max_size=25))
def test_first_match_matches_brute_force(spark, rules, flows):
    rrows = [("INPUT", k + 1, r["iface"], r["proto"], r["dst"][0] if r["dst"] else None,
              r["dst"][1] if r["dst"] else None, r["dport"], r["state"], r["tcp_flags"], r["syn"], r["verdict"])
             for k, r in enumerate(rules)]
    rdf = spark.createDataFrame(rrows, "chain string, rank int, iface string, proto string, dst_lo bigint, "
                                "dst_hi bigint, dport int, state array<string>, tcp_flags string, syn boolean, verdict string")
    fdf = spark.createDataFrame([(i, "INPUT", *f[:6], f[6]) for i, f in enumerate(flows)],
                                "flow_id bigint, chain string, iface string, proto string, dport int, state string, "
                                "tcp_flags string, syn boolean, dst bigint")
    pol = spark.createDataFrame([("INPUT", "DROP")], "chain string, verdict string")
    want = {}
    for i, f in enumerate(flows):
        hit = next((k for k, r in enumerate(rules) if _rule_matches(r, f)), None)
        want[i] = (rules[hit]["verdict"], hit + 1) if hit is not None else ("DROP", None)
    for kw in ({"strategy": "inline"}, {"strategy": "join"},
               {"strategy": "join", "max_broadcast_rows": 0}):
        got = {r["flow_id"]: (r["verdict"], r["rule_rank"]) for r in first_match(fdf, rdf, pol, **kw).collect()}
        assert got == want, kw


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 255), st.sampled_from([8, 16, 24, 30, 32]), st.sampled_from("abc")),
                min_size=1, max_size=12),
       st.lists(st.integers(0, 255), min_size=1, max_size=20))
def test_most_specific_prefix_matches_brute_force(spark, prefixes, points):
    base = 10 << 24
    pref = [(base + (x << 8) + x, plen, a) for x, plen, a in prefixes]
    pts = [(i, base + (p << 8) + (p % 7)) for i, p in enumerate(points)]
    pdf = spark.createDataFrame(pref, "net bigint, prefix_len int, attr string")
    qdf = spark.createDataFrame(pts, "id int, ip bigint")
    want = {}
    for i, ip in pts:
        best = None
        for net, plen, a in pref:
            mask = ((1 << 32) - 1) ^ ((1 << (32 - plen)) - 1)
            if ip & mask == net & mask and (best is None or plen > best[1] or (plen == best[1] and a < best[0])):
                best = (a, plen)
        want[i] = best or (None, None)
    for kw in ({}, {"max_broadcast_rows": 0}, {"max_broadcast_rows": 1}):
        out = most_specific_prefix(qdf, "ip", pdf, id_col="id", **kw)
        got = {r["id"]: (r["attr"], r["prefix_len"]) for r in out.collect()}
        assert got == want, kw


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 72 * 60), st.integers(1, 50)), min_size=1, max_size=40),
       st.integers(20, 300))
def test_byte_budget_matches_brute_force(spark, logs, budget):
    rows = [(f"h{h}", i, T0 + dt.timedelta(minutes=m), b) for i, (h, m, b) in enumerate(logs)]
    df = spark.createDataFrame(rows, "host string, id int, ts timestamp_ntz, bytes bigint")
    got = {(r["host"], r["id"]) for r in newest_within_budget(df, "host", "ts", "bytes", budget, "id",
                                                                skew_safe=True).collect()}
    want = set()
    for h in {r[0] for r in rows}:
        acc = 0
        for _, i, _, b in sorted((r for r in rows if r[0] == h), key=lambda r: (r[2], r[1]), reverse=True):
            acc += b
            if acc <= budget:
                want.add((h, i))
    assert got == want


def _sed_next_edit(lines, pat, edit):
    out, i = [], 0
    while i < len(lines):
        if pat in lines[i]:
            out.append(lines[i])
            if i + 1 < len(lines):
                out.append(edit(lines[i + 1]))
            i += 2
        else:
            out.append(lines[i])
            i += 1
    return out


@SETTINGS
@given(st.lists(st.sampled_from(["a pat b", "x true", "pat true", "plain"]), min_size=1, max_size=15))
def test_next_line_edit_matches_sed(spark, lines):
    df = spark.createDataFrame([("f", "\n".join(lines))], "file string, text string")
    out = edit_after_match(to_lines(df, "text", ["file"]), ["file"], "pat", lambda s: replace_first(s, "true", "false"))
    got = [r["line"] for r in out.orderBy("line_no").collect()]
    assert got == _sed_next_edit(lines, "pat", lambda s: s.replace("true", "false", 1))
