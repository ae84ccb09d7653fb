import datetime as dt

from fleetspark.operators.audit import (default_secret_audit, fill_placeholders, normalize_priority, start_order,
                                        stop_order, unresolved_placeholders)
from fleetspark.operators.merge import force_merge, newer_wins
from fleetspark.operators.retention import age_filter, newest_within_budget, weekly_rotation
from tests.conftest import rows


def daemons(spark):
    d = spark.createDataFrame([("h", "zebra", 1, "yes"), ("h", "bgpd", 2, "yes"), ("h", "ospfd", 3, "10"),
                               ("h", "ripd", 4, "no")], "host string, daemon string, pos int, value string")
    return d.withColumn("prio", normalize_priority("daemon", "value"))


def test_start_order_priority_ten_never_starts(spark):
    for mode in ("auto", True, False):
        out = start_order(daemons(spark), "host", "daemon", "pos", "prio", wanted=10, skew_safe=mode)
        assert rows(out, "start_seq", "daemon", "prio") == [(1, "zebra", 1), (2, "bgpd", 2)]
    out = start_order(daemons(spark), "host", "daemon", "pos", "prio", wanted=10, max_group_rows=1)
    assert rows(out, "start_seq", "daemon", "prio") == [(1, "zebra", 1), (2, "bgpd", 2)]


def test_stop_order_zero_includes_disabled(spark):
    for mode in ("auto", True, False):
        out = stop_order(daemons(spark), "host", "daemon", "pos", "prio", wanted=0, skew_safe=mode)
        assert rows(out, "stop_seq", "daemon") == [(1, "bgpd"), (2, "zebra"), (3, "ripd")]


def test_placeholder_fill_then_audit(spark):
    df = spark.createDataFrame([(1, "router bgp <A>\n neighbor <B> remote-as <A>\n x <B>")], "id int, t string")
    partial = df.select("id", fill_placeholders("t", [("A", "65015")]).alias("t"))
    assert rows(unresolved_placeholders(partial, "t", ["id"]), "placeholder") == [("B",), ("B",)]
    full = df.select("id", fill_placeholders("t", {"A": "65015", "B": "172.16.100.2"}).alias("t"))
    assert unresolved_placeholders(full, "t", ["id"]).count() == 0


def test_default_secret_audit(spark):
    cfg = spark.createDataFrame([("DB_PASSWORD", "secret"), ("UI_PASSWORD", "s3cr3t-x"),
                                 ("CLIENT_PASSWORD_1", "'soadmin'"), ("USER", "secret")], "key string, value string")
    out = default_secret_audit(cfg)
    assert rows(out, "key", "is_default") == sorted([("DB_PASSWORD", True), ("UI_PASSWORD", False),
                                                     ("CLIENT_PASSWORD_1", True)], key=repr)


def dirs(spark):
    s = spark.createDataFrame([("f1", 10, "s1"), ("f2", 5, "s2")], "name string, mtime int, content string")
    t = spark.createDataFrame([("f1", 5, "t1"), ("f2", 5, "t2"), ("f3", 1, "t3")], "name string, mtime int, content string")
    return s, t


def test_newer_wins_and_idempotent(spark):
    s, t = dirs(spark)
    out = newer_wins(s, t)
    assert rows(out, "name", "content") == [("f1", "s1"), ("f2", "t2"), ("f3", "t3")]
    again = newer_wins(s, out.select("name", "mtime", "content"))
    assert rows(again, "name", "content") == rows(out, "name", "content")


def test_force_merge(spark):
    s, t = dirs(spark)
    assert rows(force_merge(s, t), "name", "content") == [("f1", "s1"), ("f2", "s2"), ("f3", "t3")]


def test_byte_budget_newest_first(spark):
    base = dt.datetime(2024, 1, 10, 12)
    logs = spark.createDataFrame([("h", i, base - dt.timedelta(hours=i), 40) for i in range(3)],
                                 "host string, id int, ts timestamp_ntz, bytes bigint")
    for mode in ("auto", True, False):
        out = newest_within_budget(logs, "host", "ts", "bytes", 100, tie_col="id", skew_safe=mode)
        assert rows(out, "id", "cum_bytes") == [(0, 40), (1, 80)]
    # "auto" with a tiny bound takes the distributed plan; same answer
    out = newest_within_budget(logs, "host", "ts", "bytes", 100, tie_col="id", max_group_rows=1)
    assert rows(out, "id", "cum_bytes") == [(0, 40), (1, 80)]


def test_weekly_rotation_keeps_newest_big_weeks(spark):
    mondays = [dt.datetime(2024, 1, 1) + dt.timedelta(weeks=w) for w in range(6)]
    sizes = [2 << 20, 2 << 20, 100, 2 << 20, 2 << 20, 2 << 20]
    logs = spark.createDataFrame([("h", m, s) for m, s in zip(mondays, sizes)], "host string, ts timestamp_ntz, bytes bigint")
    out = weekly_rotation(logs, "host", "ts", "bytes", keep=4, min_size=1 << 20)
    assert [r["week"] for r in out.orderBy("generation").collect()] == [mondays[5], mondays[4], mondays[3], mondays[1]]


def test_age_filter(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 22)), (2, dt.datetime(2024, 1, 25)), (3, dt.datetime(2024, 1, 10))],
                               "id int, ts timestamp_ntz")
    out = age_filter(df, "ts", "2024-01-31T00:00:00", 10, 7)
    assert rows(out, "id", "in_repair_window") == [(1, False), (2, True)]
