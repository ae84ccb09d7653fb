"""Faults that a review found: one answer at every size, no lost rows, references in unanchored patterns."""

from pyspark.sql import functions as F

from fleetspark.functions.text import capture_replace, regex_replace_first
from fleetspark.operators.leases import bounded_allocation
from fleetspark.operators.policy import most_specific_prefix
from fleetspark.sources.access_log import parse_access_log
from fleetspark.sources.listings import HOSTS_SCHEMA, read_listing, rejected_listings


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column).first()[0]


def test_unanchored_references(spark):
    assert one(spark, "abcb", capture_replace("s", "b", "[&]")) == "a[b]cb"
    assert one(spark, "xabb", capture_replace("s", r"(b)\1", r"<\1>")) == "xa<b>"
    assert one(spark, "ab", capture_replace("s", "(b)", r"$5\1")) == "a$5b"
    assert one(spark, "xabb", regex_replace_first("s", r"(b)\1", "-")) == "xa-"


def test_null_group_is_allocated(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, k int")
    assert sorted(r["k"] for r in bounded_allocation(df, ["g"], ["k"], 2, 3).collect()) == [1, 2]


def test_large_prefix_slices_need_no_id_and_keep_repeated_rows(spark):
    pts = spark.createDataFrame([(0x0A000001,), (0x0A000001,), (1,)], "n long")
    pf = spark.createDataFrame([(0x0A000000, 8, "x"), (0x0A000000, 24, "y"), (5, None, "z"), (5, 40, "z"), (None, 8, "z")],
                               "net long, prefix_len int, attr string")
    for bound in (0, 1, 100):
        got = most_specific_prefix(pts, "n", pf, max_broadcast_rows=bound)
        assert sorted((r["n"], r["attr"]) for r in got.select("n", "attr").collect() if r["attr"]) == [(0x0A000001, "y")] * 2
        assert got.count() == 3


def test_impossible_date_is_a_reject(spark):
    line = '1.2.3.4 - - [{}/2024:10:00:00 +0000] "GET / HTTP/1.1" 200 {} "-" "ua" "-"'
    df = spark.createDataFrame([(line.format("31/Foo", 5),), (line.format("30/Jan", 5),), (line.format("30/Jan", "9" * 30),)],
                               "value string")
    parsed, rejects = parse_access_log(df)
    assert rejects.count() == 1
    assert sorted((r["body_bytes_sent"] or 0) for r in parsed.collect()) == [0, 5]


def test_truncated_listing_is_reported(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "hypervisor_hostname": "h", "node_type": "t"}]')
    (tmp_path / "b.json").write_text('[{"id": "2", "hypervisor_hostname": "h"')
    assert [r["id"] for r in read_listing(spark, str(tmp_path), HOSTS_SCHEMA).collect()] == ["1"]
    assert rejected_listings(spark, str(tmp_path), HOSTS_SCHEMA).select(F.col("file").endswith("b.json")).collect()[0][0]


def test_bracket_globs(spark):
    import fnmatch

    from fleetspark.functions.predicate import matches_glob
    names = ["a1", "ab", "a-", "a]", "a^", "a\\", "a[0-9]*", "b1", "a9zz", "a&", "[x"]
    df = spark.createDataFrame([(x,) for x in names], "s string")
    for glob in ["a[0-9]*", "a[!0-9]", "a[]]", "a[]^]", "a[\\]", "[x", "a[&&x]", "a[^b]", "?[b-z]"]:
        got = sorted(r["s"] for r in df.where(matches_glob("s", glob)).collect())
        assert got == sorted(x for x in names if fnmatch.fnmatchcase(x, glob.replace("[^", "[!"))), glob


def test_runs_of_blanks_part_words(spark):
    from fleetspark.functions.text import split_size
    df = spark.createDataFrame([("a  b", 2), (" a\tb c ", 3), ("", 0), ("   ", 0), ("x", 1)], "s string, n int")
    assert df.where(split_size("s") != df.n).count() == 0


def test_merge_of_repeated_names_is_total(spark):
    from fleetspark.operators.merge import force_merge, newer_wins
    files = spark.createDataFrame([("x", 1, "b"), ("x", 1, "a"), ("x", 0, "z")], "name string, mtime int, content string")
    for merged in (newer_wins(files, files.limit(0)), newer_wins(files.limit(0), files), force_merge(files, files.limit(0))):
        assert [tuple(r)[:3] for r in merged.collect()] == [("x", 1, "b")]


def test_quotes_and_brackets_in_the_first_fields(spark):
    tail = '[10/Oct/2000:13:55:36 -0700] "GET /a [b] HTTP/1.0" 200 - "-" "agent, \'x\' [y]" "1.2.3.4, 5.6.7.8"'
    df = spark.createDataFrame([('h"o - u"s[er ' + tail,), ('h - u ' + tail + ' ',), (None,), ("",)], "value string")
    parsed, rejects = parse_access_log(df)
    r = parsed.collect()
    assert len(r) == 1 and rejects.count() == 3
    assert (r[0]["remote_addr"], r[0]["remote_user"], r[0]["request"], r[0]["status"], r[0]["body_bytes_sent"]) == (
        'h"o', 'u"s[er', "GET /a [b] HTTP/1.0", 200, None)
    assert (str(r[0]["time_local"]), r[0]["user_agent"], r[0]["x_forwarded_for"]) == (
        "2000-10-10 20:55:36", "agent, 'x' [y]", "1.2.3.4, 5.6.7.8")
