from fleetspark.functions.text import replace_first
from fleetspark.operators.lines import edit_after_match, line_drift, second_last, to_lines
from fleetspark.sources.access_log import parse_access_log
from fleetspark.sources.kv import blocks, last_wins_config, read_kv, xml_properties
from tests.conftest import rows


def lines_of(spark, text, file="f"):
    return to_lines(spark.createDataFrame([(file, text)], "file string, text string"), "text", ["file"])


def test_next_line_edit_skips_consumed_line(spark):
    text = "x pat\nx pat true\ntrue\nplain true"
    out = edit_after_match(lines_of(spark, text), ["file"], "pat", lambda s: replace_first(s, "true", "false"))
    got = rows(out, "line_no", "line", "edited")
    # line 1 triggers, line 2 is pulled in and edited (not tested), line 3 is untouched
    assert got == [(1, "x pat", False), (2, "x pat false", True), (3, "true", False), (4, "plain true", False)]


def test_line_drift_counts_repeats(spark):
    a = lines_of(spark, "same\nsame\nonly a")
    b = lines_of(spark, "same\nonly b")
    out = line_drift(a, b, ["file"], a_name="a", b_name="b")
    assert rows(out, "line", "side") == [("only a", "a"), ("only b", "b"), ("same", "a")]
    assert line_drift(a, a, ["file"]).count() == 0


def test_second_last(spark):
    df = spark.createDataFrame([("u", 1), ("u", 2), ("u", 3), ("v", 7)], "u string, t int")
    assert rows(second_last(df, ["u"], ["t"], ["t"]), "u", "t") == [("u", 2), ("v", 7)]


def test_kv_scan_sections_comments_last_wins(spark, tmp_path):
    cfg = "# comment\n! also\n\nA=1\n[sec]\nB = 'two'\nC=\"x=y\"\n\nA=9\n"
    (tmp_path / "a.conf").write_text(cfg)
    kv = read_kv(spark, str(tmp_path / "a.conf"))
    got = rows(kv, "section", "key", "value", "line_no")
    expect = [(None, "A", "1", 4), ("sec", "A", "9", 9), ("sec", "B", "two", 6), ("sec", "C", "x=y", 7)]
    assert got == sorted(expect, key=repr)
    last = last_wins_config(kv.drop("section"))
    assert {r["key"]: r["value"] for r in last.collect()}["A"] == "9"


def test_xml_properties(spark, tmp_path):
    xml = ("<configuration><property><name>shelf.copies</name><value>2</value></property>"
           "<property><name>shelf.home</name><value>box://kiwi:4100</value></property>"
           "<property><name>shelf.copies</name><value>3</value></property></configuration>")
    (tmp_path / "shelf.xml").write_text(xml)
    props = xml_properties(spark, str(tmp_path / "shelf.xml"))
    assert rows(props, "line_no", "key", "value") == [(1, "shelf.copies", "2"), (2, "shelf.home", "box://kiwi:4100"),
                                                      (3, "shelf.copies", "3")]
    assert {r["key"]: r["value"] for r in last_wins_config(props).collect()}["shelf.copies"] == "3"


def test_blocks(spark):
    text = ("#     colour: 1\nshelf:\n     label: <A>\n     colour:     <B>\n\n"
            "shelf:\n     label: top\n     colour: 7\n")
    out = blocks(lines_of(spark, text), "shelf", keys=["label", "colour"])
    assert rows(out, "block", "label", "colour") == [(1, "<A>", "<B>"), (2, "top", "7")]


def test_access_log_parse_and_reject(spark):
    good = ('10.0.0.1 - alice [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.1" 200 2326 "http://r/" '
            '"Mozilla" "-"')
    bad = '10.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.1" 200'
    df = spark.createDataFrame([(good,), (bad,)], "value string")
    parsed, rejects = parse_access_log(df)
    r = parsed.first()
    assert (r["remote_addr"], r["remote_user"], r["status"], r["body_bytes_sent"], r["user_agent"]) == (
        "10.0.0.1", "alice", 200, 2326, "Mozilla")
    import datetime as dt
    assert r["time_local"] == dt.datetime(2000, 10, 10, 20, 55, 36)  # UTC
    assert [x[0] for x in rejects.collect()] == [bad]
