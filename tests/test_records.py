"""Broker records: what decodes, why the rest does not, and a sink that replays do not fill twice."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fleetspark.streaming.records import OffsetSink, dead_letters, decode, encode, good_rows, run_records
from fleetspark.streaming.sources import read_event_stream
from tests.conftest import rows

RECORD = "key binary, value binary, topic string, partition int, offset long"
EVENT = "id long, at timestamp_ntz, size double, note string"
AT = dt.datetime(2024, 3, 1, 5, 6, 7, 123456)


def records(spark, values, partition=0, start=0):
    return spark.createDataFrame([(b"k", v, "t", partition, start + i) for i, v in enumerate(values)], RECORD)


def event(n, **more):
    return json.dumps({"id": n, "at": AT.isoformat(), "size": 0.5, "note": f"n{n}", **more}).encode()


CASES = [
    (event(1), None), (event(2, other=[1]), None), (b"\n\t" + event(3), None), (b'{"id": 4}', None),
    (None, "tombstone"), (b"\xff" + event(1), "encoding"), (event(1)[:-1], "malformed"), (b"", "malformed"),
    (b"   ", "malformed"), (b"null", "malformed"), (b"[" + event(1) + b"]", "malformed"), (b"7", "malformed"),
    (event("x"), "malformed"), (b"{}", "missing id"), (b'{"id": null, "note": "a"}', "missing id"),
]


def test_reasons(spark):
    decoded = decode(records(spark, [v for v, _ in CASES]), EVENT, ["id"])
    assert rows(decoded, "offset", "reason") == sorted(((i, r) for i, (_, r) in enumerate(CASES)), key=repr)
    assert decoded.where("(reason IS NULL) <> (decoded IS NOT NULL)").count() == 0
    assert rows(good_rows(decoded), "offset", "id") == [(0, 1), (1, 2), (2, 3), (3, 4)]
    kept = {r["offset"]: r["value"] for r in dead_letters(decoded).collect()}
    assert {k: None if v is None else bytes(v) for k, v in kept.items()} == {i: v for i, (v, r) in enumerate(CASES) if r}


def test_encoded_rows_come_back(spark):
    data = [(1, AT, 0.1, 'quote " and ü\n'), (2, None, None, None), (3, AT, 1e-300, "")]
    sent = encode(spark.createDataFrame(data, EVENT), "id", ["id", "at", "size", "note"]).select(
        "key", "value", F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"))
    assert rows(good_rows(decode(sent, EVENT)), "id", "at", "size", "note") == sorted(data, key=repr)
    assert {bytes(r["key"]) for r in sent.collect()} == {b"1", b"2", b"3"}


def test_clashing_names(spark):
    # the record's identity keeps its name; the corrupt marker steps aside
    values = [b'{"offset": 9, "_corrupt": "c"}']
    out = good_rows(decode(records(spark, values), "offset long, _corrupt string"))
    assert rows(out, "offset", "value_offset", "_corrupt") == [(0, 9, "c")]


def test_empty(spark):
    assert decode(records(spark, []).limit(0), EVENT, ["id"]).count() == 0


SINK = "topic string, partition int, offset long, id long"


def sink_rows(spark, offsets, partition=0):
    return spark.createDataFrame([("t", partition, o, 10 * o) for o in offsets], SINK)


@pytest.fixture()
def sink(spark, tmp_path):
    return lambda writer: OffsetSink(spark, str(tmp_path / "sink"), sink_rows(spark, [0]).schema, writer)


def test_sink_empty_and_repeats(spark, sink):
    assert sink("a").read().count() == 0
    sink("a").write(sink_rows(spark, [1, 2, 2, 3]), 0)
    assert rows(sink("a").read(), "offset") == [(1,), (2,), (3,)]
    sink("a").write(sink_rows(spark, [1]).limit(0), 1)
    assert sink("a").read().count() == 3


def test_same_batch_again(spark, sink):
    for _ in range(2):
        sink("a").write(sink_rows(spark, [1, 2, 3]), 0)
        sink("a").write(sink_rows(spark, [4, 5]), 1)
    assert rows(sink("a").read(), "offset") == [(1,), (2,), (3,), (4,), (5,)]


def test_other_cuts_by_another_writer(spark, sink):
    sink("a").write(sink_rows(spark, [1, 2, 5]), 0)
    sink("a").write(sink_rows(spark, [1, 2], partition=1), 1)
    for _ in range(2):  # its second attempt meets its own first one
        sink("b").write(sink_rows(spark, [2, 3, 4, 5, 6]), 0)
    sink("b").write(sink_rows(spark, [3, 4], partition=1), 1)
    assert rows(sink("b").read(), "partition", "offset") == [
        *[(0, o) for o in (1, 2, 3, 4, 5, 6)], *[(1, o) for o in (1, 2, 3, 4)]]


def test_rows_without_a_log_are_not_read(spark, sink):
    s = sink("a")
    s.write(sink_rows(spark, [1]), 0)
    sink_rows(spark, [2]).write.parquet(f"{s.rows}/a-000000000001")  # died before its log
    assert rows(s.read(), "offset") == [(1,)]
    s.write(sink_rows(spark, [2]), 1)
    assert rows(s.read(), "offset") == [(1,), (2,)]


def test_stream_restarts_and_replays(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    first = records(spark, [event(i) for i in range(6)] + [b"{"])
    first.repartition(3).write.parquet(source)

    def run(ckpt, writer):
        stream = read_event_stream(spark, source, schema=first.schema, max_files_per_trigger=1)
        return run_records(stream, EVENT, ["id"], path, str(tmp_path / ckpt), writer)

    run("c1", "w1")
    records(spark, [event(10), None], partition=1).write.mode("append").parquet(source)
    run("c1", "w1")  # goes on from its checkpoint
    good, dead = run("c2", "w2")  # reads all again with another checkpoint
    assert rows(good.read(), "partition", "offset", "id") == [*[(0, i, i) for i in range(6)], (1, 0, 10)]
    assert rows(dead.read(), "partition", "offset", "reason") == [(0, 6, "malformed"), (1, 1, "tombstone")]


def test_a_batch_is_read_once_for_both_sinks(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    first = records(spark, [event(i) for i in range(6)] + [b"{", None])
    first.repartition(2).write.parquet(source)
    read = spark.sparkContext.accumulator(0)

    def counted(value):
        read.add(1)
        return value

    stream = read_event_stream(spark, source, schema=first.schema, max_files_per_trigger=1).withColumn(
        "value", F.udf(counted, "binary")("value"))
    good, dead = run_records(stream, EVENT, ["id"], path, str(tmp_path / "c"), "w")
    assert rows(good.read(), "offset", "id") == [(i, i) for i in range(6)]
    assert rows(dead.read(), "offset", "reason", "key", "value") == [(6, "malformed", b"k", b"{"), (7, "tombstone", b"k", None)]
    assert read.value == 8
