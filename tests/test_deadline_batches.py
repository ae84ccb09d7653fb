import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetspark.streaming.deadline import deadline_batch
from fleetspark.streaming.deadline_batches import DeadlineRun, run_deadlines
from fleetspark.streaming.sources import read_event_stream, write_table
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "user string, kind string, ts timestamp_ntz, id long"


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def frame(spark, data):
    return spark.createDataFrame([(u, k, at(s), i) for u, k, s, i in data], SCHEMA)


def new_run(spark, path, **kw):
    return DeadlineRun(spark, str(path), ["user"], "id", "ts", F.col("kind") == "start", F.col("kind") == "done", **kw)


def batch_form(df, poll_s=None):
    return deadline_batch(df.where("kind = 'start'"), df.where("kind = 'done'"), ["user"], "id", "ts", "ts", 120, poll_s)


BATCHES = [
    [("a", "start", 0, 1), ("b", "start", 10, 2), ("a", "done", 60, 3), (None, "start", 5, 4), ("n", "start", None, 5),
     ("n", "done", None, 6)],
    [("c", "start", 700, 7), ("b", "done", 131, 8), ("d", "start", 900, 9)],
    # the horizon is 300: the first two are late, the third is not
    [("a", "done", 20, 10), ("e", "start", 200, 11), ("d", "done", 1019, 12), ("c", "done", 1600, 13), ("e", "done", 290, 14)],
]


def deliver(spark, tmp_path, run, batches):
    for data in batches:
        write_table(frame(spark, data).coalesce(1), str(tmp_path / "inbox"), mode="append")
        run_deadlines(read_event_stream(spark, str(tmp_path / "inbox"), schema=SCHEMA), run, str(tmp_path / "ckpt"))


def test_late_rows_go_to_the_side_output(spark, tmp_path):
    run = new_run(spark, tmp_path / "run")
    deliver(spark, tmp_path, run, BATCHES)
    assert rows(run.late(), "id", "role") == [(10, "done"), (11, "start"), (14, "done")]
    # judged for good: all before 1000 - 120; a's late completion is not used
    status = {r["id"]: r["status"] for r in run.settled().collect()}
    assert status == {1: "done", 2: "timeout", 4: "timeout", 5: "timeout", 7: "timeout", 9: "done"}
    assert {r["id"]: r["done_at"] for r in run.results().collect()}[1] == at(60)
    assert {r["id"] for r in run.pending().collect()} == {9}
    everything = frame(spark, [r for b in BATCHES for r in b])
    amended = rows(run.amended())
    assert amended == rows(batch_form(everything).select(*run.amended().columns))
    assert {r[1]: r[4] for r in amended}[11] == "done"


def test_a_batch_tried_again_writes_the_same(spark, tmp_path):
    run = new_run(spark, tmp_path / "run")
    for n, data in enumerate(BATCHES):
        run.write(frame(spark, data), n)
        before = rows(run.settled()), rows(run.late())
        again = new_run(spark, tmp_path / "run")  # a new driver: everything it knows is in the folders
        again.write(frame(spark, data), n)
        assert (rows(again.settled()), rows(again.late())) == before
    with pytest.raises(ValueError, match="another checkpoint"):
        run.write(frame(spark, BATCHES[0]), 0)


def test_a_failed_batch_is_not_read(spark, tmp_path, monkeypatch):
    run = new_run(spark, tmp_path / "run")
    run.write(frame(spark, BATCHES[0]), 0)
    before = rows(run.settled())
    whole = DeadlineRun._write

    def fails(self, df, kind, batch_id):
        if kind == "log":
            raise RuntimeError("lost")
        whole(self, df, kind, batch_id)

    monkeypatch.setattr(DeadlineRun, "_write", fails)
    with pytest.raises(RuntimeError):
        run.write(frame(spark, BATCHES[1]), 1)
    assert rows(run.settled()) == before and run.last_batch() == 0


@pytest.mark.parametrize("poll_s", [None, 7])
def test_random_batches_amended_are_the_batch_form(spark, tmp_path, poll_s):
    rnd = random.Random(5)
    data = [(f"u{rnd.randrange(3)}", rnd.choice(["start", "done", "other"]), i * 3 + rnd.randrange(-200, 200), i) for i in range(400)]
    run = new_run(spark, tmp_path / "run", delay_s=60, poll_s=poll_s)
    for n in range(5):
        run.write(frame(spark, data[n * 80:(n + 1) * 80]), n)
    assert run.late().count() > 20
    want = batch_form(frame(spark, data), poll_s)
    assert rows(run.amended(), *want.columns) == rows(want)
    # without the late rows, what is settled is the batch form of the rows in time
    late = [r["id"] for r in run.late().collect()]
    assert rows(run.settled(), *want.columns) == rows(batch_form(frame(spark, [r for r in data if r[3] not in late]), poll_s))
    # only what may still matter is carried
    assert spark.read.parquet(f"{run.path}/open/batch=4").count() < 150


def test_empty_batches(spark, tmp_path):
    run = new_run(spark, tmp_path / "run")
    with pytest.raises(ValueError, match="no batch"):
        run.results()
    run.write(frame(spark, []), 0)
    assert run.settled().count() == 0 and run.late().count() == 0 and run.amended().count() == 0
    run.write(frame(spark, BATCHES[0]), 1)
    run.write(frame(spark, []), 2)
    assert {r["id"] for r in run.settled().collect()} == {1, 2, 4, 5}
