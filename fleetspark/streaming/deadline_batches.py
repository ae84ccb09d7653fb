"""Deadline detection (T1) over many batches, with late rows in a side output.

``deadline_stream`` leaves state to Spark's stream-stream join, which drops rows
later than the watermark without a word and settles a start only once a later row
moves the watermark past it.  ``DeadlineRun`` is a ``foreachBatch`` target that
keeps both apart.  For batch ``n`` it writes, under ``path``:

- ``in``: the batch's starts and completions;
- ``late``: those before the horizon that earlier batches had reached (the largest
  event time seen, less ``delay_s``);
- ``out``: the starts whose wait ends before the new horizon, judged for good by
  ``deadline_batch`` (no row that is on time can change them);
- ``open``: the starts still waiting, and the completions they may need;
- ``log``: the new horizon, written last.

Each batch writes folders of its own number from those of the one before, so a
batch that is tried again, also after a restart from the stream's checkpoint, writes the
same rows once more.  What is carried grows with the rows of ``delay_s`` plus the
timeout, not with the stream.  No closing marker is needed: ``settled`` adds the
starts still open, judged by what came so far, and ``amended`` brings the late rows
in, which equals ``deadline_batch`` over all rows.

A row without a time is never late: such a start is judged at once (timeout), such
a completion meets none.  Null keys meet none either.  A start repeated with the
same keys, id and time is one start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.streaming.deadline import _judged, _last_look, deadline_batch


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


class DeadlineRun:
    """The folders of one run and the target of its ``foreachBatch``."""

    def __init__(self, spark: SparkSession, path: str, key_cols: Sequence[str], id_col: str, ts_col: str, is_start: Column,
                 is_done: Column, timeout_s: int = 120, delay_s: int = 600, poll_s: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.id, self.ts = list(key_cols), id_col, ts_col
        self.is_start, self.is_done = is_start, is_done
        self.timeout_s, self.delay_s, self.poll_s = timeout_s, delay_s, poll_s
        self.within = _last_look(timeout_s, poll_s) * 1_000_000

    def _write(self, df: DataFrame, kind: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch_id}")

    def _of(self, kind: str, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}/batch={batch_id}")

    def _all(self, kind: str) -> DataFrame:
        """The rows of every logged batch."""
        last = self.last_batch()
        if last is None:
            raise ValueError("no batch has been written yet")
        return self.spark.read.parquet(f"{self.path}/{kind}").where(F.col("batch") <= last).drop("batch")

    def last_batch(self) -> int | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.schema("horizon long, batch int").parquet(f"{self.path}/log").agg(F.max("batch")).first()[0]

    def _judge(self, starts: DataFrame, dones: DataFrame) -> DataFrame:
        return deadline_batch(starts, dones, self.keys, self.id, self.ts, self.ts, self.timeout_s, self.poll_s)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The target of ``foreachBatch``: batches come in the order of their numbers, the last one perhaps again."""
        last = self.last_batch()
        if batch_id not in ({0} if last is None else {last, last + 1}):
            raise ValueError(f"batch {batch_id} after batch {last}: the folder is of another checkpoint")
        cols = [*self.keys, self.id, self.ts]
        roles = F.array_compact(F.array(F.when(self.is_start, "start"), F.when(self.is_done, "done")))
        self._write(batch.select(*cols, F.explode(roles).alias("role")), "in", batch_id)
        rows = self._of("in", batch_id)
        before = self._of("log", batch_id - 1).first()["horizon"] if batch_id else None
        top = rows.agg(F.max(_micros(self.ts)).alias("top")).first()["top"]
        reached = [h for h in (before, None if top is None else top - self.delay_s * 1_000_000) if h is not None]
        horizon = max(reached) if reached else None
        late = F.coalesce(_micros(self.ts) < F.lit(before).cast("long"), F.lit(False))
        self._write(rows.where(late), "late", batch_id)
        held = rows.where(~late)
        if batch_id:
            held = held.unionByName(self._of("open", batch_id - 1))
        # settled: a completion of its window would now be late
        over = _micros(self.ts).isNull() | F.coalesce(_micros(self.ts) + self.within < F.lit(horizon).cast("long"), F.lit(False))
        start, done = F.col("role") == "start", F.col("role") == "done"
        self._write(self._judge(held.where(start & over), held.where(done)), "out", batch_id)
        self._write(held.where(~over), "open", batch_id)
        log = self.spark.range(1).select(F.lit(horizon).cast("long").alias("horizon"))
        self._write(log, "log", batch_id)

    def late(self) -> DataFrame:
        """Rows that came after their horizon: keys, id, time and ``role``."""
        return self._all("late")

    def results(self) -> DataFrame:
        """Starts judged for good."""
        return self._all("out")

    def pending(self) -> DataFrame:
        """Starts still waiting, judged by the completions so far."""
        last = self.last_batch()
        if last is None:
            raise ValueError("no batch has been written yet")
        rows = self._of("open", last)
        return self._judge(rows.where("role = 'start'"), rows.where("role = 'done'"))

    def settled(self) -> DataFrame:
        """Every start that came in time: ``results`` and, as if the stream ended now, ``pending``."""
        return self.results().unionByName(self.pending())

    def amended(self) -> DataFrame:
        """``settled`` with the late rows brought in: late completions to every start, late starts against every
        completion.  Equals ``deadline_batch`` over all rows that came."""
        every, late = self._all("in"), self.late()
        starts, dones = every.where("role = 'start'"), every.where("role = 'done'")
        cols = [*self.keys, self.id, "started", "done_at"]
        found = self.settled().select(*cols)
        found = found.unionByName(self._judge(starts, late.where("role = 'done'")).select(*cols))
        found = found.unionByName(self._judge(late.where("role = 'start'"), dones).select(*cols))
        return _judged(found.groupBy(*cols[:-1]).agg(F.min("done_at").alias("done_at")), self.poll_s)


def run_deadlines(stream: DataFrame, run: DeadlineRun, checkpoint: str) -> DeadlineRun:
    """All rows available now through ``run``; called again with the same ``checkpoint`` it goes on with what came since."""
    query = (stream.writeStream.foreachBatch(run.write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return run
