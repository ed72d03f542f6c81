"""Structured Streaming: micro-batch upserts, stale runs, counts by day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import merge
from millrace.plans.storage import reliable


def upsert_stream(changes: DataFrame, table: merge.VersionedTable, keys: Sequence[str], order: Sequence[Column], checkpoint: str, newer: str | None = None) -> StreamingQuery:
    """Merge what has landed since the last call, then stop. The checkpoint holds the position, and the table's version the
    last batch of this checkpoint that it holds, so a batch that is replayed after a failure isn't merged again. ``newer``: a
    column of the changes, held in the table, by which a row replaces only one that isn't newer; so batches may come in any
    order, and the table ends as if all changes had come at once."""

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            first = [F.desc_nulls_last(newer), *order] if newer else order
            table.merge(merge.last_of_key(batch, keys, first), keys, (checkpoint, number), newer=newer)

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(runs: DataFrame, late: str = "1 day") -> DataFrame:
    """Runs and records of each day, from a stream of runs; a day closes when the watermark has passed it."""
    return runs.withWatermark("start_time", late).groupBy(F.window("start_time", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("total_records").alias("records")).select(F.to_date("w.start").alias("day"), "n", "records")


#: Fixed value: what a run is from when it is found to have gone silent.
ABNORMAL = "failed_abnormal_exit"
#: Parts that the runs' last heartbeats are kept in.
PARTS = 16


class StaleRuns:
    """The last heartbeat of every run, kept in a table, and the open runs that have gone silent.

    Heartbeats come as a stream. A run's row only gives way to a newer heartbeat, so late ones change nothing. All rows are
    judged on every trigger, whether it brings heartbeats or not: a run that beats once and then never again is found. Runs
    that are found are handed over once, and are abnormal from then on, unless they beat again. The table grows with all runs,
    unless ``forget`` is given: then runs that are over and whose last heartbeat is older than that go away, and heartbeats
    that old are ignored when they land."""

    SCHEMA = "run_id string, last_heartbeat timestamp_ntz, status string, part int"

    def __init__(self, table: merge.VersionedTable, checkpoint: str, minutes: int = 5, forget: timedelta | None = None):
        if table.partition != "part":
            raise ValueError("the table's partition is part")
        self.table, self.checkpoint, self.minutes, self.forget = table, checkpoint, minutes, forget

    def _put(self, beats: DataFrame, number: int, now: datetime) -> None:
        if self.forget is not None:
            beats = beats.where(F.col("last_heartbeat") >= F.lit(now - self.forget).cast("timestamp_ntz"))
        last = beats.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.max("last_heartbeat").alias("last_heartbeat"), F.max_by("status", F.struct("last_heartbeat", "status")).alias("status"))
        rows = last.where("run_id IS NOT NULL AND last_heartbeat IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("run_id"), F.lit(PARTS)).cast("int"))
        if not rows.isEmpty():
            self.table.merge(rows, ["part", "run_id"], (self.checkpoint, number), newer="last_heartbeat")

    def trigger(self, heartbeats: DataFrame, now: datetime) -> DataFrame:
        """Take in what has landed of the stream (run_id, status, last_heartbeat), and give the runs (run_id, last_heartbeat,
        status) that are open and have been silent for longer than allowed at ``now``."""
        heartbeats.writeStream.foreachBatch(lambda beats, number: self._put(beats, number, now)).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination()
        known = self.table.read(self.SCHEMA)
        old = F.col("last_heartbeat") < F.lit(now - timedelta(minutes=self.minutes)).cast("timestamp_ntz")
        open_ = F.col("status").isin("running", "stopping")
        stale = reliable(known.where(open_ & old))
        if not stale.isEmpty():
            self.table.merge(stale.withColumn("status", F.lit(ABNORMAL)), ["part", "run_id"], newer="last_heartbeat")
        if self.forget is not None:
            over = reliable(known.where(~open_ & (F.col("last_heartbeat") < F.lit(now - self.forget).cast("timestamp_ntz"))).select("part", "run_id"))
            if not over.isEmpty():
                self.table.delete(over, ["part", "run_id"])
        return stale.drop("part")
