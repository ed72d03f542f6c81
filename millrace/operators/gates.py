"""Quality gates: each gives verdict rows (gate, status, reason) with counts."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import keys as K
from millrace.operators.merge import orphans
from millrace.plans.storage import numbered

#: Limits of an automatic delete, and of a source's decline, in whole numbers.
AUTO_ROWS, AUTO_PERCENT, LEAST_SOURCE_PERCENT = 1000, 1, 90

#: Where a run may go from each state. Running and stopping may repeat; nothing leaves a final state.
TRANSITIONS = {"running": ("running", "stopping", "success", "partial", "failed"), "stopping": ("stopping", "stopped")}


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of frames of one row each, side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*(F.max(c).alias(c) for c in out.columns))


def verdict(gate: str, checks: Sequence[tuple[Column, str]], good: str = "passed", bad: str = "failed") -> list[Column]:
    """The first check that fails gives the reason."""
    reason = F.lit(None).cast("string")
    for failed, why in reversed(checks):
        reason = F.when(failed, F.lit(why)).otherwise(reason)
    return [F.lit(gate).alias("gate"), F.when(reason.isNull(), good).otherwise(bad).alias("status"), F.coalesce(reason, F.lit("ok")).alias("reason")]


def orphan_decision(counts: DataFrame) -> DataFrame:
    """counts: source, previous, target, orphans, duplicates, filtered (long), partial (boolean)."""
    c = F.col
    blocked = [
        (c("source") <= 0, "nothing in the source"),
        (c("duplicates") > 0, "keys repeat in the source"),
        (c("partial"), "not all rows were written"),
        (c("filtered") > 0, "the load dropped rows"),
        ((c("orphans") < 0) | (c("target") < 0) | (c("orphans") > c("target")), "the counts contradict each other"),
        ((c("previous") > 0) & (c("source") * 100 < c("previous") * LEAST_SOURCE_PERCENT), "source fell by more than a tenth"),
    ]
    few = (c("target") > 0) & (c("orphans") <= AUTO_ROWS) & (c("orphans") * 100 <= c("target") * AUTO_PERCENT)
    decision, reason = F.lit("approval_required"), F.lit("too many orphans to delete unasked")
    for test, d, r in ((few, "auto_approved", "few enough orphans to delete"), (c("orphans") == 0, "auto_approved", "no orphans"), *((t, "blocked", why) for t, why in reversed(blocked))):
        decision, reason = F.when(test, d).otherwise(decision), F.when(test, r).otherwise(reason)
    return counts.select("*", decision.alias("decision"), reason.alias("reason"))


def reconcile_counts(source: DataFrame, target: DataFrame, keys: Sequence[str], previous: int = 0, filtered: int = 0, partial: bool = False) -> DataFrame:
    """One row: what :func:`orphan_decision` needs, and the source's fingerprint."""
    s = K.counts(source, keys).select(F.col("n_rows").alias("source"), F.col("n_duplicates").alias("duplicates"))
    gone = orphans(target, source, keys).agg(F.count("*").alias("orphans"))
    t = target.agg(F.count("*").alias("target"))
    fixed = [F.lit(previous).cast("long").alias("previous"), F.lit(filtered).cast("long").alias("filtered"), F.lit(partial).alias("partial")]
    return one_row(s, t, gone, K.fingerprint(source, keys)).select("*", *fixed)


def reconcile_by(source: DataFrame, target: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """For each value of ``by``, columns of both: (source, duplicates, target, orphans), counted like a whole table's."""
    per_key = source.groupBy(*by, *keys).agg(F.count("*").alias("n"))
    s = per_key.groupBy(*by).agg(F.sum("n").alias("source"), (F.sum("n") - F.count("*")).alias("duplicates"))
    t = target.groupBy(*by).agg(F.count("*").alias("target"))
    gone = K.anti(target.select(*by, *keys).distinct(), source, keys).groupBy(*by).agg(F.count("*").alias("orphans"))
    counts = ["source", "duplicates", "target", "orphans"]
    every = s.unionByName(t, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
    return every.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))


class Approvals:
    """Approvals of deletes, each good for one use. Using one takes a marker file that only one writer can create, so two
    loads can't use the same approval."""

    SCHEMA = "snapshot_id string, table string, fingerprint string, orphan_count long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def grant(self, rows: DataFrame) -> None:
        """``rows``: snapshot_id, table, fingerprint, orphan_count."""
        rows.select("snapshot_id", "table", "fingerprint", F.col("orphan_count").cast("long").alias("orphan_count")).write.mode("append").parquet(f"{self.path}/granted")

    def _marker(self, row) -> tuple:
        name = hashlib.sha256("\x00".join(map(str, (row.snapshot_id, row.table, row.fingerprint, row.orphan_count))).encode()).hexdigest()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/used/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        """Granted approvals with used_at, null where unused: a row for each decision that a person has taken."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/granted")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{self.SCHEMA}, used_at string")
        out = []
        for row in self.spark.read.schema(self.SCHEMA).parquet(str(path.toString())).distinct().collect():
            marker, fs = self._marker(row)
            used = fs.getFileStatus(marker).getModificationTime() if fs.exists(marker) else None
            out.append((*row, None if used is None else str(used)))
        return self.spark.createDataFrame(out, f"{self.SCHEMA}, used_at string")

    def use(self, decision: DataFrame) -> bool:
        """Whether an unused approval covers the decision, one row; it is used up then."""
        for row in approved(decision, self.read()).select("snapshot_id", "table", "fingerprint", F.col("orphans").alias("orphan_count")).collect():
            marker, fs = self._marker(row)
            try:
                fs.create(marker, False).close()
                return True
            except Py4JJavaError:  # another load was faster
                continue
        return False


def approved(decisions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Decisions that an unused approval of the same snapshot, table, fingerprint and count covers."""
    unused = approvals.where("used_at IS NULL").select("snapshot_id", "table", "fingerprint", F.col("orphan_count").alias("orphans")).distinct()
    return decisions.join(unused, ["snapshot_id", "table", "fingerprint", "orphans"])


def key_gate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row has each key, and no key repeats."""
    c = one_row(rows.agg(F.count("*").alias("n_rows"), F.count_if(~K.complete(keys)).alias("n_incomplete")), K.counts(rows, keys).select("n_duplicates"))
    return c.select(*verdict("keys", [(F.col("n_incomplete") > 0, "keys are missing"), (F.col("n_duplicates") > 0, "keys repeat")]), "n_rows", "n_incomplete", "n_duplicates")


def date_gate(source: DataFrame, target: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """No key has two dates in the source, or another date in the target."""
    inside = K.moving(source, keys, date).agg(F.count("*").alias("n_inside"))
    s, t = source.select(*keys, F.col(date).alias("__date")).distinct().alias("s"), target.select(*keys, date).alias("t")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
    moved = s.join(t, same).where(~F.col("s.__date").eqNullSafe(F.col(f"t.{date}"))).agg(F.count("*").alias("n_moved"))
    return one_row(inside, moved).select(*verdict("dates", [(F.col("n_inside") > 0, "a key has several dates"), (F.col("n_moved") > 0, "a key moves to another date")]), "n_inside", "n_moved")


def snapshot_gate(snapshots: DataFrame) -> DataFrame:
    """snapshots: fetched, written, key_columns: the status that their counts allow."""
    c = F.col
    return snapshots.select("*", *verdict("snapshot", [(c("fetched") <= 0, "nothing was fetched"), (c("key_columns") <= 0, "no key columns"), (c("written") <= 0, "nothing was written"), (c("written") < c("fetched"), "fewer rows were written than fetched")], "validated", "aborted"))


def states(snapshots: DataFrame) -> DataFrame:
    """snapshots: fetched, written, key_columns, and reconciled, whether the target was found to hold the snapshot and no
    more: (state, reason), from writing over validated to reconciled, or aborted."""
    judged = snapshot_gate(snapshots).drop("gate")
    return judged.withColumn("state", F.when((F.col("status") == "validated") & F.col("reconciled"), "reconciled").otherwise(F.col("status"))).drop("status")


def count_gate(fetched: DataFrame, target: DataFrame) -> DataFrame:
    """After a reset the target has as many rows as were fetched, and some."""
    c = one_row(fetched.agg(F.count("*").alias("n_fetched")), target.agg(F.count("*").alias("n_target")))
    return c.select(*verdict("counts", [(F.col("n_fetched") == 0, "source is empty"), (F.col("n_fetched") != F.col("n_target"), "counts differ")]), "n_fetched", "n_target")


def publish_gate(counts: DataFrame) -> DataFrame:
    """counts: fetched, duplicates, filtered, staged, previous (long): whether a staged version may take the table's place. It
    holds each fetched key, nothing was left out, and the source hasn't fallen by more than a tenth."""
    c = F.col
    fell = (c("previous") > 0) & (c("fetched") * 100 < c("previous") * LEAST_SOURCE_PERCENT)
    checks = [(c("fetched") <= 0, "source is empty"), (c("filtered") > 0, "the load dropped rows"), (fell, "source fell by more than a tenth"), (c("staged") != c("fetched") - c("duplicates"), "counts differ")]
    return counts.select("*", *verdict("publish", checks))


def illegal_transitions(events: DataFrame, run: str, status: str, order: Sequence[str]) -> DataFrame:
    """Events whose status may not follow the one before in their run.

    Events are numbered in the order of runs and times by a range sort, and each meets the one before it by an equi-join on
    the number, so that no task holds a run's events."""
    every = numbered(events, run, *order)
    before = every.select((F.col("__number") + 1).alias("__number"), F.col(run).alias("__run"), F.col(status).alias("previous_status"))
    legal = F.lit(False)
    for a, b in TRANSITIONS.items():
        legal = legal | ((F.col("previous_status") == a) & F.col(status).isin(*b))
    met = every.join(before, "__number").where(F.col(run).eqNullSafe(F.col("__run")))
    return met.where(F.col("previous_status").isNotNull() & ~F.coalesce(legal, F.lit(False))).drop("__number", "__run")


def recovery_plan(runs: DataFrame, checkpoints: DataFrame, recovered: DataFrame, large: Sequence[str]) -> DataFrame:
    """(run_id, form_name, eligible, reason): abnormal runs that weren't recovered yet, against their checkpoints."""
    open_ = runs.where("status = 'failed_abnormal_exit'").join(recovered.where("status = 'success'").select(F.col("parent_run_id").alias("run_id")).distinct(), "run_id", "left_anti")
    c = checkpoints.select("form_name", F.col("run_id").alias("owner"), "position")
    both = open_.select("run_id", "form_name").distinct().join(c, "form_name", "left")
    reason = F.when(~F.col("form_name").isin(*large), "not a large table").when(F.col("owner").isNull(), "no checkpoint").when(F.col("owner") != F.col("run_id"), "checkpoint of another run").when(F.col("position") <= 0, "nothing was loaded")
    return both.select("run_id", "form_name", reason.isNull().alias("eligible"), F.coalesce(reason, F.lit("resume")).alias("reason"), F.when(reason.isNull(), F.col("position")).alias("position")).dropDuplicates(["run_id", "form_name"])
