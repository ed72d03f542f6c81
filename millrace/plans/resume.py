"""Large tables: loaded in ranges of their cursor keys, and resumed after a failure where the last range ended, by the run
that owns the position or by one that takes it over."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import keys as K
from millrace.operators import merge
from millrace.plans.storage import create_once, names, reliable


class Fenced(RuntimeError):
    """Another run owns the position by now."""


@dataclass(frozen=True)
class Position:
    """``last``: the last key that was written durably, none at the start; ``rows``: how many so far; ``epoch``: how often the
    position has changed hands; ``open``: off once a load is done."""

    run: str
    epoch: int
    last: list[Any] | None
    rows: int
    open: bool = True


@dataclass(frozen=True)
class Positions:
    """A log of small files for each table: the last one says how far its load is and which run owns it.

    Every change is a file of the next number, written aside and put under its name, which only one writer can take. So a
    crash leaves the position before or the one after, and of two runs that change it at once one is refused."""

    spark: SparkSession
    path: str

    def _log(self, form: str) -> tuple[str, list[int]]:
        folder = f"{self.path}/{K.identifier(form)}"
        return folder, sorted(int(n.removesuffix(".json")) for n in names(self.spark, folder) if n.endswith(".json"))

    def _last(self, form: str) -> tuple[int, Position | None]:
        folder, known = self._log(form)
        if not known:
            return 0, None
        return known[-1], Position(**json.loads(self.spark.read.text(f"{folder}/{known[-1]}.json", wholetext=True).first()[0]))

    def get(self, form: str) -> Position | None:
        """The position of a load that isn't done."""
        found = self._last(form)[1]
        return found if found and found.open else None

    def _put(self, form: str, number: int, new: Position) -> Position:
        folder, known = self._log(form)
        if not create_once(self.spark, folder, f"{number + 1}.json", json.dumps(asdict(new)).encode()):
            raise Fenced(f"the position of {form} was changed by another run")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for old in known[:-1]:
            path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path(f"{folder}/{old}.json"), False)
        return new

    def take(self, form: str, run: str, parent: str | None = None) -> Position:
        """Own the position: as it is, where ``run`` owns it already; that of ``parent``, which is fenced from then on; else
        from the start."""
        number, now = self._last(form)
        if now and now.open and now.run == run:
            return now
        if parent is not None:
            if not now or not now.open or now.run != parent:
                raise Fenced(f"{parent} has no position of {form} to take over")
            return self._put(form, number, Position(run, now.epoch + 1, now.last, now.rows))
        return self._put(form, number, Position(run, (now.epoch if now else 0) + 1, None, 0))

    def move(self, form: str, mine: Position, last: Sequence[Any], rows: int, open_: bool = True) -> Position:
        """The owner's next position; refused if another run has taken it over since."""
        number, now = self._last(form)
        if not now or not now.open or (now.run, now.epoch) != (mine.run, mine.epoch):
            raise Fenced(f"{mine.run} doesn't own the position of {form} any more")
        return self._put(form, number, Position(mine.run, mine.epoch, list(last), rows, open_))


@dataclass(frozen=True)
class LargeLoad:
    """``status``: done, partial (done, but rows without a cursor key were left out), stopped (by ``ranges``) or refused
    (cursor keys repeat: nothing was loaded by this call); ``rows``: loaded so far; ``skipped``: without a complete cursor
    key; ``repeated``: cursor keys that occur more than once."""

    status: str
    rows: int
    skipped: int = 0
    repeated: int = 0


def cut(rows: DataFrame, cursor: Sequence[str], size: int) -> tuple[DataFrame, list]:
    """``rows``, written in ranges of about ``size`` rows by cut points that a sample gives, column ``__range``, and for each
    range (number, n, last key, repeated keys): as many rows as there are ranges."""
    n = rows.count()
    parts = max(1, -(-n // size))
    dealt = rows.repartitionByRange(parts, *cursor).withColumn("__range", F.spark_partition_id()) if parts > 1 else rows.withColumn("__range", F.lit(0))
    stored = reliable(dealt)
    per_key = stored.groupBy("__range", *cursor).agg(F.count("*").alias("n"))
    ends = per_key.groupBy("__range").agg(F.sum("n").alias("n"), F.max(F.struct(*cursor)).alias("last"), F.count_if(F.col("n") > 1).alias("repeated"))
    return stored, ends.orderBy("__range").collect()


def load_large(
    table: merge.VersionedTable, form: str, rows: DataFrame, keys: Sequence[str], cursor: Sequence[str], run: str, positions: Positions, size: int, ranges: int | None = None, parent: str | None = None,
) -> LargeLoad:
    """Merge ``rows`` in ranges of about ``size`` rows in the order of ``cursor``, whose keys are numbers or texts.

    The rows behind the position are cut into ranges once, by all tasks; a range is merged by as many tasks as its size asks
    for. Cursor keys have to be strictly ascending: if any repeats, nothing is loaded. Rows without a complete cursor key
    have no place in that order; they are left out and counted.

    The position is saved after each range is committed and closed at the end, so a run that fails goes on where it was;
    a range that is replayed changes nothing, as merges are upserts. Only the run that owns a position may go on from it:
    another starts over, but a recovery of ``parent``, which takes its position and fences it. ``ranges`` stops early, as a
    time limit does."""
    mine = positions.take(form, run, parent)
    good = K.complete(cursor)
    behind = rows.where(good & K.after(list(zip(cursor, mine.last)))) if mine.last else rows.where(good)
    skipped = rows.where(~good).count()
    stored, ends = cut(behind, cursor, size)
    repeated = sum(e.repeated for e in ends)
    if repeated:
        return LargeLoad("refused", mine.rows, skipped, repeated)
    done = "partial" if skipped else "done"
    for k, end in enumerate(ends):
        if ranges is not None and k >= ranges:
            return LargeLoad("stopped", mine.rows, skipped)
        table.merge(stored.where(F.col("__range") == end["__range"]).drop("__range"), keys, stored=True)
        mine = positions.move(form, mine, list(end.last), mine.rows + end.n, k + 1 < len(ends))
    if not ends:
        positions.move(form, mine, mine.last or [], mine.rows, False)
    return LargeLoad(done, mine.rows, skipped)


def recover(table: merge.VersionedTable, plan: DataFrame, form: str, rows: DataFrame, keys: Sequence[str], cursor: Sequence[str], child: str, positions: Positions, size: int) -> LargeLoad | None:
    """Run what :func:`millrace.operators.gates.recovery_plan` allows for ``form``: ``child`` takes over the position of its
    parent, the form's eligible run, and loads the rest. Orphans are left alone, as a partial read can't tell them. None if
    no run is eligible. The position is closed only by a load that comes to its end."""
    found = plan.where((F.col("form_name") == form) & F.col("eligible")).select("run_id").first()
    return None if found is None else load_large(table, form, rows, keys, cursor, child, positions, size, parent=str(found.run_id))
