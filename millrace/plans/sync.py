"""Loads of tables: modes, checks in front of deletes, and many tables in order of priority."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import gates, merge
from millrace.operators import keys as K
from millrace.plans.storage import reliable
from millrace.sources import reads
from millrace.sources.spec import PRIORITY, TableSpec, increment_field, normalize, scan

MODES = ("incremental", "full", "reset", "snapshot", "window")


@dataclass(frozen=True)
class LoadResult:
    """``status``: success, partial (loaded, but rows were left out or orphans stayed), failed or dry_run; ``snapshot``: the
    state of the snapshot that was written, see :func:`millrace.operators.gates.states`; ``unread``: rows with a time that is
    no time, which becomes null; ``absent``: columns of the spec of which no field has landed."""

    name: str
    status: str
    reason: str
    fetched: int
    written: int
    deleted: int
    filtered: int = 0
    snapshot: str = ""
    unread: int = 0
    absent: tuple[str, ...] = ()


def changed_column(spec: TableSpec) -> str | None:
    """The target column of the spec's change field, if the table has it."""
    field = increment_field(spec, {})
    return next((c for c in spec.columns if field in spec.sources(c)), None)


def load(
    table: merge.VersionedTable, spec: TableSpec, landed: DataFrame, mode: str, stamp: str, order: Sequence[Column], changed: str | None = None, overlap_days: int = 0,
    dry_run: bool = False, allow_delete: bool = True, approvals: gates.Approvals | None = None, previous: int = 0,
) -> LoadResult:
    """Load one table. A check that fails changes nothing in front of the write, as versions are committed last.

    window: all rows are merged, see :func:`reload_window`. incremental: rows changed since the target's watermark are merged; ``changed`` is the column that says so, by default
    that of the spec's change field, and without one all rows are merged. full: all rows are merged and orphans deleted, if
    the checks allow. reset and snapshot: the target becomes the source; their reads ignore the watermark. They are staged,
    counted and then published: rows that don't fit, a source that fell by more than a tenth of ``previous``, or a staged
    count other than that of the fetched keys leave the old version in force.

    In the other modes rows with values that don't fit their columns are left out, counted, and keep orphans from being
    deleted, as do rows that the target doesn't hold after the write. Columns of which no field landed keep their values. Where the spec names a date in the key, no key may have two dates, nor
    another date in the target than in the source. ``approvals`` may allow more orphans than go unasked; each is used once.
    ``allow_delete`` is off while a load recovers or stops."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    every = normalize(scan(landed, spec), spec, stamp, bad="__bad", unread="__unread")
    absent = tuple(c for c in spec.columns if c not in every.columns)
    target = table.read(every.drop("__bad", "__unread").schema)
    changed = changed or changed_column(spec)
    if mode == "incremental" and changed:
        every = reads.changed_since(every, target, changed, overlap_days)
    every = reliable(every)
    rows = every.where("NOT __bad").drop("__bad", "__unread")
    counts = gates.one_row(K.counts(rows, spec.keys), rows.agg(F.count_if(~K.complete(spec.keys)).alias("n_incomplete")), every.agg(F.count("*").alias("fetched"), F.count_if("__bad").alias("filtered"), F.count_if("__unread").alias("unread"))).first()

    def result(status: str, reason: str, written: int = 0, deleted: int = 0, snapshot: str = "") -> LoadResult:
        return LoadResult(spec.name, status, reason, counts.fetched, written, deleted, counts.filtered, snapshot, counts.unread, absent)

    if counts.fetched == 0:
        return result("success", "no changes") if mode in ("incremental", "window") else result("failed", "source is empty")
    if counts.n_rows == 0:
        return result("failed", "no row fits the table")
    if counts.n_incomplete:
        return result("failed", "keys are missing")
    if spec.date and mode in ("incremental", "full", "window"):
        dates = gates.date_gate(rows, target, spec.identity, spec.date).first()
        if dates.status != "passed":
            return result("failed", dates.reason)
    if dry_run:
        return result("dry_run", "nothing was written")
    # ``every`` is written already: where no key repeats, its rows needn't be ordered and written again
    single = reliable(merge.last_of_key(rows, spec.keys, order)) if counts.n_duplicates else rows
    replaces = mode in ("reset", "snapshot")
    made = table.stage(single, stored=True) if replaces else None
    if not replaces:
        table.merge(single, spec.keys, stored=True)
    now = table.staged(made) if made else table.read(single.schema)
    written = counts.n_keys - merge.orphans(single, now, spec.keys).count()

    def state(reconciled: bool) -> tuple[str, str]:
        row = gates.states(now.sparkSession.createDataFrame([(counts.n_keys, written, len(spec.keys), reconciled)], "fetched long, written long, key_columns int, reconciled boolean")).first()
        return row.state, row.reason

    if made:
        row = (counts.fetched, counts.n_duplicates, counts.filtered, now.count(), previous)
        checked = gates.publish_gate(now.sparkSession.createDataFrame([row], "fetched long, duplicates long, filtered long, staged long, previous long")).first()
        snapshot, why = state(checked.status == "passed")
        if checked.status != "passed" or snapshot != "reconciled":
            table.discard(made)
            return result("failed", checked.reason if checked.status != "passed" else why, snapshot="aborted")
        table.publish(made)
        return result("success", "replaced", written, 0, snapshot)
    if mode in ("incremental", "window"):
        return result("partial" if counts.filtered else "success", "merged", written, 0, state(False)[0])
    short = written < counts.n_keys
    gone = reliable(merge.orphans(target, rows, spec.keys))
    held = (counts.n_rows, counts.n_duplicates, target.count(), gone.count(), previous, counts.filtered, short)
    known = now.sparkSession.createDataFrame([held], "source long, duplicates long, target long, orphans long, previous long, filtered long, partial boolean")
    decision = gates.orphan_decision(known).first()
    wanted = allow_delete and decision.orphans > 0 and decision.decision != "blocked"
    if wanted and decision.decision == "approval_required":
        # only an approval needs the source's fingerprint
        asked = gates.one_row(known, K.fingerprint(rows, spec.keys)).withColumns({"snapshot_id": F.lit(stamp), "table": F.lit(spec.table_name)})
        wanted = approvals is not None and approvals.use(asked)
    deleted = 0
    if wanted:
        table.delete(gone, spec.keys)
        now, before = table.read(single.schema), now.count()
        deleted = before - now.count()
        left = merge.orphans(now, rows, spec.keys).count()
        if left or deleted != decision.orphans:
            return result("failed", f"{left} rows stayed that should have gone", written, deleted, state(False)[0])
    done = not decision.orphans or wanted
    reason = decision.reason if decision.decision == "blocked" or allow_delete else "orphans stay, as deletes are off"
    return result("success" if done and decision.decision != "blocked" else "partial", reason, written, deleted, state(done and decision.decision != "blocked")[0])


def reload_window(table: merge.VersionedTable, spec: TableSpec, landed: DataFrame, window: str, stamp: str, order: Sequence[Column], defaults: dict[str, str] | None = None) -> LoadResult:
    """Load one window of a table again, by the filter that its manifest has frozen: an SQL predicate over the landed fields,
    which reaches their scan like the spec's own. The window's rows are merged; others, the watermark and orphans are left
    alone, and an empty window writes nothing. ``defaults`` of the manifest give way to the spec's."""
    own = replace(spec, filters=(*spec.filters, window), defaults=(defaults or {}) | spec.defaults)
    return load(table, own, landed, "window", stamp, order)


def run_all(jobs: dict[str, Callable[[], LoadResult]], at_once: int = 8) -> list[LoadResult]:
    """Small tables first, then medium ones, each together; large ones last and one by one. A failure ends one table."""

    def guarded(name: str) -> LoadResult:
        try:
            return jobs[name]()
        except Exception as e:  # noqa: BLE001  the other tables go on
            return LoadResult(name, "failed", str(e).split("\n")[0][:200], 0, 0, 0)

    out: list[LoadResult] = []
    for level in (0, 1, 2):
        names = sorted(n for n in jobs if PRIORITY.get(n, 1) == level)
        with ThreadPoolExecutor(1 if level == 2 else at_once) as pool:
            out += pool.map(guarded, names)
    return out


def results(spark, done: Sequence[LoadResult], run_id: str) -> DataFrame:
    """One row for each table of a run, to append to its history."""
    rows = [(run_id, r.name, r.status, r.reason, r.fetched, r.written, r.deleted, r.filtered, r.snapshot) for r in done]
    return spark.createDataFrame(rows, "run_id string, form_name string, status string, reason string, fetched long, written long, deleted long, filtered long, snapshot string")
