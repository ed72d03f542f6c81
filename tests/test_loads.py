"""Specs, keys, merges, gates, envelopes and whole loads."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import gates, merge
from millrace.operators import keys as K
from millrace.plans import reports, runs, sync
from millrace.plans.storage import shared_folder
from millrace.sources import envelopes, reads
from millrace.sources.spec import TableSpec, increment_field, normalize, priority

COLUMNS = {"FID": "bigint", "NAME": "string", "GROUP_NAME": "string", "QTY": "bigint", "RATE": "decimal(18,4)", "NOTE": "string"}


def sorted_rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def new_table(spark, partition):
    return merge.VersionedTable(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", partition)


def test_mapping(spark):
    raw = spark.createDataFrame([("1", "n ", "g", 12.0, 12.5, None)], "FID string, FNAME string, `FGROUP.FNAME` string, FQTY double, FRATE double, FNOTE string")
    spec = TableSpec("x", raw.columns, COLUMNS, ["FID"], {"FNAME": "NAME", "FGROUP.FNAME": "GROUP_NAME", "FQTY": "QTY", "FRATE": "RATE", "FNOTE": "NOTE"})
    row = normalize(raw, spec, "2024-01-01 00:00:00").first()
    assert (row.FID, row.NAME, row.GROUP_NAME, row.QTY, float(row.RATE), row.NOTE, row.sync_time) == (1, "n", "g", 12, 12.5, None, datetime(2024, 1, 1))


def test_resolution_order_and_faults():
    spec = TableSpec("x", ["name", "NAME", "FNAME", "Group.FName"], {"NAME": "string", "GROUP": "string"}, ["NAME"], {"FNAME": "NAME"})
    assert spec.sources("NAME") == ["NAME", "FNAME", "name"] and spec.sources("GROUP") == ["Group.FName"]
    with pytest.raises(ValueError):
        TableSpec("x", ["a"], {"b": "string"}, ["b"]).resolved()
    with pytest.raises(ValueError):
        TableSpec("x", ["a"], {"a": "string"}, ["a"], cursor=["missing"])
    with pytest.raises(ValueError):
        TableSpec("x", ["a"], {"a; DROP": "string"}, ["a"])
    assert TableSpec("Sales Order", ["a"], {"a": "string"}, ["a"]).table_name == "salesorder"
    assert increment_field(spec, {}) == "FModifyDate" and increment_field(spec, {"x": "FDATE"}) == "FDATE"


def test_defaults(spark):
    raw = spark.createDataFrame([("1", " "), ("2", "v")], "FID string, FNOTE string")
    spec = TableSpec("x", raw.columns, {"FID": "bigint", "NOTE": "string", "AMOUNT": "decimal(18,4)"}, ["FID"], {"FNOTE": "NOTE"}, defaults={"NOTE": ""})
    assert [(r.NOTE, float(r.AMOUNT)) for r in normalize(raw, spec, defaults={"AMOUNT": "0", "NOTE": "m"}).orderBy("FID").collect()] == [("", 0.0), ("v", 0.0)]


def test_priority(spark):
    assert [spark.range(1).select(priority(F.lit(x))).first()[0] for x in ("仓库", "未知", "生产订单主表")] == [0, 1, 2]


def test_keyset(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, 100), (3, None), (4, 200), (10, 20), (10, 21), (11, 1)], "FID int, E int")
    assert sorted_rows(reads.keyset_page(rows, ["FID", "E"], [10, 20], 9)) == [(10, 21), (11, 1)]
    assert sorted_rows(reads.keyset_page(rows, ["FID", "E"], None, 2)) == [(2, 100), (4, 200)]
    rows.write.parquet(str(tmp_path / "k"))
    plan = spark.read.parquet(str(tmp_path / "k")).where(K.after([("FID", 10), ("E", 20)]))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(GreaterThan(FID,10),And(EqualTo(FID,10),GreaterThan(E,20)))]" in plan


def test_window_and_period(spark):
    with pytest.raises(ValueError):
        reads.in_window("x", datetime(2025, 3, 4), datetime(2025, 3, 1))
    year, period = reads.closed_period(F.col("d").cast("date"))
    rows = spark.createDataFrame([("2026-07-30",), ("2026-01-01",)], "d string").select(year.alias("y"), period.alias("p"))
    assert sorted_rows(rows) == [(2025, 12), (2026, 6)]


def test_counts_and_fingerprint(spark):
    rows = spark.createDataFrame([(2, 1), (1, 3), (2, 1), (None, 1), (None, 1)], "a int, b int")
    assert tuple(K.counts(rows, ["a", "b"]).first()) == (5, 3, 2)
    mark = lambda d: K.fingerprint(d, ["a", "b"]).first()[0]
    assert mark(rows) == mark(rows.distinct().repartition(3).orderBy("b")) != mark(rows.where("a = 2"))
    texts = spark.createDataFrame([("a,b", "c")], "a string, b string"), spark.createDataFrame([("a", "b,c")], "a string, b string")
    assert mark(texts[0]) != mark(texts[1])
    assert mark(rows.limit(0)) == mark(rows.where("false"))


def test_page_order(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 3.0), (2, 0, 2.0), (2, 1, 5.0)], "page int, pos int, k double")
    assert sorted_rows(K.out_of_order(rows, ["k"], "page", "pos").select("page", "pos")) == [(0, 1), (2, 0)]


def test_dates_of_keys(spark):
    rows = spark.createDataFrame([(1, "2025-03-31"), (1, "2025-04-01"), (2, "2025-03-31")], "id int, d string")
    assert gates.date_gate(rows, rows.where("id = 2"), ["id"], "d").first().status == "failed"
    assert gates.date_gate(rows.where("id = 2"), rows, ["id"], "d").first().status == "passed"


def test_upsert_twice_is_once_and_keys_split(spark):
    target = spark.createDataFrame([(i, "old") for i in range(10)] + [(None, "old")], "id int, v string")
    source = spark.createDataFrame([(5, "new"), (50, "new"), (None, "new")], "id int, v string")
    once = merge.upsert(target, source, ["id"])
    assert sorted_rows(once) == sorted_rows(merge.upsert(once, source, ["id"])) and once.count() == 12
    gone, kept = merge.orphans(target, source, ["id"]), merge.delete_orphans(target, source, ["id"])
    assert gone.count() + kept.count() == target.count() and merge.delete_keys(target, gone, ["id"]).count() == 2


def test_fragments(spark):
    rows = spark.createDataFrame([(2, "m", "w", "1.5", "b"), (1, "m", "w", "x", "a"), (3, None, "w", None, "c")], "fid int, m string, w string, q string, note string")
    assert sorted_rows(merge.merge_fragments(rows, ["m", "w"], "q", ["fid"]).selectExpr("m", "w", "double(q)", "fid", "note")) == [("m", "w", 1.5, 1, "a"), (None, "w", 0.0, 3, "c")]


def test_versioned_table(spark):
    t = new_table(spark, "p")
    first = spark.createDataFrame([(i, "abc"[i % 3], "v1") for i in range(9)], "id int, p string, v string")
    with pytest.raises(ValueError):
        t.replace(first.limit(0))
    assert t.versions() == [] and t.replace(first) == 1
    old = t.current()
    t.merge(spark.createDataFrame([(0, "a", "v2"), (100, "d", "v2"), (101, None, "v2")], first.schema), ["p", "id"])
    assert t.versions() == [1, 2] and t.read().count() == 11 and t.current()["b"] == old["b"] and t.current()["a"] != old["a"]
    t.delete(spark.createDataFrame([(0, "a"), (7, "b"), (100, "d")], "id int, p string"), ["p", "id"])
    assert sorted(r.id for r in t.read().collect()) == [1, 2, 3, 4, 5, 6, 8, 101]
    with pytest.raises(ValueError):
        t.merge(first, ["id"])


@pytest.mark.parametrize(
    "counts, want",
    [
        ((0, 0, 10, 1, 0, 0, False), "blocked"), ((10, 0, 10, 1, 1, 0, False), "blocked"), ((10, 0, 10, 1, 0, 0, True), "blocked"), ((10, 0, 10, 1, 0, 1, False), "blocked"), ((89, 100, 100, 1, 0, 0, False), "blocked"), ((90, 100, 100, 0, 0, 0, False), "auto_approved"),
        ((9900, 0, 10000, 100, 0, 0, False), "auto_approved"), ((9899, 0, 10000, 101, 0, 0, False), "approval_required"), ((200000, 0, 201001, 1001, 0, 0, False), "approval_required"), ((10, 0, 10, 11, 0, 0, False), "blocked"),
    ],
)
def test_orphan_decision(spark, counts, want):
    row = spark.createDataFrame([counts], "source long, previous long, target long, orphans long, duplicates long, filtered long, partial boolean")
    assert gates.orphan_decision(row).first().decision == want


def test_snapshot_gate(spark):
    rows = spark.createDataFrame([(3, 3, 1), (3, 2, 1), (0, 0, 1), (3, 0, 1), (3, 3, 0)], "fetched int, written int, key_columns int")
    assert [r.status for r in gates.snapshot_gate(rows).collect()] == ["validated"] + ["aborted"] * 4


def test_recovery(spark):
    failed = spark.createDataFrame([("r1", "big", "failed_abnormal_exit"), ("r2", "big", "failed_abnormal_exit"), ("r3", "small", "failed_abnormal_exit"), ("r4", "big", "success"), ("r5", "big", "failed_abnormal_exit")], "run_id string, form_name string, status string")
    marks = spark.createDataFrame([("big", "r1", 120)], "form_name string, run_id string, position int")
    done = spark.createDataFrame([("r5", "success")], "parent_run_id string, status string")
    plan = {r.run_id: (r.eligible, r.reason, r.position) for r in gates.recovery_plan(failed, marks, done, ["big"]).collect()}
    assert plan == {"r1": (True, "resume", 120), "r2": (False, "checkpoint of another run", None), "r3": (False, "not a large table", None)}


def test_transitions(spark):
    rows = spark.createDataFrame([(1, 1, "running"), (1, 2, "stopping"), (1, 3, "stopped"), (1, 4, "running"), (2, 1, "running"), (2, 2, "failed_abnormal_exit")], "run int, at int, status string")
    assert sorted_rows(gates.illegal_transitions(rows, "run", "status", ["at"]).select("run", "at")) == [(1, 4), (2, 2)]


def test_envelopes(spark):
    shapes = ["[]", '[["1","a"],["2"]]', '[[["1","a"],["2","b","more"]]]', '{"Result":{"Rows":[]}}', '{"Result":{"Rows":[{"FID":"1","FNOTE":null},{"FID":"2"}]}}', '[{"Result":{"Rows":[{"FID":"1"}]}}]', '[{"Result":{"Rows":{"FID":"9"}}}]', '[{"FID":"1","FNAME":"x"},{"FID":"2"}]', "oops", '{"a":1}']
    pages = spark.createDataFrame(list(enumerate(shapes)), "page int, body string")
    got = sorted_rows(envelopes.flattened(pages, "body", ["FID", "FNAME"]))
    assert got == sorted([(1, "1", "a"), (1, "2", None), (2, "1", "a"), (2, "2", "b"), (4, "1", None), (4, "2", None), (5, "1", None), (6, "9", None), (7, "1", "x"), (7, "2", None)], key=str)
    assert sorted(r.page for r in envelopes.quarantined(pages, "body").collect()) == [8, 9]


SPEC = TableSpec("orders", ["id", "day", "price"], {"id": "bigint", "day": "string", "price": "decimal(18,4)"}, ["day", "id"])


def landed(spark, rows):
    return spark.createDataFrame(rows, "id string, day string, price string")


def test_full_load_deletes_the_one_orphan(spark):
    t = new_table(spark, "day")
    every = [(str(i), f"d{i % 3}", "1.5") for i in range(101)]
    args = dict(stamp="2024-01-01 00:00:00", order=[F.col("price").desc()])
    assert sync.load(t, SPEC, landed(spark, every), "reset", **args).written == 101
    assert sync.load(t, SPEC, landed(spark, every), "full", dry_run=True, **args).status == "dry_run"
    done = sync.load(t, SPEC, landed(spark, every[:100]), "full", previous=101, **args)
    assert (done.status, done.deleted, t.read().count()) == ("success", 1, 100)
    kept = sync.load(t, SPEC, landed(spark, every[:80]), "full", **args)
    assert (kept.status, kept.deleted, t.read().count()) == ("partial", 0, 100)
    print_of = gates.reconcile_counts(normalize(landed(spark, every[:80]), SPEC), t.read(), SPEC.keys).first().fingerprint
    approvals = gates.Approvals(spark, f"{shared_folder(spark)}/approvals-{uuid.uuid4().hex}")
    assert sync.load(t, SPEC, landed(spark, every[:80]), "full", approvals=approvals, **args).deleted == 0
    approvals.grant(spark.createDataFrame([("2024-01-01 00:00:00", "orders", print_of, 20), ("2024-01-01 00:00:00", "orders", print_of, 21)], gates.Approvals.SCHEMA))
    assert sync.load(t, SPEC, landed(spark, every[:80]), "full", approvals=approvals, **args).deleted == 20
    # the approval is used up, and the one for another count never counts
    sync.load(t, SPEC, landed(spark, every[:100]), "full", **args)
    assert (again := sync.load(t, SPEC, landed(spark, every[:80]), "full", approvals=approvals, **args)).deleted == 0 and again.status == "partial"
    assert sorted(r.used_at is not None for r in approvals.read().collect()) == [False, True]
    sync.load(t, SPEC, landed(spark, every[:80]), "reset", **args)
    assert sync.load(t, SPEC, landed(spark, []), "full", **args).status == "failed" and t.read().count() == 80
    assert sync.load(t, SPEC, landed(spark, [(None, "d1", "1")]), "full", **args).reason == "keys are missing"
    assert sync.load(t, SPEC, landed(spark, [("7", "d1", "9")]), "incremental", **args).status == "success" and t.read().where("id = 7 AND price = 9").count() == 1


def test_whole_numbers_of_any_size(spark):
    raw = spark.createDataFrame([(x,) for x in ("9007199254740993", "9223372036854775807", "-9007199254740993", "12.0", "1.2E1", "12.7", "9223372036854775808", "x", " ", None, " 7 ")], "n string")
    spec = TableSpec("x", ["n"], {"n": "bigint"}, ["n"])
    got = [tuple(r) for r in normalize(raw, spec, bad="bad").collect()]
    assert got == [(9007199254740993, False), (2**63 - 1, False), (-9007199254740993, False), (12, False), (12, False), (None, True), (None, True), (None, True), (None, False), (None, False), (7, False)]


def test_two_loads_at_once_lose_nothing(spark):
    schema = "id int, p string, v string"
    t = new_table(spark, "p")
    t.replace(spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], schema))
    before = t.version()
    other = merge.VersionedTable(spark, t.path, "p")
    other.merge(spark.createDataFrame([(2, "b", "new")], schema), ["p", "id"])
    with pytest.raises(merge.Conflict):
        t.commit(before.folders, before)
    assert sorted_rows(t.read()) == [(1, "a", "old"), (2, "b", "new")] and t.versions() == [1, 2]
    # between a load's read and its commit another one commits: it starts over
    write, meanwhile = merge.VersionedTable._write, []

    def slow(self, rows, touched):
        if not meanwhile:
            meanwhile.append(1)
            other.merge(spark.createDataFrame([(3, "b", "theirs"), (4, "a", "theirs")], schema), ["p", "id"])
        return write(self, rows, touched)

    merge.VersionedTable._write = slow
    try:
        t.merge(spark.createDataFrame([(1, "a", "mine")], schema), ["p", "id"])
    finally:
        merge.VersionedTable._write = write
    assert sorted_rows(t.read()) == [(1, "a", "mine"), (2, "b", "new"), (3, "b", "theirs"), (4, "a", "theirs")] and t.versions() == [1, 2, 3, 4]


def test_keys_to_delete_are_complete_and_unique(spark):
    t = new_table(spark, "p")
    t.replace(spark.createDataFrame([(1, "a"), (2, "a")], "id int, p string"))
    for gone in ([(1, "a"), (1, "a")], [(None, "a")], [(1, " ")]):
        with pytest.raises(ValueError):
            t.delete(spark.createDataFrame(gone, "id int, p string"), ["p", "id"])
    with pytest.raises(ValueError):
        t.delete(spark.createDataFrame([(1,)], "id int"), ["id"])
    assert t.versions() == [1]


def test_few_files_for_each_partition(spark):
    t = merge.VersionedTable(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", "p", file_rows=1_000)
    t.replace(spark.range(6_000).selectExpr("id", "CAST(id % 3 AS STRING) AS p").repartition(16))
    files = spark.read.parquet(*t.current().values()).select("p", F.input_file_name().alias("f")).groupBy("p", "f").count().groupBy("p").agg(F.count("*").alias("files"), F.max("count").alias("most"))
    assert sorted_rows(files) == [(str(i), 2, 1_000) for i in range(3)]


def test_page_order_with_gaps(spark):
    rows = spark.createDataFrame([(0, 0, 5), (2, 0, 3), (7, 0, 9), (7, 1, 10), (40, 0, 10)], "page int, pos int, k int")
    assert sorted_rows(K.out_of_order(rows, ["k"], "page", "pos").select("page", "pos")) == [(2, 0), (40, 0)]


def test_a_date_that_moves_is_refused(spark):
    t = new_table(spark, "day")
    spec = TableSpec("orders", ["id", "day", "price"], {"id": "bigint", "day": "string", "price": "decimal(18,4)"}, ["day", "id"], date="day")
    args = dict(stamp="2024-01-01 00:00:00", order=[F.col("price").desc()])
    sync.load(t, spec, landed(spark, [("1", "d1", "1"), ("2", "d2", "1")]), "reset", **args)
    for rows, why in (([("1", "d2", "2")], "a key moves to another date"), ([("9", "d1", "1"), ("9", "d2", "1")], "a key has several dates")):
        for mode in ("incremental", "full"):
            got = sync.load(t, spec, landed(spark, rows), mode, **args)
            assert (got.status, got.reason, t.versions()) == ("failed", why, [1])
    assert sync.load(t, spec, landed(spark, [("1", "d1", "2")]), "incremental", **args).status == "success"


def test_rows_that_do_not_fit_keep_orphans(spark):
    t = new_table(spark, "day")
    args = dict(stamp="2024-01-01 00:00:00", order=[F.col("price").desc()])
    every = [(str(i), f"d{i % 3}", "1.5") for i in range(200)]
    got = sync.load(t, SPEC, landed(spark, every), "reset", **args)
    assert (got.status, got.snapshot, got.written) == ("success", "reconciled", 200)
    bad = every[:198] + [("5.5", "d1", "1"), ("300", "d1", "cheap")]
    got = sync.load(t, SPEC, landed(spark, bad), "full", **args)
    assert (got.status, got.reason, got.fetched, got.filtered, got.written, got.deleted, got.snapshot) == ("partial", "the load dropped rows", 200, 2, 198, 0, "validated")
    assert t.read().count() == 200
    got = sync.load(t, SPEC, landed(spark, every[:199]), "full", allow_delete=False, **args)
    assert (got.status, got.deleted, got.snapshot, t.read().count()) == ("partial", 0, "validated", 200)
    got = sync.load(t, SPEC, landed(spark, every[:199]), "full", **args)
    assert (got.status, got.deleted, got.snapshot, t.read().count()) == ("success", 1, "reconciled", 199)
    assert sync.load(t, SPEC, landed(spark, [("x", "d1", "1")]), "full", **args).reason == "no row fits the table"


def test_rows_that_were_not_written_keep_orphans(spark, monkeypatch):
    t = new_table(spark, "day")
    args = dict(stamp="2024-01-01 00:00:00", order=[F.col("price").desc()])
    every = [(str(i), f"d{i % 3}", "1.5") for i in range(200)]
    sync.load(t, SPEC, landed(spark, every), "reset", **args)
    put = merge.VersionedTable.merge
    monkeypatch.setattr(merge.VersionedTable, "merge", lambda self, rows, keys, **more: put(self, rows.where("id <> 777"), keys, **more))
    got = sync.load(t, SPEC, landed(spark, every[:199] + [("777", "d1", "1")]), "full", **args)
    assert (got.status, got.reason, got.deleted, got.snapshot) == ("partial", "not all rows were written", 0, "aborted")


def new_positions(spark):
    from millrace.plans import resume

    return resume.Positions(spark, f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}")


def test_large_table_goes_on_where_its_run_was(spark):
    from millrace.plans import resume

    rows = spark.range(100).selectExpr("id", "CAST(id % 4 AS STRING) AS p", "id * 2 AS v")
    t, positions = new_table(spark, "p"), new_positions(spark)
    go = lambda run, ranges=None: resume.load_large(t, "big", rows, ["p", "id"], ["id"], run, positions, 30, ranges)
    assert go("r1", 2).status == "stopped"
    at = positions.get("big")
    assert (at.run, at.rows, at.last) == ("r1", t.read().count(), [at.rows - 1]) and 30 < at.rows < 70
    assert go("r2", 1).status == "stopped" and positions.get("big").run == "r2" and positions.get("big").rows < 40  # not the owner: from the start
    done = go("r2")
    assert (done.status, done.rows, done.skipped) == ("done", 100, 0) and positions.get("big") is None and t.read().count() == 100
    assert len(t.versions()) == 6 and go("r3").rows == 100
    assert resume.load_large(t, "none", rows.where("false"), ["p", "id"], ["id"], "r", positions, 30).status == "done" and positions.get("none") is None


def test_large_table_refuses_repeats_and_counts_missing_keys(spark):
    from millrace.plans import resume

    rows = spark.range(100).selectExpr("id", "CAST(id % 4 AS STRING) AS p", "CASE WHEN id % 20 = 7 THEN id - 1 ELSE id END AS c", "CASE WHEN id % 20 = 7 THEN NULL WHEN id % 20 = 9 THEN ' ' ELSE lpad(CAST(id AS STRING), 4, '0') END AS d")
    t, positions = new_table(spark, "p"), new_positions(spark)
    got = resume.load_large(t, "big", rows, ["p", "id"], ["c"], "r", positions, 9)
    assert (got.status, got.rows, got.repeated, t.versions()) == ("refused", 0, 5, [])
    got = resume.load_large(t, "big2", rows, ["p", "id"], ["d"], "r", positions, 30)
    assert (got.status, got.rows, got.skipped, t.read().count()) == ("partial", 90, 10, 90)
    pairs = spark.createDataFrame([(1, None), (2, "100"), (3, ""), (4, "200")], "FID int, E string").withColumn("p", F.lit("x"))
    got = resume.load_large(new_table(spark, "p"), "big3", pairs, ["p", "FID"], ["FID", "E"], "r", positions, 1)
    assert (got.status, got.rows, got.skipped) == ("partial", 2, 2)


def test_recovery_takes_over_and_fences(spark):
    from millrace.plans import resume

    rows = spark.range(100).selectExpr("id", "CAST(id % 4 AS STRING) AS p", "id * 2 AS v")
    t, positions = new_table(spark, "p"), new_positions(spark)
    resume.load_large(t, "big", rows, ["p", "id"], ["id"], "r1", positions, 30, 2)
    parent = positions.get("big")
    plan = spark.createDataFrame([("r1", "big", True), ("r9", "small", False)], "run_id string, form_name string, eligible boolean")
    assert resume.recover(t, plan, "small", rows, ["p", "id"], ["id"], "c", positions, 30) is None
    with pytest.raises(resume.Fenced):
        positions.take("big", "c", "someone else")
    child = positions.take("big", "c", "r1")
    assert (child.epoch, child.last, child.rows) == (parent.epoch + 1, parent.last, parent.rows)
    with pytest.raises(resume.Fenced):
        positions.move("big", parent, [99], 100)
    # the child fails in its first range: the position stays where the parent left it
    broken = merge.VersionedTable(spark, t.path, "p", 0)
    with pytest.raises(Exception):
        resume.load_large(broken, "big", rows, ["nothing"], ["id"], "c", positions, 30)
    assert positions.get("big") == child
    done = resume.load_large(t, "big", rows, ["p", "id"], ["id"], "c", positions, 30)
    assert (done.status, done.rows) == ("done", 100) and positions.get("big") is None and t.read().count() == 100
    with pytest.raises(resume.Fenced):
        positions.move("big", child, [99], 100)


def test_position_survives_a_torn_write(spark):
    positions = new_positions(spark)
    mine = positions.take("big", "r1")
    mine = positions.move("big", mine, [5], 6)
    folder = f"{positions.path}/big".removeprefix("file:").replace("//", "/")
    open(f"{folder}/.torn", "w").write('{"run": "r')
    assert positions.get("big") == mine
    with pytest.raises(ValueError):
        positions.get("../big")


def test_landing_without_a_column(spark):
    t = new_table(spark, "p")
    t.replace(spark.createDataFrame([(1, "a", "v1", 1), (2, "b", "v2", 2), (3, "a", "v3", 3)], "id int, p string, v string, n int"))
    t.merge(spark.createDataFrame([(1, "a", 10), (4, "a", 40)], "ID int, p string, N bigint"), ["p", "id"])
    assert sorted_rows(t.read()) == [(1, "a", "v1", 10), (2, "b", "v2", 2), (3, "a", "v3", 3), (4, "a", None, 40)]
    t.merge(spark.createDataFrame([(2, "b", "w", "new")], "id int, p string, w string, v string"), ["p", "id"])
    assert sorted_rows(t.read()) == [(1, "a", "v1", 10, None), (2, "b", "new", 2, "w"), (3, "a", "v3", 3, None), (4, "a", None, 40, None)]
    assert [(f.name, f.dataType.simpleString()) for f in t.schema()] == [("id", "int"), ("p", "string"), ("v", "string"), ("n", "bigint"), ("w", "string")] and len(t.version().schemas) == 3
    assert t.columns().count() == 5 and t.read("id int, other date").columns == ["id", "other"]
    before = t.versions()
    with pytest.raises(ValueError, match="column n holds bigint"):
        t.merge(spark.createDataFrame([(1, "a", "x")], "id int, p string, n string"), ["p", "id"])
    assert t.versions() == before
    t.merge(spark.createDataFrame([(1, "a")], "id int, p string").withColumn("v", F.lit(None)), ["p", "id"])
    assert t.read().where("id = 1").first().v == "v1"
    # a reset keeps the column that it lacks, empty
    t.replace(spark.createDataFrame([(9, "z", "n")], "id int, p string, n string"))
    assert sorted_rows(t.read()) == [(9, "z", "n", None, None)]
    t.delete(spark.createDataFrame([(9, "z")], "id int, p string"), ["p", "id"])
    assert t.read().count() == 0 and len(t.read().columns) == 5


def test_deletes_write_keys_and_are_folded_in(spark):
    t = new_table(spark, "p")
    t.replace(spark.range(1000).selectExpr("id", "CAST(id % 3 AS STRING) AS p", "id * 2 AS v"))
    before = t.current()
    t.delete(spark.createDataFrame([(i, str(i % 3)) for i in range(10)], "id bigint, p string"), ["p", "id"])
    t.delete(spark.createDataFrame([(30, "0")], "id int, p string"), ["p", "id"])
    assert t.current() == before and sorted(len(v) for v in t.version().masked.values()) == [1, 1, 2]
    written = [spark.read.parquet(x).count() for x in t.version().deletes]
    assert sorted(written) == [1, 10] and t.read().count() == 989 and t.read("v bigint").count() == 989
    # a key that comes back is there, its partition is written anew, and others keep their deletes
    t.merge(spark.createDataFrame([(3, "0", 7)], "id bigint, p string, v bigint"), ["p", "id"])
    assert t.read().where("id < 10").count() == 1 and sorted(t.version().masked) == ["1", "2"]
    seen = sorted_rows(t.read())
    number = t.compact()
    assert sorted_rows(t.read()) == seen and not t.version().masked and not t.version().deletes and t.compact() == number
    small = merge.VersionedTable(spark, t.path, "p", most_deletes=1)
    for i in (40, 43):
        small.delete(spark.createDataFrame([(i, "1")], "id int, p string"), ["p", "id"])
    assert not small.version().masked and small.read().count() == len(seen) - 2
    t.delete(spark.createDataFrame([(777777, "no such part")], "id int, p string"), ["p", "id"])
    t.replace(spark.createDataFrame([(1, "1", 1)], "id bigint, p string, v bigint"))
    assert t.read().count() == 1


def test_digests_are_kept_and_find_orphans(spark):
    t = new_table(spark, "p")
    rows = spark.range(2000).selectExpr("id", "CAST(id % 5 AS STRING) AS p", "id * 2 AS v")
    t.replace(rows)
    keys = ["p", "id"]
    whole = sorted_rows(K.leaf_digests(rows, keys))
    assert sorted_rows(t.digests(keys)) == whole == sorted_rows(t.digests(keys)) and t.orphans(rows, keys).count() == 0
    places = lambda: {x for x in merge.names(spark, f"{t.path}/digests") if x != "marks"}
    assert len(places()) == 1
    gone = rows.where("id % 500 <> 3")
    assert sorted(r.id for r in t.orphans(gone, keys).collect()) == [3, 503, 1003, 1503] and len(places()) == 1
    assert len(K.different_leaves(t.digests(keys), K.leaf_digests(gone, keys))) <= 4
    # only what was written or deleted since is digested again; values of other columns don't matter
    t.merge(spark.createDataFrame([(3, "3", 0), (5000, "0", 0)], "id bigint, p string, v bigint"), keys)
    t.delete(spark.createDataFrame([(4, "4")], "id bigint, p string"), keys)
    now = rows.where("id <> 4").select(*keys).unionAll(spark.createDataFrame([("0", 5000)], "p string, id bigint"))
    assert sorted_rows(t.digests(keys)) == sorted_rows(K.leaf_digests(now, keys)) and len(places()) == 2
    assert sorted(r.id for r in t.orphans(rows, keys).collect()) == [5000]
    empty = new_table(spark, "p")
    assert empty.digests(keys).count() == 0 and empty.orphans(rows, keys).count() == 0


def test_merge_touches_only_the_buckets_of_its_keys(spark):
    t = merge.VersionedTable(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", None, buckets=8, by=("id",))
    t.replace(spark.range(500).selectExpr("CAST(id AS INT) AS id", "'old' AS v"))
    before = t.current()
    t.merge(spark.createDataFrame([(7, "new"), (5000, "new")], "id bigint, v string"), ["id"])
    changed = [k for k, v in t.current().items() if before.get(k) != v]
    assert len(before) == 8 and 1 <= len(changed) <= 2 and t.read().count() == 501 and t.read().where("v = 'new'").count() == 2
    both = merge.VersionedTable(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}", "v", buckets=2, by=("id",))
    both.replace(t.read())
    assert len(both.current()) in (3, 4) and both.read().count() == 501
    both.drop_partitions(lambda x: x == "new")
    assert sorted_rows(both.read().select("v").distinct()) == [("old",)]
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([("x",)], "v string"), ["v"])
    for bad in ({"partition": None}, {"partition": None, "buckets": 3}, {"partition": "p", "by": ("id",)}):
        with pytest.raises(ValueError):
            merge.VersionedTable(spark, "x", **bad)


def test_retention_of_a_stored_table(spark):
    t = new_table(spark, "day")
    t.replace(spark.range(30).selectExpr("id", "CONCAT('2024-01-', LPAD(CAST(id % 10 + 1 AS STRING), 2, '0')) AS day"))
    t.merge(spark.createDataFrame([(100, "2024-01-10")], "id bigint, day string"), ["day", "id"])
    t.delete(spark.createDataFrame([(9, "2024-01-10")], "id bigint, day string"), ["day", "id"])
    old = t.current()
    t.drop_partitions(lambda day: day < "2024-01-06")
    assert t.read().count() == 15 and all(t.current()[k] == old[k] for k in t.current()) and t.drop_partitions(lambda day: False) == 4
    # within the grace period nothing goes; then what only old versions name
    assert t.expire() == 0 and t.read(number=1).count() == 30
    seen = sorted_rows(t.read())
    assert t.expire(2, timedelta(0)) == 1 and t.versions() == [3, 4] and t.read(number=3).count() == 30
    assert t.expire(1, timedelta(0)) == 5 and t.versions() == [4] and sorted_rows(t.read()) == seen
    t.compact()
    assert t.expire(1, timedelta(0)) == 2 and sorted_rows(t.read()) == seen


def test_types_that_hold_both():
    from pyspark.sql.types import StructType

    kind = lambda a, b: merge.common(*(StructType.fromDDL(f"x {t}").fields[0].dataType for t in (a, b)))
    assert kind("int", "bigint") == "bigint" and kind("bigint", "smallint") == "bigint" and kind("float", "double") == "double" and kind("date", "timestamp_ntz") == "timestamp_ntz"
    assert kind("decimal(10,2)", "decimal(8,6)") == "decimal(14,6)" and kind("int", "decimal(5,3)") == "decimal(13,3)" and kind("decimal(38,0)", "decimal(10,2)") is None
    assert kind("bigint", "double") is None and kind("string", "int") is None and kind("array<int>", "array<int>") == "array<int>"


def test_upserts_that_only_replace_older_rows(spark):
    t = new_table(spark, "p")
    schema = "id int, p string, v string, seq int"
    t.merge(spark.createDataFrame([(1, "a", "x", 5), (2, "a", "x", None), (3, "b", "x", 5)], schema), ["p", "id"], newer="seq")
    t.merge(spark.createDataFrame([(1, "a", "old", 4), (2, "a", "y", 1), (3, "b", "same", 5), (4, "b", "new", None)], schema), ["p", "id"], newer="seq")
    t.merge(spark.createDataFrame([(2, "a", "none", None), (4, "b", "again", None)], schema), ["p", "id"], newer="seq")
    assert sorted_rows(t.read().select("id", "v", "seq")) == [(1, "x", 5), (2, "y", 1), (3, "same", 5), (4, "again", None)]


def test_reset_is_published_only_if_it_is_whole(spark):
    args = dict(stamp="2024-01-01 00:00:00", order=[F.col("price").desc()])
    every = [(str(i), f"d{i % 3}", "1.5") for i in range(100)]
    for mode in ("reset", "snapshot"):
        t = new_table(spark, "day")
        sync.load(t, SPEC, landed(spark, every), mode, **args)
        for rows, more, why in (([("1", "d1", "1")] + [(str(i), "d1", "cheap") for i in range(99)], {}, "the load dropped rows"), (every[:3], {"previous": 100}, "source fell by more than a tenth")):
            got = sync.load(t, SPEC, landed(spark, rows), mode, **args, **more)
            assert (got.status, got.reason, got.snapshot, got.written, t.versions(), t.read().count()) == ("failed", why, "aborted", 0, [1], 100)
        got = sync.load(t, SPEC, landed(spark, every[:90] + every[:5]), mode, previous=100, **args)
        assert (got.status, got.snapshot, got.written, t.read().count()) == ("success", "reconciled", 90, 90)


def test_staged_rows_that_are_lost_are_not_published(spark, monkeypatch):
    t = new_table(spark, "day")
    args = dict(stamp="2024-01-01 00:00:00", order=[F.col("price").desc()])
    sync.load(t, SPEC, landed(spark, [("1", "d1", "1"), ("2", "d2", "1")]), "reset", **args)
    put = merge.VersionedTable._write
    monkeypatch.setattr(merge.VersionedTable, "_write", lambda self, rows, *more: put(self, rows.where("id <> 7"), *more))
    got = sync.load(t, SPEC, landed(spark, [("7", "d1", "1"), ("8", "d1", "1")]), "reset", **args)
    assert (got.status, got.reason, t.versions()) == ("failed", "counts differ", [1])


def test_times_that_are_none_are_counted(spark):
    spec = TableSpec("x", ["id", "at"], {"id": "bigint", "at": "timestamp_ntz", "more": "string"}, ["id"])
    raw = spark.createDataFrame([("1", "2024-01-01"), ("2", "soon"), ("3", " "), ("4", None)], "id string, at string")
    got = sync.load(new_table(spark, "id"), spec, raw, "reset", "2024-01-01 00:00:00", [F.col("id")])
    assert (got.status, got.unread, got.absent, got.filtered) == ("success", 1, ("more",), 0)


def test_numbers_of_any_source_type(spark):
    raw = spark.createDataFrame([(1, 2.0, 3.5, "4", " 5.0 "), (2**62, 1e3, -1.0, "\u00a07", "x"), (None, None, None, None, "\t")], "a bigint, b double, c double, d string, e string")
    spec = TableSpec("x", raw.columns, {"A": "int", "B": "bigint", "C": "bigint", "D": "int", "E": "decimal(18,4)"}, ["A"])
    got = [tuple(x) for x in normalize(raw, spec, bad="bad").collect()]
    assert got == [(1, 2, None, 4, 5, True), (None, 1000, -1, 7, None, True), (None, None, None, None, None, False)]
    plan = normalize(raw.select("d", "e"), TableSpec("x", ["d", "e"], {"D": "int", "E": "decimal(18,4)"}, ["D"]), bad="bad")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2


def test_deep_assembly(spark):
    materials = spark.range(90).selectExpr("id", "CAST(id AS STRING) AS number", "'n' AS name")
    edges = spark.range(1, 90).selectExpr("id AS parent_id", "CAST(id - 1 AS STRING) AS child_number", "0 AS replace_group")
    assert sorted_rows(reports.where_used(edges, materials, "0")) == [(89,)]


def test_stale_stream(spark):
    from millrace.streaming import loads

    home = f"{shared_folder(spark)}/s-{uuid.uuid4().hex}"
    at = lambda minute, hour=11: datetime(2024, 1, 1, hour, minute)
    schema = "run_id string, status string, last_heartbeat timestamp_ntz"
    stale = loads.StaleRuns(merge.VersionedTable(spark, f"{home}/runs", "part"), f"{home}/checkpoint", forget=timedelta(days=7))

    def trigger(rows, now):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{home}/landed")
        return sorted(r.run_id for r in stale.trigger(spark.readStream.schema(schema).parquet(f"{home}/landed"), now).collect())

    assert trigger([("r1", "running", at(50)), ("r1", "running", at(54)), ("r2", "running", at(50)), ("r2", "running", at(59)), ("r3", "running", at(40)), ("r3", "success", at(41)), ("r4", "stopping", at(0)), (None, "running", at(0)), ("r5", "running", None)], at(0, 12)) == ["r1", "r4"]
    # r2 falls silent: an empty trigger finds it, and only once
    assert trigger([], at(30, 12)) == ["r2"] and trigger([], at(31, 12)) == []
    # a run beats again, and a late old heartbeat of it comes alone
    assert trigger([("r1", "running", at(40, 12)), ("r3", "running", at(40))], at(41, 12)) == []
    assert trigger([("r1", "running", at(35, 12))], at(42, 12)) == [] and trigger([], at(50, 12)) == ["r1"]
    # what is over for long is forgotten
    assert stale.table.read().count() == 4 and trigger([("r1", "running", at(0))], datetime(2024, 2, 1)) == [] and stale.table.read().count() == 0


def test_batch_that_the_table_holds_is_not_merged_again(spark):
    t = new_table(spark, "p")
    rows = spark.createDataFrame([(1, "a", "x")], "id int, p string, v string")
    assert t.merge(rows, ["p", "id"], ("s", 0)) == 1 and t.merge(rows, ["p", "id"], ("s", 0)) == 1 and t.merge(rows, ["p", "id"], ("s", 1)) == 2
    assert t.version().batches == {"s": 1} and t.merge(rows, ["p", "id"], ("other", 0)) == 3


def test_groups_run_in_order():
    seen = []

    def job(name):
        def go():
            seen.append(name)
            if name == "b":
                raise RuntimeError("broken")
            return sync.LoadResult(name, "success", "", 1, 1, 0)

        return go

    done = sync.run_all({n: job(n) for n in ("生产订单主表", "b", "仓库")})
    assert seen == ["仓库", "b", "生产订单主表"] and [d.status for d in done] == ["success", "failed", "success"]


def test_where_used_and_prefixes(spark):
    materials = spark.createDataFrame([(i, str(i), "n") for i in range(6)], "id int, number string, name string")
    edges = spark.createDataFrame([(1, "0", 0), (2, "1", 1), (3, "2", 0), (1, "3", 0), (4, "0", None), (5, "4", 0)], "parent_id int, child_number string, replace_group int")
    assert sorted_rows(reports.where_used(edges, materials, "0")) == [(5,)]  # 1, 2 and 3 are a cycle
    assert sorted_rows(reports.where_used(edges, materials, "0", all_edges=False)) == [(1,), (5,)]
    names = spark.createDataFrame([("ab",), ("abc",), ("x",), ("",)], "customer string")
    rows = spark.createDataFrame([("a", 1), ("abc", 2), ("abcd", 4), ("y", 8)], "customer string, fine int")
    assert sorted_rows(reports.prefix_sums(names, rows, "fine")) == [("ab", 7), ("abc", 7)]


def test_stream_that_fails_and_is_replayed(spark):
    from millrace.streaming import loads

    home = f"{shared_folder(spark)}/s-{uuid.uuid4().hex}"
    t = new_table(spark, "p")
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "b", "x")], "id int, p string, v string")
    rows.write.parquet(f"{home}/landed")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{home}/landed")
    for checkpoint in ("one", "two", "two"):  # another checkpoint replays everything
        loads.upsert_stream(stream(), t, ["p", "id"], [F.desc("v")], f"{home}/{checkpoint}").awaitTermination()
    assert sorted_rows(t.read()) == [(1, "a", "y"), (2, "b", "x")] and t.versions() == [1, 2]


def test_stale_and_levels(spark):
    rows = spark.createDataFrame([(1, "running", datetime(2024, 1, 1, 11, 54)), (2, "running", datetime(2024, 1, 1, 11, 56)), (3, "success", datetime(2024, 1, 1))], "run_id int, status string, last_heartbeat timestamp_ntz")
    assert [r.run_id for r in runs.stale(rows, datetime(2024, 1, 1, 12)).collect()] == [1]
    levels = spark.createDataFrame([("WARN",), ("warning",), ("Error",), ("INFO",)], "l string")
    assert [r[0] for r in levels.select(runs.level(F.col("l"))).collect()] == ["WARNING", "WARNING", "ERROR", "INFO"]
