"""Analytics over the history of loads.

runs: run_id, task_name, status, start_time, duration_seconds, total_records, forms (JSON list); run_forms: run_id,
form_name, status, total_records, inserted, failed, created_at; run_events: run_id, form_name, level, message,
created_at. Times are zone-less; what depends on now takes ``as_of``.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import display as D
from millrace.functions import text as X

FAILED = ("failed", "failed_abnormal_exit")
#: Levels as they are written, to levels as they are counted.
LEVELS = {"warn": "WARNING", "warning": "WARNING", "error": "ERROR", "info": "INFO", "debug": "DEBUG"}


def time(x: datetime) -> Column:
    return F.lit(x).cast("timestamp_ntz")


def level(c: Column) -> Column:
    pairs = [F.lit(v) for kv in LEVELS.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.trim(c))], F.upper(F.trim(c)))


def latest(rows: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """The newest row for each key; of equal times that with the highest ``tie``."""
    w = Window.partitionBy(key).orderBy(F.col(stamp).desc(), F.col(tie).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def today(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Counts of the day of ``as_of`` and of the day before, in one pass."""
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    start, status = F.col("start_time"), F.col("status")
    now, before = start >= time(day), (start >= time(day - timedelta(days=1))) & (start < time(day))
    n, m = F.count_if(now), F.count_if(before)
    return runs.agg(
        n.alias("sync_count"), D.percent(F.count_if(now & (status == "success")), n).alias("success_rate"), F.count_if(now & status.isin(*FAILED)).alias("fail_count"),
        F.avg(F.when(now & (F.col("duration_seconds") > 0), F.col("duration_seconds"))).alias("avg_duration"), D.clock(F.max(F.when(now, start)), "time").alias("last_sync_time"),
        F.coalesce(F.sum(F.when(now, F.col("total_records"))), F.lit(0)).alias("total_records"), m.alias("yesterday_count"),
        D.percent(F.count_if(before & (status == "success")), m).alias("yesterday_rate"), F.count_if(status == "running").alias("pending_count"),
    )


def trend(runs: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """One row for each of the last days, zeros where nothing ran, with the change against the day before."""
    last = as_of.date()
    first = last - timedelta(days=days - 1)
    calendar = runs.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    bound = (F.col("start_time") >= time(datetime.combine(first, datetime.min.time()))) & (F.col("start_time") < time(datetime.combine(last + timedelta(days=1), datetime.min.time())))
    daily = runs.where(bound).groupBy(F.to_date("start_time").alias("day")).agg(F.count("*").alias("n"), F.sum("total_records").alias("records"), F.count_if(F.col("status") == "success").alias("good"))
    out = calendar.join(daily, "day", "left").select("day", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "records", "good")))
    # a week of rows
    before = F.lag("n").over(Window.orderBy("day"))
    return out.select("day", D.clock(F.col("day"), "day").alias("label"), "n", "records", F.coalesce(D.percent(F.col("good"), F.col("n")), F.lit(0.0)).alias("success_rate"), D.change_percent(F.col("n"), before).alias("change"))


def top_failures(events: DataFrame, limit: int = 5) -> DataFrame:
    n = max(1, min(20, limit))
    bad = events.withColumn("level", level(F.col("level"))).where(F.col("level").isin("ERROR", "WARNING") & F.col("form_name").isNotNull())
    found = bad.groupBy("form_name").agg(F.count("*").alias("n_errors"), D.shortened(F.max("message")).alias("message"))
    return found.orderBy(F.desc("n_errors"), "form_name").limit(n)


def failure_spread(events: DataFrame) -> DataFrame:
    return events.groupBy(level(F.col("level")).alias("level"), "form_name").agg(F.count("*").alias("n"))


def risks(events: DataFrame, runs: DataFrame, limit: int = 5) -> DataFrame:
    """Forms by their errors and warnings, filled up with runs that failed last."""
    bad = events.withColumn("level", level(F.col("level"))).where(F.col("level").isin("ERROR", "WARNING") & F.col("form_name").isNotNull())
    forms = bad.groupBy(F.col("form_name").cast("string").alias("title")).agg(F.count("*").alias("failure_count"), F.max("created_at").alias("time")).orderBy(F.desc("failure_count"), "title").limit(limit)
    failed = runs.where(F.col("status").isin(*FAILED)).orderBy(F.desc("start_time"), F.desc("run_id")).limit(limit)
    rest = failed.select(F.col("run_id").cast("string").alias("title"), F.lit(1).cast("long").alias("failure_count"), F.col("start_time").alias("time"))
    severity = F.when(F.col("failure_count") >= 10, "high").when(F.col("failure_count") >= 3, "medium").otherwise("low")
    both = forms.withColumn("source", F.lit(1)).unionByName(rest.withColumn("source", F.lit(2)))
    return both.withColumn("severity", severity).orderBy("source", F.desc("failure_count"), F.desc("time"), "title").limit(limit)


def rollup(run_forms: DataFrame) -> DataFrame:
    """A run's totals and status from its forms."""
    good, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") != "success")
    status = F.when(good == 0, "failed").when(bad > 0, "partial").otherwise("success")
    return run_forms.groupBy("run_id").agg(F.count("*").alias("form_count"), good.alias("success_forms"), bad.alias("failed_forms"), F.sum("total_records").alias("total_records"), status.alias("status"), D.whole_percent(good, F.count("*")).alias("progress"))


def by_form(run_forms: DataFrame) -> DataFrame:
    n, good = F.count("*"), F.count_if(F.col("status") == "success")
    return run_forms.groupBy("form_name").agg(n.alias("runs"), F.sum("total_records").alias("fetched"), F.sum("inserted").alias("inserted"), F.sum("failed").alias("errors"), D.percent(good, n).alias("success_rate"), D.rate_text(good, n).alias("rate_text"), D.health(D.percent(good, n)).alias("health"), D.percent_or(F.sum("inserted"), F.sum("total_records"), 100).alias("written_percent"))


def summary(runs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Totals of a range of days."""
    n, good = F.count("*"), F.count_if(F.col("status") == "success")
    within = runs.where((F.col("start_time") >= time(start)) & (F.col("start_time") < time(end)))
    return within.agg(n.alias("runs"), good.alias("success"), F.count_if(F.col("status").isin(*FAILED)).alias("failed"), F.sum("total_records").alias("records"), F.avg("duration_seconds").alias("avg_duration"), D.percent(good, n).alias("success_rate"))


def monitor(runs: DataFrame, recent: int = 100) -> DataFrame:
    """Summary of the latest runs."""
    n, good = F.count("*"), F.count_if(F.col("status") == "success")
    last = runs.orderBy(F.desc("start_time"), F.desc("run_id")).limit(recent)
    return last.agg(n.alias("runs"), good.alias("success"), F.count_if(F.col("status").isin(*FAILED)).alias("failed"), F.coalesce(F.round(F.try_divide(F.sum("total_records"), n)), F.lit(0)).cast("long").alias("records_per_run"), D.health(D.percent(good, n)).alias("health"))


def abnormal(runs: DataFrame, recent: int = 100, limit: int = 5) -> DataFrame:
    """The latest abnormal ones of the latest runs."""
    last = runs.orderBy(F.desc("start_time"), F.desc("run_id")).limit(recent)
    return last.where(F.col("status") != "success").orderBy(F.desc("start_time"), F.desc("run_id")).limit(limit)


def filtered(runs: DataFrame, status: str | None = None, task: str | None = None, start: datetime | None = None, last_day: datetime | None = None) -> DataFrame:
    if status:
        runs = runs.where(F.col("status") == status)
    if task:
        runs = runs.where(F.col("task_name") == task)
    if start:
        runs = runs.where(F.col("start_time") >= time(start))
    if last_day:
        runs = runs.where(F.col("start_time") < time(last_day + timedelta(days=1)))
    return runs


def listed(runs: DataFrame, status: str | None = None, task: str | None = None, start: datetime | None = None, last_day: datetime | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the runs that fit, newest first."""
    size = max(1, min(100, size))
    return filtered(runs, status, task, start, last_day).orderBy(F.desc("start_time"), F.desc("run_id")).offset((max(1, page) - 1) * size).limit(size)


def task_counts(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Runs of each task by state, and those of the day."""
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    status = F.col("status")
    return runs.groupBy("task_name").agg(F.count("*").alias("n"), F.count_if(status == "running").alias("running"), F.count_if(status.isin(*FAILED)).alias("failed"), F.count_if(F.col("start_time") >= time(day)).alias("today"))


def enabled_schedules(jobs: DataFrame) -> DataFrame:
    """(n_jobs, n_enabled); a null flag is off."""
    return jobs.agg(F.count("*").alias("n_jobs"), F.count_if(F.coalesce("enabled", F.lit(False))).alias("n_enabled"))


def sorted_forms(forms: DataFrame, by: str = "name", ascending: bool = True) -> DataFrame:
    """Forms by name, errors or last load; what is missing counts as least."""
    key = {"name": F.col("form_name"), "errors": F.coalesce("n_errors", F.lit(0)), "last": F.coalesce(F.col("last_sync").cast("string"), F.lit(""))}[by]
    return forms.orderBy(key if ascending else key.desc(), "form_name")


def log_tail(events: DataFrame, as_of: datetime, wanted: str | None = None, form: str | None = None, days: int | None = None, limit: int = 50) -> DataFrame:
    """Newest messages first, without secrets."""
    events = events.withColumn("level", level(F.col("level")))
    if wanted:
        events = events.where(F.col("level") == wanted)
    if form:
        events = events.where(F.col("form_name") == form)
    if days:
        events = events.where(F.col("created_at") >= time(as_of - timedelta(days=days)))
    return events.withColumn("message", X.redacted(F.col("message"))).orderBy(F.desc("created_at"), F.desc("run_id")).limit(max(1, min(200, limit)))


def searched(tasks: DataFrame, columns: list[str], keyword: str, status: str | None = None) -> DataFrame:
    found = tasks.where(F.lower(F.concat_ws(" ", *columns)).contains(keyword.lower()))
    return found.where(F.col("status") == status) if status else found


def details(runs: DataFrame, run_forms: DataFrame, events: DataFrame) -> DataFrame:
    """Each run with its forms and its errors, as sorted lists. Nested lists are as long as a run's own rows."""
    forms = run_forms.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("form_name", "status", "total_records"))).alias("forms"))
    errors = events.withColumn("level", level(F.col("level"))).where("level = 'ERROR'").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "form_name", X.redacted(F.col("message")).alias("message")))).alias("errors"))
    return runs.join(forms, "run_id", "left").join(errors, "run_id", "left")


def form_overview(forms: DataFrame, run_forms: DataFrame, runs: DataFrame, events: DataFrame, disabled: DataFrame) -> DataFrame:
    """Every form with its last result, the start of that run, its errors, and whether it is on."""
    last = latest(run_forms, "form_name", "created_at", "run_id").select("form_name", "run_id", F.col("status").alias("last_status"), F.col("total_records").alias("last_records"))
    errors = events.where(level(F.col("level")) == "ERROR").groupBy("form_name").agg(F.count("*").alias("n_errors"))
    off = disabled.select("form_name", F.lit(False).alias("enabled")).distinct()
    out = forms.join(last, "form_name", "left").join(runs.select("run_id", "start_time"), "run_id", "left").join(errors, "form_name", "left").join(off, "form_name", "left")
    return out.select("form_name", "last_status", "last_records", F.col("start_time").alias("last_sync"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.coalesce("enabled", F.lit(True)).alias("enabled"))


def per_form_share(runs: DataFrame) -> DataFrame:
    """A run's records dealt evenly over the forms that its list names."""
    names = X.text_list(F.col("forms"))
    return runs.select("run_id", F.explode(names).alias("form_name"), F.floor(F.col("total_records") / F.greatest(F.size(names), F.lit(1))).cast("long").alias("records"))


def stale(runs: DataFrame, as_of: datetime, minutes: int = 5) -> DataFrame:
    """Runs that are under way and haven't been heard of for a while, as abnormal ones."""
    old = F.col("status").isin("running", "stopping") & (F.col("last_heartbeat") < time(as_of - timedelta(minutes=minutes)))
    return runs.where(old).withColumn("status", F.lit("failed_abnormal_exit"))


def displayed(runs: DataFrame, names: dict[str, str]) -> DataFrame:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return runs.select("run_id", F.coalesce(F.create_map(*pairs)[F.col("task_name")], F.col("task_name")).alias("task"), D.list_text(X.text_list(F.col("forms"))).alias("forms"), D.clock(F.col("start_time"), "short").alias("started"), D.duration_text(F.col("duration_seconds")).alias("took"))
