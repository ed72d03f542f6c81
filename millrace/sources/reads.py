"""Bounded and incremental reads: pages, key sets, windows, months, watermarks, manifests."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import keys as K


def offset_page(rows: DataFrame, keys: Sequence[str], start: int, limit: int) -> DataFrame:
    """One page by position, for interactive reads; ``keys`` must be unique."""
    return rows.orderBy(*keys).offset(start).limit(limit)


def keyset_page(rows: DataFrame, keys: Sequence[str], last: Sequence[Any] | None, limit: int) -> DataFrame:
    """The page after a key; the predicate reaches a Parquet scan."""
    rows = rows.where(K.complete(keys))
    if last is not None:
        rows = rows.where(K.after(list(zip(keys, last))))
    return rows.orderBy(*keys).limit(limit)


def in_window(column: str, start: datetime, end: datetime) -> Column:
    """Half-open."""
    if start >= end:
        raise ValueError("a window ends after it starts")
    return (F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (F.col(column) < F.lit(end).cast("timestamp_ntz"))


def watermark(target: DataFrame, column: str, overlap_days: int = 0) -> DataFrame:
    """(mark): the latest change that the target has, less an overlap; replays are harmless, as loads are upserts."""
    return target.agg((F.max(column) - F.expr(f"INTERVAL {int(overlap_days)} DAYS")).alias("mark"))


def changed_since(source: DataFrame, target: DataFrame, column: str, overlap_days: int = 0) -> DataFrame:
    """Source rows later than the target's watermark; all of them if the target is empty."""
    mark = watermark(target, column, overlap_days).first()[0]
    return source if mark is None else source.where(F.col(column) > F.lit(mark).cast("timestamp_ntz"))


def months(frame: DataFrame, start: str, end: str) -> DataFrame:
    """(year, period) of each month from start to end ('yyyy-MM'), both included."""
    each = F.explode(F.sequence(F.to_date(F.lit(f"{start}-01")), F.to_date(F.lit(f"{end}-01")), F.expr("INTERVAL 1 MONTH"))).alias("m")
    return frame.sparkSession.range(1).select(each).select(F.year("m").alias("year"), F.month("m").alias("period"))


def monthly(rows: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Rows of whole months, with year and period."""
    slices = months(rows, start, end)
    dated = rows.withColumns({"year": F.year(date), "period": F.month(date)})
    bound = (F.col(date) >= F.lit(f"{start}-01").cast("timestamp_ntz")) & (F.col(date) < F.expr(f"timestamp_ntz'{end}-01' + INTERVAL 1 MONTH"))
    return dated.where(bound).join(F.broadcast(slices), ["year", "period"])  # a row per month


def closed_period(day: Column) -> tuple[Column, Column]:
    """(year, period) of the month before."""
    before = F.add_months(F.trunc(day, "MM"), -1)
    return F.year(before), F.month(before)


def manifest_faults(tables: DataFrame) -> DataFrame:
    """(table, fault) of each broken rule of a manifest's mappings: manifest_kind, contract_hash, table, target_table,
    primary_key, storage_key, cursor_key, mode."""
    short = F.substring("contract_hash", 1, 8)
    rules = {
        "manifest kind": ~F.col("manifest_kind").isin("window", "cutover"),
        "contract hash": ~F.col("contract_hash").rlike("^[0-9a-f]{64}$"),
        "target table": F.col("target_table") != F.concat("table", F.lit("__next_"), short),
        "primary key": F.size("primary_key") <= 0,
        "storage key": (F.size("storage_key") <= 0) | (F.size(F.array_except("storage_key", "primary_key")) > 0) & (F.col("mode") == "window_supported"),
        "cursor key": (F.col("mode") == "window_supported") & (F.size("cursor_key") <= 0),
    }
    faults = F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()))
    return tables.select("table", F.explode(F.array_compact(faults)).alias("fault"))


def window_mappings(tables: DataFrame, window: str) -> DataFrame:
    """Mappings that can be loaded for a window: of the right mode, with a frozen filter for it."""
    return tables.where("mode = 'window_supported'").withColumn("filter", F.element_at("filters", window)).where("filter IS NOT NULL")


#: What a manifest document holds.
MANIFEST = (
    "manifest_kind string, contract_hash string, migration_tables array<string>, windows array<struct<id: string, start: string, end: string>>, "
    "table_mappings array<struct<form: string, table: string, target_table: string, primary_key: array<string>, storage_key: array<string>, cursor_key: array<string>, mode: string, filters: map<string, string>, default_values: map<string, string>>>"
)


def manifests(documents: DataFrame, body: str) -> tuple[DataFrame, DataFrame]:
    """(mappings, broken) of JSON documents, one manifest in each row's ``body``: a row for each table mapping, with its
    manifest's kind and hash and the other columns of ``documents``; and the documents that are no manifest, with ``fault``:
    text that is no JSON object, or one without table mappings."""
    rest = [c for c in documents.columns if c != body]
    parsed = documents.withColumn("__m", F.from_json(body, MANIFEST, {"mode": "PERMISSIVE"}))
    fault = F.when(F.col("__m").isNull() | ~F.coalesce(F.col(body).rlike(r"^\s*\{"), F.lit(False)), "not a JSON object").when(F.coalesce(F.size("__m.table_mappings"), F.lit(0)) <= 0, "no table mappings")
    judged = parsed.withColumn("fault", fault)
    good = judged.where("fault IS NULL").select(*rest, F.col("__m.manifest_kind").alias("manifest_kind"), F.col("__m.contract_hash").alias("contract_hash"), F.col("__m.windows").alias("windows"), F.explode("__m.table_mappings").alias("t"))
    return good.select(*rest, "manifest_kind", "contract_hash", "windows", "t.*"), judged.where("fault IS NOT NULL").select(*documents.columns, "fault")
