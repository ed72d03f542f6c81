"""Composite keys: null-safe comparison, keyset predicates, counts, fingerprints, order checks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.storage import numbered

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifier(name: str) -> str:
    """``name`` if it may stand in SQL unquoted."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(rf"\A{_NAME.pattern}\z"), F.lit(False))


def anti(left: DataFrame, right: DataFrame, keys: Sequence[str], unique: bool = False) -> DataFrame:
    """Rows of ``left`` whose key ``right`` doesn't have; null keys equal each other. Planned as an equi-join. ``unique``: no
    key of ``right`` repeats, so that its keys needn't be grouped first."""
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys))
    r = r if unique else r.distinct()
    return left.join(r, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "left_anti")


def semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    return left.join(r, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "left_semi")


def after(last: Sequence[tuple[str, Any]]) -> Column:
    """Rows strictly after the key ``last`` in the order of its columns, as conjunctions that a Parquet scan can use."""
    terms = []
    for i, (name, value) in enumerate(last):
        before = [F.col(k) == F.lit(v) for k, v in last[:i]]
        terms.append(reduce(Column.__and__, [*before, F.col(name) > F.lit(value)]))
    return reduce(Column.__or__, terms)


def complete(keys: Sequence[str]) -> Column:
    """All keys are there and not blank."""
    return reduce(Column.__and__, (F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "") for k in keys))


def counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n_rows, n_keys, n_duplicates): nulls are key values like others. Grouped, so that distinct keys don't meet."""
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def encoded(keys: Sequence[str]) -> Column:
    """A key as text: its values with their lengths, null apart from blank."""
    part = lambda k: F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-"))
    return F.concat_ws(",", *map(part, keys))


def fingerprint(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(fingerprint): one digest for a set of keys, whatever their order and repetition.

    A tree: keys' digests are digested by their first six hex digits, those by their first three, and those together. The
    digests spread evenly, so even a thousand thousand million keys make lists of some ten thousand each."""
    level = rows.select(F.sha2(encoded(keys), 256).alias("d")).distinct().select(F.left("d", F.lit(6)).alias("b"), "d")
    digest = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: F.concat(x["b"], F.lit("="), x["d"])), "\n"), 256)
    low = level.groupBy("b").agg(digest.alias("d"))
    middle = low.groupBy(F.left("b", F.lit(3)).alias("p")).agg(digest.alias("d")).select(F.col("p").alias("b"), "d")
    return middle.agg(digest.alias("fingerprint"))


#: Leaves that a key set's digests are kept in.
LEAVES = 4096


def leaf(keys: Sequence[str], leaves: int = LEAVES) -> Column:
    """The leaf that a key belongs to."""
    return F.pmod(F.xxhash64(F.lit(2), encoded(keys)), F.lit(leaves)).cast("int")


def leaf_digests(rows: DataFrame, keys: Sequence[str], *by: Column) -> DataFrame:
    """(*by, leaf, n, sum, xor): for each leaf the number of its keys and two sums of their hashes, whatever their order.
    Digests of disjoint sets add up. A key that repeats counts each time."""
    total = F.sum(F.xxhash64(F.lit(0), encoded(keys)).cast("decimal(38,0)"))
    return rows.groupBy(*by, leaf(keys).alias("leaf")).agg(F.count("*").alias("n"), total.alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), encoded(keys))).alias("xor"))


def added_digests(parts: DataFrame) -> DataFrame:
    """Digests of a whole from those of its disjoint parts."""
    return parts.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("sum").cast("decimal(38,0)").alias("sum"), F.bit_xor("xor").alias("xor"))


def different_leaves(one: DataFrame, other: DataFrame) -> list[int]:
    """The leaves in which two sets differ, by their digests: as many numbers as there are leaves, at most."""
    both = one.unionAll(other.select("leaf", "n", (-F.col("sum")).alias("sum"), "xor").withColumn("n", -F.col("n")).select(*one.columns))
    left = both.groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.bit_xor("xor").alias("xor"))
    return sorted(r["leaf"] for r in left.where("n <> 0 OR sum <> 0 OR xor <> 0").select("leaf").collect())


def out_of_order(rows: DataFrame, keys: Sequence[str], page: str, position: str) -> DataFrame:
    """Rows whose key isn't greater than that of the row before, in the order of pages and positions.

    Within a page a window compares neighbours. Across pages only each page's first and last key meet: the pages that there
    are, a row each, are numbered by a range sort, as their own numbers may have gaps, and neighbours meet by an equi-join."""
    key = F.struct(*keys)
    inside = rows.withColumn("__last", F.lag(key).over(Window.partitionBy(page).orderBy(position)))
    ends = rows.groupBy(page).agg(F.min_by(key, position).alias("__first"), F.max_by(key, position).alias("__end"), F.min(position).alias("__at"))
    ends = numbered(ends, page)
    across = ends.join(ends.select((F.col("__number") + 1).alias("__number"), F.col("__end").alias("__last")), "__number").where(F.col("__first") <= F.col("__last"))
    bad_first = rows.join(across.select(page, F.col("__at").alias(position)), [page, position], "left_semi")
    return inside.where(key <= F.col("__last")).drop("__last").unionByName(bad_first)


def moving(rows: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Keys that have more than one date."""
    return rows.groupBy(*keys).agg(F.count_distinct(date).alias("n_dates")).where("n_dates > 1")
