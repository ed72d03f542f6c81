"""Upserts, deletes and loads of keyed tables, and their storage as versions of Parquet partitions."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from millrace.operators import keys as K
from millrace.plans.storage import create_once, names, reliable


def last_of_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``, which must be total to be deterministic."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows replace target rows of their key; ``source`` has one row for each key."""
    return K.anti(target, source, keys, unique=True).unionByName(source, allowMissingColumns=True)


def orphans(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the target that the source doesn't have, each once; null keys equal each other.

    Both sides' keys are grouped together: one shuffle, in which repeated keys are combined first, and no sort."""
    t, s = target.select(*keys), source.select(*keys)
    if [f.dataType for f in t.schema] != [f.dataType for f in s.schema]:
        return K.anti(t.distinct(), s, keys)
    both = t.withColumn("__held", F.lit(False)).unionAll(s.withColumn("__held", F.lit(True)))
    return both.groupBy(*keys).agg(F.bool_or("__held").alias("__held")).where("NOT __held").drop("__held")


def delete_keys(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return K.anti(target, gone, keys)


def delete_orphans(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return K.semi(target, source, keys)


def purge_zero(rows: DataFrame, quantity: str) -> DataFrame:
    """Without rows of quantity 0; null quantities stay."""
    return rows.where(~F.col(quantity).eqNullSafe(F.lit(0)))


def merge_fragments(rows: DataFrame, keys: Sequence[str], quantity: str, order: Sequence[str], kind: str = "decimal(18,4)") -> DataFrame:
    """One row for each key: quantities summed, unreadable ones as 0, other columns from the first row in ``order``."""
    rest = [c for c in rows.columns if c not in (*keys, quantity)]
    amount = F.coalesce(F.col(quantity).cast("string").try_cast(kind), F.lit(0).cast(kind))
    merged = rows.groupBy(*keys).agg(F.sum(amount).alias(quantity), F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return merged.select(*keys, quantity, *(F.col(f"__first.{c}").alias(c) for c in rest))


def lenient(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """``rows`` cast to ``types`` with a column ``bad``: a value that is there doesn't fit its type."""
    cast = {c: F.col(c).cast("string").try_cast(t) for c, t in types.items()}
    bad = F.lit(False)
    for c, x in cast.items():
        bad = bad | (F.col(c).isNotNull() & x.isNull())
    return rows.select(*(cast[c].alias(c) if c in cast else F.col(c) for c in rows.columns), bad.alias("bad"))


def load_counts(rows: DataFrame) -> DataFrame:
    """(total, loaded, filtered) of a lenient load."""
    return rows.agg(F.count("*").alias("total"), F.count_if(~F.col("bad")).alias("loaded"), F.count_if(F.col("bad")).alias("filtered"))


def retained(rows: DataFrame, stamp: str, cutoff: Column) -> DataFrame:
    """Old rows go away."""
    return rows.where(F.col(stamp) >= cutoff)


def soft_deleted(rows: DataFrame, stamp: str, cutoff: Column, now: Column) -> DataFrame:
    """Old rows get a deletion time instead of going away."""
    return rows.withColumn("deleted_at", F.when(F.col(stamp) < cutoff, now))


#: Decimal digits of the whole numbers' types.
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def common(a: DataType, b: DataType) -> str | None:
    """The least type that holds all values of both, if there is one that loses nothing."""
    x, y = a.simpleString(), b.simpleString()
    if x == y:
        return x
    for one, two in ((x, y), (y, x)):
        if one == "void" or (one, two) in (("float", "double"), ("date", "timestamp_ntz")):
            return two
    if x in _DIGITS and y in _DIGITS:
        return max(x, y, key=_DIGITS.__getitem__)
    sizes = [(_DIGITS[t.simpleString()], 0) if t.simpleString() in _DIGITS else (t.precision - t.scale, t.scale) if t.typeName() == "decimal" else None for t in (a, b)]
    if None in sizes:
        return None
    whole, scale = (max(v) for v in zip(*sizes))
    return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else None


def widened(stored: StructType | None, landed: StructType) -> StructType:
    """The columns of a table after ``landed`` rows: those it has, in types that hold both, and new ones behind them. Names
    meet without regard to case. A column whose values the stored type and the landed one can't both hold is refused."""
    fields = {f.name.lower(): StructField(f.name, f.dataType) for f in (stored or StructType())}
    for f in landed:
        own = fields.setdefault(f.name.lower(), StructField(f.name, f.dataType))
        kind = common(own.dataType, f.dataType)
        if kind is None:
            raise ValueError(f"column {own.name} holds {own.dataType.simpleString()}, and {f.dataType.simpleString()} has landed")
        if kind != own.dataType.simpleString():
            fields[f.name.lower()] = StructType.fromDDL(f"`{own.name}` {kind}").fields[0]
    return StructType(list(fields.values()))


def conformed(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` in the columns of ``schema``; those that they lack are null."""
    own = {c.lower(): c for c in rows.columns}
    return rows.select(*((F.col(f"`{own[f.name.lower()]}`") if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def upsert_columns(target: DataFrame, source: DataFrame, keys: Sequence[str], newer: str | None = None) -> DataFrame:
    """Source rows, one for each key, replace the target's in the columns that they have; columns that they lack keep the
    target's values, and are null for new keys. With ``newer``, a column that both have, a row replaces only one in which it
    isn't greater; a null there is less than any value."""
    has = {c.lower() for c in source.columns}
    absent = [c for c in target.columns if c.lower() not in has]
    fresh = conformed(source, StructType([f for f in target.schema if f.name.lower() in has]))
    if absent or newer:
        before = target.select(*(F.col(k).alias(f"__key_{k}") for k in keys), *absent, *([F.col(newer).alias("__newer")] if newer else []))
        met = fresh.join(before, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys)), "left")
        if newer:
            met = met.where(F.col("__newer").isNull() | F.coalesce(F.col(newer) >= F.col("__newer"), F.lit(False)))
        fresh = reliable(met.select(*target.columns))
    return upsert(target, fresh, keys)


#: How often a load starts over when others are faster.
ATTEMPTS = 5


class Conflict(RuntimeError):
    """Another load has written a version since this one read the table."""


@dataclass(frozen=True)
class Version:
    """``number``: 0 where the table has none yet; ``folders``: partition value to folder; ``batches``: stream to the last of
    its batches that the table holds; ``schemas``: each schema that the table has had, as JSON, the current one last;
    ``layout``: partition value to the number of the schema that its files were written with; ``deletes``: folders of keys that
    were deleted, to the columns of the keys; ``masked``: partition value to those of them that hold for its files."""

    number: int
    folders: dict[str, str]
    batches: dict[str, int]
    schemas: list[str] = field(default_factory=list)
    layout: dict[str, int] = field(default_factory=dict)
    deletes: dict[str, list[str]] = field(default_factory=dict)
    masked: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Staged:
    """Folders of a version that isn't published: nobody reads them yet."""

    folders: dict[str, str]
    schema: StructType
    place: str


@dataclass(frozen=True)
class VersionedTable:
    """A table of Parquet folders, one for each partition and version, and manifests that name the current ones and the
    table's schema.

    A load reads a version, writes new folders for the partitions that it touches, and then the manifest of the next number,
    under a name that only one writer can take. If another load has taken it meanwhile, nothing is lost: this one reads the
    table again and starts over, some times, or fails. Readers take the last manifest, so a failed load changes nothing, and
    old readers keep theirs. Columns are the manifest's: no file's footer decides them, and a landing that lacks some leaves
    their values as they are. Deletes write their keys, which readers leave out until a compaction or a later merge of the
    partition has folded them in.

    Partitions are the values of a column, or, with ``buckets``, each value's ``buckets`` parts by the hash of the columns
    ``by``: a merge of few keys then reads and writes their buckets only. A table without a partition column has buckets
    alone."""

    spark: SparkSession
    path: str
    partition: str | None
    #: Rows of a file at most.
    file_rows: int = 10_000_000
    buckets: int = 0
    by: tuple[str, ...] = ()
    #: A delete that brings a partition's delete sets to more than this compacts it.
    most_deletes: int = 16

    def __post_init__(self):
        if not self.partition and not self.buckets or bool(self.buckets) != bool(self.by):
            raise ValueError("a table has a partition column, or buckets by some columns, or both")

    def _needed(self, keys: Sequence[str]) -> None:
        for c in (*([self.partition] if self.partition else []), *self.by):
            if c not in keys:
                raise ValueError(f"{c} is not part of the key")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/manifests") if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """The last version, or that of ``number``, while it is kept."""
        if number is None:
            number = max(self.versions(), default=0)
        if not number:
            return Version(0, {}, {})
        text = self.spark.read.text(f"{self.path}/manifests/{number}.json", wholetext=True).first()[0]
        return Version(number, **json.loads(text))

    def current(self) -> dict[str, str]:
        """Partition value to folder."""
        return self.version().folders

    def schema(self, now: Version | None = None) -> StructType | None:
        """The table's columns; none before its first version."""
        now = now or self.version()
        if now.schemas:
            return StructType.fromJson(json.loads(now.schemas[-1]))
        return self.spark.read.parquet(*now.folders.values()).schema if now.folders else None

    def columns(self) -> DataFrame:
        """(column, type, nullable) of the table as it is read: columns of files may all be null."""
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), True) for f in self.schema() or ()], "column string, type string, nullable boolean")

    def _rows(self, now: Version, folders: dict[str, str], schema: StructType) -> DataFrame:
        """Rows of some partitions in the columns of ``schema``, each file read by the schema that it was written with, without
        the keys that were deleted since."""
        by: dict[tuple, set[str]] = {}
        for value, folder in folders.items():
            by.setdefault((now.layout.get(value, -1), tuple(now.masked.get(value, ()))), set()).add(folder)
        own, parts = self.schema(now), []
        for (k, masks), found in sorted(by.items()):
            reader = self.spark.read.schema(StructType.fromJson(json.loads(now.schemas[k]))) if k >= 0 else self.spark.read
            rows = reader.parquet(*sorted(found))
            sets: dict[tuple[str, ...], list[str]] = {}
            for m in masks:
                sets.setdefault(tuple(now.deletes[m]), []).append(m)
            for keys, paths in sets.items():
                kinds = StructType([own[k] for k in keys])
                rows = K.anti(conformed(rows, own), reduce(DataFrame.unionAll, (conformed(self.spark.read.parquet(p), kinds) for p in paths)), keys)
            parts.append(conformed(rows, schema))
        return reduce(DataFrame.unionAll, parts)

    def read(self, schema: StructType | str | None = None, number: int | None = None) -> DataFrame:
        """The last version, or that of ``number``, in the table's own columns or in those of ``schema``."""
        now = self.version(number)
        own, wanted = self.schema(now), StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not now.folders:
            return self.spark.createDataFrame([], wanted or own)
        return self._rows(now, now.folders, wanted or own)

    def commit(self, folders: dict[str, str], read: Version, batch: tuple[str, int] | None = None, schema: StructType | None = None, written: Sequence[str] = (), gone: tuple[str, Sequence[str], Sequence[str]] | None = None) -> int:
        """The version after ``read``, if no other load has written it. ``batch``: a stream and the batch that it now holds.
        ``written``: partitions whose files have ``schema``, which becomes the table's. ``gone``: a folder of deleted keys, their
        columns, and the partitions that they are in."""
        schemas, layout = list(read.schemas), dict(read.layout)
        if schema is not None:
            if not schemas or schemas[-1] != schema.json():
                schemas.append(schema.json())
            layout |= dict.fromkeys(written, len(schemas) - 1)
        masked = {k: v for k, v in read.masked.items() if k in folders and k not in written}
        if gone:
            masked |= {k: [*masked.get(k, []), gone[0]] for k in gone[2]}
        held = {m for v in masked.values() for m in v}
        deletes = {k: v for k, v in (read.deletes | ({gone[0]: list(gone[1])} if gone else {})).items() if k in held}
        number = read.number + 1
        manifest = {"folders": folders, "batches": read.batches | dict([batch] if batch else []), "schemas": schemas, "layout": {k: v for k, v in layout.items() if k in folders}, "deletes": deletes, "masked": masked}
        if not create_once(self.spark, f"{self.path}/manifests", f"{number}.json", json.dumps(manifest, sort_keys=True).encode()):
            raise Conflict(f"version {number} of {self.path} was written by another load")
        return number

    def _retried(self, attempt: Callable[[Version], int]) -> int:
        """``attempt`` on the current version, and again on the next where another load was faster."""
        for left in range(ATTEMPTS - 1, -1, -1):
            try:
                return attempt(self.version())
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def _value(self) -> Column:
        parts = [F.coalesce(F.col(self.partition).cast("string"), F.lit("__null__"))] if self.partition else []
        if self.buckets:
            # of texts, so that a number's type doesn't matter
            parts.append(F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in self.by)), F.lit(self.buckets)).cast("string"))
        return F.concat_ws("#", *parts)

    def _write(self, rows: DataFrame, touched: Sequence[str], place: str | None = None) -> dict[str, str]:
        """New folders for ``touched`` partitions."""
        place = place or f"{self.path}/data/{uuid.uuid4().hex}"
        # each partition goes to one task, or to several where it is large, and so gets few files of a good size; the
        # partition's column stays inside its files too
        dealt = rows.withColumn("__part", self._value()).hint("rebalance", F.col("__part"))
        dealt.write.option("maxRecordsPerFile", self.file_rows).partitionBy("__part").parquet(place)
        fs = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        found = {}
        for x in touched:
            folder = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("__part", x)
            if fs.exists(path(f"{place}/{folder}")):
                found[x] = f"{place}/{folder}"
        return found

    def touched(self, rows: DataFrame) -> list[str]:
        """The partition values of ``rows``: as many as there are partitions, not rows."""
        return sorted(r[0] for r in rows.select(self._value()).distinct().collect())

    def stage(self, rows: DataFrame, stored: bool = False) -> Staged:
        """Write ``rows`` as all of the table, to be looked at before :meth:`publish`; an empty load is refused. Columns of the
        table that they lack stay and are null; those that they have take their types. ``stored``: rows are a written table
        already."""
        rows = rows if stored else reliable(rows)
        touched = self.touched(rows)
        if not touched:
            raise ValueError("refusing to replace a table with nothing")
        has = {f.name.lower() for f in rows.schema}
        kept = [f for f in self.schema() or () if f.name.lower() not in has]
        schema, place = StructType([*(StructField(f.name, f.dataType) for f in rows.schema), *kept]), f"{self.path}/data/{uuid.uuid4().hex}"
        return Staged(self._write(conformed(rows, schema), touched, place), schema, place)

    def staged(self, made: Staged) -> DataFrame:
        return self.spark.read.schema(made.schema).parquet(*sorted(made.folders.values()))

    def publish(self, made: Staged) -> int:
        """What was staged becomes the table, whatever others have written meanwhile."""
        return self._retried(lambda now: self.commit(made.folders, now, None, made.schema, list(made.folders)))

    def discard(self, made: Staged) -> None:
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(made.place), True)

    def replace(self, rows: DataFrame, stored: bool = False) -> int:
        """All of the table becomes ``rows``, see :meth:`stage`."""
        return self.publish(self.stage(rows, stored))

    def merge(self, rows: DataFrame, keys: Sequence[str], batch: tuple[str, int] | None = None, stored: bool = False, newer: str | None = None) -> int:
        """Upsert ``rows``, whose keys hold the partition, reading and writing the partitions that they touch.

        Stored values of columns that ``rows`` lack stay; columns that the table lacks are added, and types are widened where
        that loses nothing, else the merge is refused. ``newer``: a column by which a row replaces only one that isn't newer,
        see :func:`upsert_columns`. ``batch``: a stream and the number of its batch; a batch that the table holds already
        isn't merged again. ``stored``: rows are a written table already."""
        self._needed(keys)
        rows = rows.drop(*(f.name for f in rows.schema if f.dataType.simpleString() == "void"))
        rows = rows if stored else reliable(rows)
        touched = self.touched(rows)

        def attempt(now: Version) -> int:
            if batch and now.batches.get(batch[0], -1) >= batch[1]:
                return now.number
            schema = widened(self.schema(now), rows.schema)
            old = {x: now.folders[x] for x in touched if x in now.folders}
            merged = upsert_columns(self._rows(now, old, schema), rows, keys, newer) if old else conformed(rows, schema)
            folders = self._write(merged, touched)
            return self.commit({k: v for k, v in now.folders.items() if k not in touched} | folders, now, batch, schema, list(folders))

        return self._retried(attempt)

    def delete(self, gone: DataFrame, keys: Sequence[str]) -> int:
        """Rows with the keys of ``gone`` go away. The keys hold the partition, and none may be missing or occur twice. What is
        written are the keys; partitions with many such sets are compacted."""
        self._needed(keys)
        place, own = f"{self.path}/deletes/{uuid.uuid4().hex}", {f.name.lower(): f.name for f in self.schema() or ()}
        keys = [own.get(k.lower(), k) for k in keys]
        rows = gone.select(*keys)
        rows.write.parquet(place)
        gone = self.spark.read.schema(rows.schema).parquet(place)
        if not gone.where(~K.complete(keys)).isEmpty():
            raise ValueError("keys to delete are missing")
        if K.counts(gone, keys).first().n_duplicates:
            raise ValueError("keys to delete repeat")
        asked = self.touched(gone)

        def attempt(now: Version) -> int:
            touched = [x for x in asked if x in now.folders]
            return self.commit(now.folders, now, None, self.schema(now), (), (place, keys, touched)) if touched else now.number

        number = self._retried(attempt)
        full = [k for k, v in self.version().masked.items() if len(v) > self.most_deletes]
        return self.compact(full) if full else number

    def compact(self, values: Sequence[str] | None = None) -> int:
        """Fold deleted keys into the files of all partitions that have any, or of ``values``; what readers see doesn't change."""

        def attempt(now: Version) -> int:
            due = {k: now.folders[k] for k in now.masked if values is None or k in values}
            if not due:
                return now.number
            schema = self.schema(now)
            folders = self._write(self._rows(now, due, schema), list(due))
            return self.commit({k: v for k, v in now.folders.items() if k not in due} | folders, now, None, schema, list(due))

        return self._retried(attempt)

    def drop_partitions(self, gone: Callable[[str], bool]) -> int:
        """Partitions whose value ``gone`` says so of go away: a new manifest, and no file is read or written."""

        def attempt(now: Version) -> int:
            left = {k: v for k, v in now.folders.items() if not gone(k.split("#")[0] if self.partition and self.buckets else k)}
            return now.number if left == now.folders else self.commit(left, now)

        return self._retried(attempt)

    def expire(self, keep: int = 1, grace: timedelta = timedelta(days=7)) -> int:
        """Forget all but the last ``keep`` versions and those that are younger than ``grace``, and delete the folders that no
        version left names, unless they are younger too: a load may be about to name them. How many folders went away."""
        fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        oldest = (time.time() - grace.total_seconds()) * 1000
        young = lambda p: fs.getFileStatus(p).getModificationTime() > oldest
        known = self.versions()
        for n in known[: max(0, len(known) - max(1, keep))]:
            if not young(path(f"{self.path}/manifests/{n}.json")):
                fs.delete(path(f"{self.path}/manifests/{n}.json"), False)
        named = set()
        for n in self.versions():
            v = self.version(n)
            named |= {*v.folders.values(), *v.deletes}
        tail = lambda p: "/".join(str(p).rstrip("/").split("/")[-3:])  # noqa: E731  however the store writes a path's beginning
        kept, count = {tail(x) for x in named}, 0
        for pattern in ("data/*/__part=*", "deletes/*"):
            for x in fs.globStatus(path(f"{self.path}/{pattern}")) or ():
                if tail(x.getPath().toString()) not in kept and not young(x.getPath()):
                    fs.delete(x.getPath(), True)
                    count += 1
        return count

    def digests(self, keys: Sequence[str]) -> DataFrame:
        """:func:`millrace.operators.keys.leaf_digests` of the last version's keys, kept for each partition's files: only
        partitions that were written since the last call are read."""
        now = self.version()
        token = {k: hashlib.sha256(json.dumps([v, now.masked.get(k, []), list(keys)]).encode()).hexdigest() for k, v in now.folders.items()}
        kept = set(names(self.spark, f"{self.path}/digests/marks"))
        fresh = {k: v for k, v in now.folders.items() if token[k] not in kept}
        if fresh:
            place = f"{self.path}/digests/{uuid.uuid4().hex}"
            rows = self._rows(now, fresh, self.schema(now)).withColumn("__part", self._value())
            K.leaf_digests(rows, keys, F.col("__part")).write.parquet(place)
            for k in fresh:
                create_once(self.spark, f"{self.path}/digests/marks", token[k], json.dumps({"place": place, "part": k}).encode())
        if not token:
            return self.spark.createDataFrame([], "leaf int, n long, sum decimal(38,0), xor long")
        marks = [json.loads(r[0]) for r in self.spark.read.text([f"{self.path}/digests/marks/{t}" for t in token.values()], wholetext=True).collect()]
        known = self.spark.createDataFrame([(m["place"].split("/")[-1], m["part"]) for m in marks], "__place string, __part string")
        stored = self.spark.read.parquet(*sorted({m["place"] for m in marks})).withColumn("__place", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return K.added_digests(stored.join(known, ["__place", "__part"], "left_semi").select("leaf", "n", "sum", "xor"))

    def orphans(self, source: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Keys of the last version that ``source`` doesn't have. Both sides' digests are compared, and only leaves in which
        they differ are read and compared: none, if the key sets are equal. Keys that the source repeats make their leaves
        differ, which reads more and finds the same."""
        leaves = K.different_leaves(self.digests(keys), K.leaf_digests(source.select(*keys), keys)) if self.current() else []
        if not leaves:
            return self.spark.createDataFrame([], StructType([f for k in keys for f in (self.schema() or source.schema) if f.name.lower() == k.lower()]))
        here = K.leaf(keys).isin(leaves) if len(leaves) < K.LEAVES else F.lit(True)
        return orphans(self.read().select(*keys).where(here), source.select(*keys).where(here), keys)
