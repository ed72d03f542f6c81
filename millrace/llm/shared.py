"""Shared storage for intermediate tables, and the reader of the input tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is taken in local mode only; on a cluster that is an error, as executors
    would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        # with its scheme: a bare path is Spark's default file system, and others would take it for a local one
        path = spark._jvm.org.apache.hadoop.fs.Path(found.rstrip("/"))
        return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _local


_local: str | None = None


def stash(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: lineage is cut, lost executors cost nothing, and Spark
    knows the table's size, so that it broadcasts it only when it is small."""
    spark = frame.sparkSession
    path = f"{stash_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def stash_dir(spark: SparkSession) -> str:
    """The application's own folder for intermediate tables."""
    return f"{shared_dir(spark)}/stash-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the application's intermediate tables, once nothing reads results that stand on them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stash_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a row group, as Parquet writers make them by default. One task reads it.
ROW_GROUP = 128 * 2**20


def spread(rows: DataFrame) -> DataFrame:
    """A scan's rows, dealt out over all cores where it has fewer files than that and none is likely to have more than one
    row group: the operators' work on a text costs many times its shuffle. The rows are the same either way."""
    cores, plan = rows.sparkSession.sparkContext.defaultParallelism, rows._jdf.queryExecution()
    if plan.toRdd().getNumPartitions() >= 4 * cores:
        return rows
    files, size = len(rows.inputFiles()), int(str(plan.optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if files < cores and size <= files * ROW_GROUP else rows


#: Spark's setting for the size of an Arrow batch, 64 MiB by default, and what the operators set it to.
ARROW_BATCH, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 * 2**20


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``rows.mapInArrow``, in batches of about ``ARROW_BYTES`` bytes, or one row where that has more.

    Of each task both the JVM and the Python worker hold a batch or two outside of Spark's memory, and both keep for good
    what the largest took. The setting is the session's, as Spark reads it when the plan runs; one that is already made stands."""
    if rows.sparkSession.conf.get(ARROW_BATCH, None) is None:
        rows.sparkSession.conf.set(ARROW_BATCH, ARROW_BYTES)
    return rows.mapInArrow(run, schema)


def text_mark(text: Column) -> Column:
    """With the id, it tells apart rows that repeat an id with other texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def unused(rows: DataFrame, *names: str) -> list[str]:
    """``names``, made longer until ``rows`` has no column of that name, in letters of either case."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
