"""Intermediate tables in the folder that the session's executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local
    if _local is None:
        _local = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _local


_local: str | None = None


def reliable(frame: DataFrame) -> DataFrame:
    """``frame``, computed once, with its lineage cut, as a table that survives a lost executor and whose size Spark
    knows: later joins broadcast it only where it is small."""
    path = f"{shared_folder(frame.sparkSession)}/step-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def numbered(frame: DataFrame, *order: str, name: str = "__number") -> DataFrame:
    """``frame`` with its rows' places in ``order``, from 0: a range sort, and the sizes of its partitions, of which there is
    one row each. No task sorts all rows."""
    parts = {"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}
    rows = reliable(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(parts))
    sizes = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for i in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(i, 0)
    place = F.get(F.array(*map(F.lit, starts)), F.col("__part")).cast("long") + F.col("__place")
    return rows.withColumn(name, place).drop("__part", "__place")


def create_once(spark: SparkSession, folder: str, name: str, data: bytes) -> bool:
    """Write a small file under a name that only one writer can take; whether this one has. Readers see all of it or nothing.

    On a store without atomic renames it is as safe as that store's rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    fs.mkdirs(path)
    hidden, final = (fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path, n)) for n in (f".{uuid.uuid4().hex}", name))
    out = fs.create(hidden, False)
    out.write(bytearray(data))
    out.close()
    try:
        if fs.getScheme() == "file":
            # a local rename would overwrite; a second link of the name fails
            link = lambda p: jvm.java.nio.file.Paths.get(p.toUri())
            jvm.java.nio.file.Files.createLink(link(final), link(hidden))
            fs.delete(hidden, False)
        else:
            # unlike a file system's own rename, this one never overwrites
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(hidden, final, none)
    except Py4JJavaError:
        fs.delete(hidden, False)
        if fs.exists(final):
            return False
        raise
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """Files in ``folder``, which need not be there, without hidden ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [n for x in fs.listStatus(path) if not (n := x.getPath().getName()).startswith(".")] if fs.exists(path) else []
