"""Centroid clustering of vectors with a table of distances to fixed pivots (LAESA).

Components become whole numbers, floor(64 x). Every vector's distances to a few pivots are computed and stored once. In each
round, the difference of the distances that a vector and a centroid have to a pivot is a lower bound of the distance between
the two; a vector's centroid of the least bound is measured first, and only centroids whose bound doesn't exceed the distance
found so far are measured too, exactly, in whole numbers. Pivots are spread out: farthest first among a bounded sample. They
only save work; the result is that of measuring everything.

Defined results: vectors that are null, or have other than ``SIZE`` components, or a null or non-finite one, are left out, as
are those with a component of 2^21 or more in size, whose squared distances a long can't hold. With fewer vectors than
centroids there are as many centroids as vectors; without any the result is empty. Repeated rows each get a result, and may
each be a first centroid; rows that repeat an id are ordered by their components, rows without an id are last. A tie goes to
the centroid of the smaller number; an empty cluster's centroid stays. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import stash

SIZE, SCALE = 64, 64
CLUSTERS, ROUNDS = 16, 3
#: Components of this size or more, after scaling, are out of range.
LIMIT = 2**27
#: Pivots of the table, and vectors that they are chosen from, those of the least hashes.
PIVOTS, SAMPLE = 8, 256
#: Vectors that are measured at once.
CHUNK = 4096

Centroids = list[list[int]]


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x): the usable vectors in whole numbers."""
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    usable = (F.size("e") == SIZE) & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LIMIT / SCALE))
    return given.where(usable).select("vec_id", F.transform("e", lambda v: F.floor(v * SCALE).cast("int")).alias("x"))


def first(kept: DataFrame, n: int) -> Centroids:
    """The vectors with the least hashes of their ids, at most ``n``, in that order."""
    mark = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [list(r.x) for r in kept.orderBy(mark.asc_nulls_last(), F.col("vec_id"), F.col("x")).limit(n).select("x").collect()]


def spread_out(sample: Sequence[Sequence[int]], n: int) -> np.ndarray:
    """Of ``sample`` at most ``n`` vectors, each the farthest from those before it."""
    x = np.array(sample, np.int64).reshape(-1, SIZE)
    far, chosen = np.full(len(x), np.iinfo(np.int64).max), []
    for _ in range(min(n, len(x))):
        k = int(far.argmax())
        if far[k] == 0:
            break
        chosen.append(k)
        far = np.minimum(far, ((x - x[k]) ** 2).sum(axis=1))
    return x[chosen]


def roots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each of ``x`` to each of ``y``."""
    return np.sqrt(np.stack([((x - v) ** 2).sum(axis=1) for v in y], axis=1).astype(np.float64)) if len(y) else np.zeros((len(x), 0))


def pivot_table(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, x, away): each vector with its distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).astype(np.int64).reshape(-1, SIZE)
            away = pa.array(list(roots(x, pivots)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), away], ["vec_id", "x", "away"])

    return stash(kept.mapInArrow(run, "vec_id long, x array<int>, away array<double>"), "laesa-pivots")


def nearest(x: np.ndarray, away: np.ndarray, centroids: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance to it, distances that were measured) of each vector.

    ``away``: distances of vectors to pivots; ``apart``: of centroids to pivots."""
    bound = np.zeros((len(x), len(centroids)))
    for k in range(away.shape[1]):
        np.maximum(bound, np.abs(away[:, k, None] - apart[None, :, k]), out=bound)
    # roots are right to 52 bits of at most 2^31
    bound -= 1e-5 + 1e-9 * bound
    found = bound.argmin(axis=1)
    best = ((x - centroids[found]) ** 2).sum(axis=1)
    measured, guess = np.ones(len(x), np.int64), found.copy()
    for c in range(len(centroids)):
        open_ = np.flatnonzero((bound[:, c] <= np.sqrt(best.astype(np.float64))) & (guess != c))
        d = ((x[open_] - centroids[c]) ** 2).sum(axis=1)
        closer = (d < best[open_]) | ((d == best[open_]) & (c < found[open_]))
        best[open_[closer]], found[open_[closer]] = d[closer], c
        measured[open_] += 1
    return found, best, measured


def measured(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, apart: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Batches of at most ``CHUNK`` vectors with their vectors in numpy and what :func:`nearest` says."""
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(at, CHUNK)
            x = np.asarray(batch.column("x").flatten()).astype(np.int64).reshape(-1, SIZE)
            away = np.asarray(batch.column("away").flatten()).reshape(len(x), -1)
            yield batch, x, nearest(x, away, centroids, apart)


def moved(table: DataFrame, centroids: Centroids, pivots: np.ndarray) -> Centroids:
    """The centroids after one round. Tasks add their own vectors first; what reaches the driver is a sum for each centroid
    and component."""
    c = np.array(centroids, np.int64)
    apart = roots(c, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(c), SIZE), np.int64), np.zeros(len(c), np.int64)
        for _, x, (found, _, _) in measured(batches, c, apart):
            np.add.at(sums, found, x)
            counts += np.bincount(found, minlength=len(c))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met], pa.int64()), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = table.select("x", "away").mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    out = [list(v) for v in centroids]
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        out[r.cluster][r["at"]] = int(r.s) // r.n
    return out


def assigned(table: DataFrame, centroids: Centroids, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, measured) of each vector; ``measured``: how many centroids its distance was computed to."""
    c = np.array(centroids, np.int64).reshape(-1, SIZE)
    apart = roots(c, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, (found, best, n) in measured(batches, c, apart):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(best, pa.int64()), pa.array(n, pa.int32())], ["vec_id", "cluster", "distance", "measured"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long, measured int")


_RESULT = "vec_id long, cluster int, distance long, measured int, cluster_inertia long, inertia long, centroid_sha256 string"


def clusters(rows: DataFrame, n: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Each vector's cluster, squared distance, the number of distances that it took, its cluster's and all clusters' inertia
    and its centroid's digest."""
    spark: SparkSession = rows.sparkSession
    kept = stash(vectors(rows), "laesa-vectors")
    sample = first(kept, max(n, SAMPLE))
    centroids = sample[:n]
    if not centroids:
        return spark.createDataFrame([], _RESULT)
    pivots = spread_out(sample, PIVOTS)
    table = pivot_table(kept, pivots)
    for _ in range(rounds):
        centroids = moved(table, centroids, pivots)
    final = stash(assigned(table, centroids, pivots), "laesa-assigned")
    sums = {r.cluster: int(r.s) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    looked_up = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in centroids]
    return final.select(
        "*", looked_up([sums.get(k, 0) for k in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), looked_up(digests, "string").alias("centroid_sha256"),
    )
