"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Fingerprints within ``RADIUS`` bits of each other are linked. The tables are those of a covering code: each bit position
gets a non-zero vector of F2^(RADIUS+1), and table v keeps the positions whose vector has odd product with v. For any
RADIUS positions some v has even product with all their vectors, so two fingerprints that differ only there agree on
table v's mask: every pair within the radius meets in some bucket, with certainty.

A bucket is compared pairwise only while it is small. Larger ones are split by a covering code over the positions that
the bucket leaves free, which keeps the guarantee and halves the free positions; after the last split a bucket has so
few free positions that it can't hold more than ``SMALL`` different fingerprints. Links become components by
alternating large-star and small-star steps. Exact copies are one fingerprint throughout.

Defined results: a null text is empty; a text without words has fingerprint zero, which links like any other; a text of
one or two words is one shingle. Repeated rows each get a result. A null id is never a component's id unless all ids of
the component are null. Other columns of the input are ignored. Very long texts are hashed whole, in memory in proportion to
their words.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_arrow, stash, text_mark, unused

RADIUS = 3
BITS = 64
SHINGLE = 3
SEED = 42
#: Buckets of up to so many different fingerprints are compared pairwise.
SMALL = 256
SPLITS = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the whole text as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed 64-bit integer."""
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), fps], ["doc_id", "mark", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, mark long, fp long")


def covering_masks(positions: list[int], radius: int, seed: int) -> list[int]:
    """Masks over ``positions``: for any ``radius`` of them, one of the masks has none of these."""
    order = list(positions)
    random.Random(seed).shuffle(order)
    size = 2 ** (radius + 1) - 1
    vector = {p: i % size + 1 for i, p in enumerate(order)}
    return [sum(1 << p for p, m in vector.items() if (m & v).bit_count() % 2) for v in range(1, size + 1)]


def table_masks(radius: int, splits: int) -> list[list[int]]:
    """For each split the masks of all its tables; table t of one split leads to tables t * w + 0 ... t * w + w - 1."""
    levels = [covering_masks(list(range(BITS)), radius, 1)]
    while len(levels) < splits:
        levels.append([m | x for m in levels[-1] for x in covering_masks([p for p in range(BITS) if not m >> p & 1], radius, 1 + len(levels))])
    return levels


def signed(x: int) -> int:
    return x - 2**BITS if x >= 2 ** (BITS - 1) else x


def bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """Links within buckets of bounded size: a spanning forest of each bucket's graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for fps in batch.column("fps"):
                x = np.sort(np.asarray(fps.as_py(), np.int64))
                bits = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64))  # of signed numbers it would count the absolute value's
                root = list(range(len(x)))
                for a, b in zip(*(i.tolist() for i in np.nonzero(np.triu(bits <= radius, 1)))):
                    while root[a] != a:
                        a = root[a]
                    while root[b] != b:
                        b = root[b]
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((int(x[max(a, b)]), int(x[min(a, b)])))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["src", "dst"])

    return in_arrow(buckets.select("fps"), run, "src long, dst long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst): links between different fingerprints that connect all that lie within ``radius`` of each other.

    ``fps`` has one row for each different fingerprint, and is read several times."""
    levels = table_masks(radius, SPLITS)
    width, found = len(levels[0]), []
    rows = fps.select("fp", F.lit(0).alias("t"))
    for level, masks in enumerate(levels):
        known = F.array(*[F.lit(signed(m)) for m in masks])
        keyed = rows.select("fp", F.explode(F.sequence(F.col("t") * width, F.col("t") * width + (width - 1))).alias("t")).select("fp", "t", F.col("fp").bitwiseAND(F.element_at(known, F.col("t") + 1)).alias("key"))
        sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1")
        sizes = stash(sizes, "simhash-buckets")
        pairs = sizes.where("n = 2").where(F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= radius)
        found.append(pairs.select(F.col("high").alias("src"), F.col("low").alias("dst")))
        last = level == len(levels) - 1
        more = sizes.where("n > 2") if last else sizes.where(f"n > 2 AND n <= {SMALL}")
        members = keyed.join(more.select("t", "key"), ["t", "key"])
        found.append(bucket_links(members.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")), radius))
        hot = sizes.where(f"n > {SMALL}")
        if last or hot.isEmpty():
            break
        rows = keyed.join(hot.select("t", "key"), ["t", "key"]).select("fp", "t")
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out.distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether each source has one edge, and no target is a source."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR out = 1 AND in = 1").isEmpty()


def components(edges: DataFrame, test: bool = False) -> DataFrame:
    """(node, root): root is the smallest node that is reachable. Nodes without edges have no row. ``test``: look whether the
    edges are stars before each round, which is less work than a last round that changes nothing, where rounds are few.

    Large-star and small-star steps alternate until the edges form stars; each step is written to the shared folder. Minima
    are pre-aggregated and written too, before they are joined back: the join then stands on plain exchanges, of which Spark
    can split a hot node's, so that its edges need not meet in one task."""

    def to_least(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(stash(least, "components-least"), "u")

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    edges = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    edges = stash(edges, "components-edges")
    before = mark(edges)
    while before[0] and not (test and are_stars(edges)):
        both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        large = to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = to_least(stash(large, "components-pairs"))
        edges = stash(small.where("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst")).unionAll(small.select(F.col("u").alias("src"), F.col("m").alias("dst"))).distinct(), "components-edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, fp, component_id, root) of every row of ``docs`` (doc_id, text); root is the component's least fingerprint."""
    marked = stash(fingerprints(docs, shingle), "simhash-rows")
    fps = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps")
    roots = components(links(fps, radius))
    members = roots.select(F.col("node").alias("fp"), "root").unionAll(roots.select(F.col("root").alias("fp"), "root").distinct()).join(fps, "fp")
    first = members.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = members.join(first, "root").select("fp", "component_id", "root")
    by_fp = fps.join(linked, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    # written, so that the join stands on two plain exchanges, of which Spark can split a fingerprint of many copies
    return marked.join(stash(by_fp, "simhash-by-fp"), "fp").select("doc_id", "mark", "fp", "component_id", "root")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id stays."""
    found = stash(simhash_components(docs, radius, shingle), "simhash-components")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"))
    row_id, row_mark, won_id, won_mark = unused(docs, "row_id", "row_mark", "won_id", "won_mark")
    winners = found.groupBy("root").agg(F.min(order).alias("w")).select(F.col("w.doc_id").alias(won_id), F.col("w.mark").alias(won_mark)).distinct()
    marked = docs.withColumns({row_id: F.col("doc_id").cast("long"), row_mark: text_mark(F.col("text"))})
    kept = marked.join(winners, F.col(row_id).eqNullSafe(F.col(won_id)) & (F.col(row_mark) == F.col(won_mark)), "left_semi")
    return kept.dropDuplicates([row_id, row_mark]).select(*docs.columns)


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
