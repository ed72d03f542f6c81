"""Near duplicates at a similarity: texts whose sets of word shingles have a Jaccard similarity of ``SIMILAR`` percent or more.

Candidates meet in ``BANDS`` buckets of ``ROWS`` MinHash values each: a pair at 0.8 misses all buckets once in 8 million, one
at 0.9 never in practice. All MinHash values of a text are folded into an odd sketch, a bitmap of ``BITS`` parities: two
sketches' XOR has a bit for nearly every value in which the texts differ, so its population count gives the similarity, the
more sharply the higher it is. Candidates whose estimate is ``DOUBT`` standard deviations or more under the similarity go; a
pair at exactly the similarity falls short of that once in some millions. All links are confirmed on the whole texts' sets.

Copies are one text throughout. Buckets aren't compared pairwise. First each member meets its bucket's leader, the text that
meets the most others: in a group of copies that is the one least changed, so most of the group is linked to it. Of its
buckets' leaders each text is checked against the one with the highest estimate. Then buckets of which all members are in one
component are closed; in the others the largest component is set aside, and a leader of the rest is elected in the same way,
as long as that halves what is open. What is left outside its bucket's largest component meets all others of the bucket by
sketches, in blocks, so that no task holds a bucket, and only what is alike is checked; for each text its most alike partner
first, and the others only if that leaves them apart. The blocks' work is that rest times its buckets.

Words are separated by white space of ASCII, letters A-Z in lower case; a text of fewer words than a shingle is one shingle.
Very long texts are hashed whole, in memory in proportion to their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_arrow, stash, text_mark
from millrace.llm.simhash import components, majority

SHINGLE = 2
#: Least similarity in percent.
SIMILAR = 80
BANDS, ROWS = 40, 5
#: MinHash values of a text: those of the buckets, and as many more, which make estimates sharper.
VALUES = 2 * BANDS * ROWS
#: Bits of a bitmap, and standard deviations by which a candidate's may differ too much.
BITS, DOUBT = 1024, 5.0
#: Texts of a block that meet those of another, at most about so many.
BLOCK, OTHERS = 512, 4096
#: Bits of the bitmap that spares texts from being shuffled.
FILTER = 2**24
#: Texts whose sets are held at once.
TEXTS = 256
#: A task keeps about so many shingles of texts met before.
CACHED = 2_000_000
_FACTORS = np.random.default_rng(42).integers(0, 2**64, (2, VALUES), np.uint64) | np.array([[1], [0]], np.uint64)
_PLACES = np.arange(VALUES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes | str | None, size: int) -> np.ndarray:
    """Hashes of a text's different shingles, in order; none of a text without words."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    n = max(1, len(words) - size + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, stops)), np.uint64, n))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of shingles."""
    least = np.full(VALUES, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        least = np.minimum(least, (hashes[at : at + 256, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0))
    return least


def bands(least: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(x.tobytes(), i) - 2**63 for i, x in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))]


def parities(values: np.ndarray) -> bytes:
    """A bitmap in which each of ``values``, well mixed, has flipped one bit."""
    mixed = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.packbits(np.bincount((mixed >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) % 2 == 1).tobytes()


def odd_sketch(hashes: np.ndarray, least: np.ndarray) -> bytes:
    """Two bitmaps: of the MinHash values, each with its place, and of the shingles themselves."""
    return parities(least ^ _PLACES) + parities(hashes)


def odd_bits(flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits of a bitmap so many flips leave odd: mean and variance."""
    left = np.exp(-2 * flips / BITS)
    return BITS / 2 * (1 - left), np.maximum(BITS / 4 * (1 - left**2) - flips * left**2, 0)


def estimates(sizes: np.ndarray, by_values: np.ndarray, by_set: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, whether it may reach ``percent``) of pairs with so many shingles in both texts together, whose sketches
    differ in so many bits.

    At the similarity, a number of values differ that varies like a sample's, and the sets differ in a number of shingles that
    is fixed; bits that flips have met in vary too. A pair may reach it unless one of its bitmaps has ``DOUBT`` standard
    deviations too many. The bitmap of sets is the sharper one up to some thousand shingles, and says nothing beyond."""
    j = percent / 100
    most, hidden = odd_bits(np.float64(2 * VALUES * (1 - j)))
    slope = np.exp(-4 * VALUES * (1 - j) / BITS)
    bound = most + DOUBT * (hidden + 4 * VALUES * j * (1 - j) * slope**2) ** 0.5
    gone = sizes * (1 - j) / (1 + j)
    set_most, set_hidden = odd_bits(gone)
    may = (by_values <= bound) & (by_set <= set_most + DOUBT * set_hidden**0.5 + 1e-6)
    flips = lambda x: -BITS / 2 * np.log(np.maximum(1 - 2 * x / BITS, 1 / BITS))
    apart = np.minimum(flips(by_set), sizes)
    sharp = gone < BITS
    return np.where(sharp, (sizes - apart) / (sizes + apart), 1 - flips(by_values) / (2 * VALUES)), may


def differing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many bits each of two sketches' bitmaps differ."""
    return tuple(np.bitwise_count((x ^ y).reshape(-1, 2, BITS // 64)).sum(axis=2, dtype=np.int64).T)


def alike_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    held = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * held >= percent * (len(x) + len(y) - held)


def sketches(docs: DataFrame, shingle: int, prints: bool = False) -> DataFrame:
    """(mark, size, bands, odd) of each different text: the number of its shingles, the keys of its buckets and its odd
    sketch. ``prints``: also fp, the SimHash of its shingles."""
    schema = "mark long, size long, bands array<long>, odd binary" + ", fp long" * prints

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                sets = [shingles(x.as_py(), shingle) for x in batch.column("text").cast(pa.binary())]
                least = [signature(x) for x in sets]
                columns = [batch.column("mark"), pa.array(map(len, sets), pa.int64()), pa.array(map(bands, least), pa.list_(pa.int64())), pa.array(map(odd_sketch, sets, least), pa.binary())]
                if prints:
                    columns.append(pa.array(map(majority, sets), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["mark", "size", "bands", "odd", "fp"][: len(columns)])

    texts = docs.select(text_mark(F.col("text")).alias("mark"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return in_arrow(texts, run, schema).dropDuplicates(["mark"])


def pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")]


def estimated(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (src, dst) with ``alike``, their estimate, where their sizes and sketches allow the similarity."""
    own = rows.select(F.col("mark").alias("src"), F.col("size").alias("n"), F.col("odd").alias("x"))
    other = rows.select(F.col("mark").alias("dst"), F.col("size").alias("m"), F.col("odd").alias("y"))
    both = pairs.join(own, "src").join(other, "dst").where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64) for c in ("x", "y"))
            like, may = estimates(np.asarray(batch.column("sizes")).astype(np.float64), *differing(x, y), percent)
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), pa.array(like)], ["src", "dst", "alike"]).filter(pa.array(may))

    return in_arrow(both.select("src", "dst", (F.col("n") + F.col("m")).alias("sizes"), "x", "y"), run, "src long, dst long, alike double")


def wanted_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(mark, text) of the texts of ``marks``, those that are alike to others.

    Texts of other marks needn't be shuffled to find that out: nearly all of them miss a bitmap of the marks, which has at
    most ``FILTER`` bits, as many rows as words of 64, however many marks there are."""
    word, bit = F.shiftright(F.col("mark").bitwiseAND(F.lit(FILTER - 1)), 6), F.col("mark").bitwiseAND(F.lit(63)).cast("int")
    bits = stash(marks.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits")), "minhash-bits")
    marked = docs.select(text_mark(F.col("text")).alias("mark"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    likely = marked.withColumn("word", word).join(F.broadcast(bits), "word").where(F.call_function("getbit", F.col("bits"), bit) == 1).select("mark", "text")
    # an inner join with different marks: the optimizer would move a semi-join in front of the bitmap
    return likely.join(marks.select("mark").distinct(), "mark").groupBy("mark").agg(F.min("text").alias("text"))


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(src, dst): those of ``pairs`` whose whole texts are near copies. ``pairs`` is a written table."""
    texts = stash(wanted_texts(docs, pairs.select(F.col("src").alias("mark")).unionAll(pairs.select("dst"))), "minhash-texts")
    both = pairs.select("src", "dst").join(texts.select(F.col("mark").alias("src"), F.col("text").alias("a")), "src").join(texts.select(F.col("mark").alias("dst"), F.col("text").alias("b")), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        total = 0

        def cached(mark: int, text: pa.Scalar) -> np.ndarray:
            nonlocal total
            if mark not in known:
                if total > CACHED:
                    known.clear()
                    total = 0
                known[mark] = shingles(text.as_py(), shingle)
                total += len(known[mark])
            return known[mark]

        for batch in batches:
            columns = (batch.column("src").to_pylist(), batch.column("dst").to_pylist(), batch.column("a").cast(pa.binary()), batch.column("b").cast(pa.binary()))
            close = [alike_enough(cached(src, a), cached(dst, b), percent) for src, dst, a, b in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst")], ["src", "dst"]).filter(pa.array(close, pa.bool_()))

    return stash(in_arrow(both.select("src", "dst", "a", "b"), run, "src long, dst long"), "minhash-links")


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """(mark, root) of all texts that have links, from those before and new ones."""
    if links.isEmpty():
        return found
    roots = components(found.select(F.col("mark").alias("src"), F.col("root").alias("dst")).unionAll(links), test=True)
    return stash(roots.select(F.col("node").alias("mark"), "root").unionAll(roots.select(F.col("root").alias("mark"), "root").distinct()), "minhash-roots")


def still_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """(band, mark, met, root, rest) of the buckets with more than one component; ``rest``: not of the bucket's largest."""
    each = members.join(found, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    most = each.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    return stash(each.join(most.select("band", F.col("most.root").alias("largest")), "band").select("band", "mark", "met", "root", (F.col("root") != F.col("largest")).alias("rest")), "minhash-open")


def led(open_: DataFrame) -> DataFrame:
    """(src, dst, mark): pairs of a bucket's leader, which is of the rest, and a member of another component, ``mark``."""
    leaders = open_.where("rest").groupBy("band").agg(F.max(F.struct("met", "mark", "root")).alias("lead"))
    both = open_.join(leaders, "band").where(F.col("root") != F.col("lead.root"))
    return both.select(*pair("mark", "lead.mark"), "mark").distinct()


def groups(docs: DataFrame, rows: DataFrame, shingle: int = SHINGLE, percent: int = SIMILAR, first: DataFrame | None = None) -> DataFrame:
    """(mark, root): of each text that has near copies, the least mark of its component. ``rows``: the written sketches.
    ``first``: a written table of pairs (src, dst) that are checked, and linked, before texts meet in buckets."""
    keyed = rows.where("size > 0").select("mark", F.explode("bands").alias("band"))
    shared = stash(keyed.groupBy("band").agg(F.count("*").alias("held")).where("held > 1"), "minhash-shared")
    members = stash(keyed.join(shared, "band"), "minhash-members")
    met = stash(members.groupBy("mark").agg(F.sum("held").alias("met")), "minhash-met")
    members = stash(members.select("band", "mark").join(met, "mark"), "minhash-members")
    open_, before = members.withColumns({"root": F.col("mark"), "rest": F.lit(True)}), None
    tried = docs.sparkSession.createDataFrame([], "src long, dst long")
    found = tried.select(F.col("src").alias("mark"), F.col("dst").alias("root"))
    if first is not None and not first.isEmpty():
        tried = tried.unionAll(first)
        found = joined(found, confirmed(docs, first, shingle, percent))
        open_ = still_open(members, found).withColumn("rest", F.lit(True))
    while True:
        pairs = stash(led(open_), "minhash-led")
        likely = estimated(pairs.select("src", "dst").distinct().join(tried, ["src", "dst"], "left_anti"), rows, percent)
        best = pairs.join(likely, ["src", "dst"]).groupBy("mark").agg(F.max(F.struct("alike", "src", "dst")).alias("best"))
        chosen = stash(best.select("best.src", "best.dst").distinct(), "minhash-chosen")
        if chosen.isEmpty():
            break
        tried = tried.unionAll(chosen)
        found = joined(found, confirmed(docs, chosen, shingle, percent))
        open_ = still_open(members, found)
        rest = open_.where("rest").count()
        if not rest:
            return found
        if before is not None and 2 * rest > before:
            break
        before = rest
    left = stash(alike(open_, rows, percent).join(tried, ["src", "dst"], "left_anti"), "minhash-left")
    if left.isEmpty():
        return found
    best = [left.groupBy(c).agg(F.max(F.struct("alike", "src", "dst")).alias("x")).select(F.col(c).alias("mark"), "x") for c in ("src", "dst")]
    chosen = stash(best[0].unionAll(best[1]).groupBy("mark").agg(F.max("x").alias("x")).select("x.src", "x.dst").distinct(), "minhash-chosen")
    found = joined(found, confirmed(docs, chosen, shingle, percent))
    root = lambda c: found.select(F.col("mark").alias(c), F.col("root").alias(f"{c}_root"))
    apart = ~F.coalesce(F.col("src_root"), F.col("src")).eqNullSafe(F.coalesce(F.col("dst_root"), F.col("dst")))
    rest = left.select("src", "dst").join(chosen, ["src", "dst"], "left_anti").join(root("src"), "src", "left").join(root("dst"), "dst", "left").where(apart)
    rest = stash(rest.select("src", "dst"), "minhash-left")
    return found if rest.isEmpty() else joined(found, confirmed(docs, rest, shingle, percent))


def alike(open_: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst, alike): pairs that share a bucket, but not a component, of which one at least is of the bucket's rest, and
    whose sizes and sketches allow the similarity; each from the first bucket that both are in."""
    size = open_.groupBy("band").agg(F.ceil(F.count_if("rest") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / OTHERS).cast("int").alias("parts"))
    own = open_.select("band", "mark", "root", "rest").join(stash(size, "minhash-sizes"), "band")
    place = lambda n: F.pmod(F.xxhash64("mark", "band"), F.col(n)).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asking = own.where("rest").select("band", "mark", "root", "rest", place("blocks").alias("block"), F.explode(all_("parts")).alias("part"), F.lit(True).alias("asks"))
    asked = own.select("band", "mark", "root", "rest", F.explode(all_("blocks")).alias("block"), place("parts").alias("part"), F.lit(False).alias("asks"))
    wide = asking.unionAll(asked).join(rows.select("mark", "size", "bands", "odd"), "mark")
    together = wide.groupBy("band", "block", "part").agg(F.collect_list(F.struct("mark", "root", "rest", "asks", "size", "bands", "odd")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for band, members in zip(batch.column("band").to_pylist(), batch.column("members")):
                x = members.values
                mark, root, size = (np.asarray(x.field(k)) for k in ("mark", "root", "size"))
                rest, asks = (np.asarray(x.field(k).cast(pa.int8())).astype(bool) for k in ("rest", "asks"))
                keys = np.asarray(x.field("bands").flatten()).reshape(len(mark), BANDS)
                odd = np.frombuffer(b"".join(x.field("odd").to_pylist()), np.uint64).reshape(len(mark), -1)
                others = np.flatnonzero(~asks)
                for i in np.flatnonzero(asks).tolist():
                    # two of the rest ask for each other, so one of them is enough
                    j = others[(root[others] != root[i]) & (~rest[others] | (mark[others] < mark[i])) & (np.minimum(size[others], size[i]) * 100 >= np.maximum(size[others], size[i]) * percent)]
                    like, may = estimates((size[j] + size[i]).astype(np.float64), *differing(odd[j], odd[i]), percent)
                    j, like = j[may], like[may]
                    here = keys[i][(keys[j] == keys[i]).argmax(axis=1)] == band
                    out.append((np.maximum(mark[i], mark[j[here]]), np.minimum(mark[i], mark[j[here]]), like[here]))
            columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))], ["src", "dst", "alike"])

    return in_arrow(together, run, "src long, dst long, alike double").groupBy("src", "dst").agg(F.max("alike").alias("alike"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text): the size of its set, the least id
    that it reaches by links, itself included, and whether that is its own.

    Defined results: a text without words, or null, has no shingles and links with nothing. Rows of one text, whatever their
    ids, are linked if it has words. A null id is a component's only if all its ids are null, and such a row isn't kept unless
    it stands alone. Other columns are ignored."""
    rows = stash(sketches(docs, shingle), "minhash-sketches")
    found = groups(docs, rows, shingle, percent)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"))
    least = ids.groupBy("mark").agg(F.min("doc_id").alias("first")).join(rows.select("mark", "size"), "mark").join(found, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    least = stash(least, "minhash-least")
    by_root = least.groupBy("root").agg(F.min("first").alias("component_id"))
    # written, so that the join stands on two plain exchanges, of which Spark can split a text of many copies
    by_mark = stash(least.join(by_root, "root").select("mark", F.col("size").alias("n_shingles"), "component_id"), "minhash-by-mark")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = ids.join(by_mark, "mark").select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
