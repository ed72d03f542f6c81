"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of ``WINDOW`` consecutive words of each benchmark item; an item of fewer words is one pattern.
Patterns of one length share a table: a block is two neighbouring words, and its shift says how far the search may move
before that block could stand where it stands in some pattern. A shift of zero means that some pattern ends in the
block; a bucket of patterns under a hash of that suffix is then compared word by word. Most positions of a clean text
are never looked at, as most blocks occur in no pattern and move the search by the pattern's length less one.

The benchmark is cut into blocks of about ``BLOCK_WORDS`` words, items of over ``PIECE`` words into pieces that overlap by
a window less one, so that a block's bound doesn't depend on what the items look like. One block at a time comes to the
driver and is broadcast, and each worker builds its tables as arrays, some 40 bytes a word. With one block, documents are
read once and nothing is shuffled; with more, each block's hits are written before the next block is taken, and gathered
by document row, as spans rather than texts.

Defined results: a null text has no words, and an item without words no pattern; items with a null id mark hits but are
not listed; repeated rows each get a result; an item that is listed twice counts once; other columns are ignored. Very long
texts are searched whole, in memory in proportion to their words.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_arrow, stash, text_mark

WINDOW = 10
BLOCK_WORDS = 1_000_000
PIECE = 10_000
#: Words of the suffix that chooses a bucket.
SUFFIX = 3

#: ASCII letters in lower case; digits; all other ASCII separates words. Bytes of other characters are word bytes.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


_M64, _STEP, _SPREAD = 2**64 - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mixed(columns):
    """Hash of word numbers: of one sequence as int, of many as one array for each place."""
    out = columns[0] * 0
    for c in columns:
        out = out * _STEP + c + 1 & _M64 if isinstance(out, int) else out * np.uint64(_STEP) + c + np.uint64(1)
    return out * _SPREAD & _M64 if isinstance(out, int) else out * np.uint64(_SPREAD)


class Patterns:
    """Shift table and suffix buckets for the patterns of one length: those of ``flat``, words by number, that begin at ``at``."""

    def __init__(self, length: int, flat: np.ndarray, at: np.ndarray, items: np.ndarray, known: dict[bytes, int], names: list[str | None]):
        self.length, self.flat, self.known, self.names = length, flat, known, names
        self.block = min(2, length)
        word = lambda k: flat[at + k].astype(np.uint64)
        bits = min(24, max(12, (4 * len(at)).bit_length()))
        self.down = 64 - bits
        shift = np.full(2**bits, length - self.block + 1, np.uint8)
        for end in range(self.block, length + 1):
            np.minimum.at(shift, mixed([word(k) for k in range(end - self.block, end)]) >> np.uint64(self.down), length - end)
        self.shift = shift.tobytes()
        suffix, full = mixed([word(k) for k in range(max(0, length - SUFFIX), length)]), mixed([word(k) for k in range(length)])
        order = np.lexsort((items, full, suffix))
        at, items, suffix, full = at[order], items[order], suffix[order], full[order]
        # an item's own repeats
        again = np.concatenate([[False], (items[1:] == items[:-1]) & np.all([flat[at[1:] + k] == flat[at[:-1] + k] for k in range(length)], axis=0)])
        self.at, self.items, self.suffix, self.full = (x[~again] for x in (at, items, suffix, full))
        held = np.zeros(2**bits, np.uint8)
        held[self.suffix >> np.uint64(self.down)] = 1
        self.held = held.tobytes()

    def search(self, text: list[bytes]) -> Iterator[tuple[int, list[str | None]]]:
        """(start, items) of each occurrence."""
        m, b, shift, held, down, known, n = self.length, self.block, self.shift, self.held, self.down, self.known.get, len(text)
        end = m
        while end <= n:
            last = known(text[end - 1])
            if last is None:
                end += m
                continue
            if b == 2:
                first = known(text[end - 2])
                if first is None:
                    end += m - 1
                    continue
                step = shift[((((first + 1 & _M64) * _STEP + last + 1) & _M64) * _SPREAD & _M64) >> down]
            else:
                step = shift[((last + 1) * _SPREAD & _M64) >> down]
            if step:
                end += step
                continue
            window = [known(x) for x in text[end - m : end]]
            if None not in window:
                suffix = mixed(window[-SUFFIX:])
                if held[suffix >> down]:
                    found = self.bucket(suffix, window)
                    if found:
                        yield end - m, found
            end += 1

    def bucket(self, suffix: int, window: list[int]) -> list[str | None]:
        """Items of the patterns in a suffix's bucket that are ``window``, word by word."""
        low, high = (int(np.searchsorted(self.suffix, np.uint64(suffix), side)) for side in ("left", "right"))
        full = np.uint64(mixed(window))
        low, high = (low + int(np.searchsorted(self.full[low:high], full, side)) for side in ("left", "right"))
        return [self.names[self.items[i]] for i in range(low, high) if self.flat[self.at[i] : self.at[i] + self.length].tolist() == window]


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Tables of one block's items, one for each length of pattern."""
    known: dict[bytes, int] = {}
    flat, names = array("i"), [i for i, _ in items]
    starts: dict[int, list[np.ndarray]] = {}
    owners: dict[int, list[np.ndarray]] = {}
    for number, (_, text) in enumerate(items):
        w = words(text)
        if w:
            m = min(window, len(w))
            at = np.arange(len(flat), len(flat) + len(w) - m + 1)
            starts.setdefault(m, []).append(at)
            owners.setdefault(m, []).append(np.full(len(at), number))
            flat.extend([known.setdefault(x, len(known)) for x in w])
    numbers = np.array(flat, np.int32)
    return [Patterns(m, numbers, np.concatenate(starts[m]), np.concatenate(owners[m]), known, names) for m in starts]


def find(text: list[bytes], tables: list[Patterns]) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of hit words, merged and in order, and the items that occur."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for t in tables:
        for at, found in t.search(text):
            spans.append((at, at + t.length))
            items.update(i for i in found if i is not None)
    return merged(spans), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's (item_id, text), block by block; each block alone comes to the driver, when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    # words are two bytes at least, with what separates them
    if items.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0] <= 2 * block_words:
        yield [(r.item_id, r.text) for r in items.collect()]
        return
    size = min(PIECE, block_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
                w = words(text.as_py())
                for at in range(0, max(1, len(w) - window + 1), size) if w else ():
                    part = w[at : at + size + window - 1]
                    out.append((item, b" ".join(part).decode(), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["item_id", "text", "n"])

    pieces = stash(in_arrow(items, cut, "item_id string, text string, n long").distinct(), "benchmark-pieces")
    n = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words) or 1
    for i in range(n):
        yield [(r.item_id, r.text) for r in pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).select("item_id", "text").collect()]


_built: dict[str, list[Patterns]] = {}


def built(key: str, items: list[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    """Tables of a worker's block; those of an earlier block go."""
    if key not in _built:
        _built.clear()
        _built[key] = build(items, window)
    return _built[key]


HITS = "n_words long, starts array<long>, ends array<long>, items array<string>"


def scan(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> DataFrame:
    """Hits of one block of the benchmark in every row of ``docs`` (doc_id, mark, text)."""
    held, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = built(key, held.value, window)
        for batch in batches:
            n, spans, found = [], [], []
            for x in batch.column("text"):
                w = words(x.as_py())
                s, i = find(w, tables)
                n.append(len(w))
                spans.append(s)
                found.append(i)
            columns = [pa.array(n, pa.int64()), pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int64())), pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *columns], ["doc_id", "mark", "n_words", "starts", "ends", "items"])

    return in_arrow(docs, run, f"doc_id long, mark long, {HITS}")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, mark, n_words, starts, ends, items) of every row: hit spans of words and the items that occur."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    parts = blocks(benchmark, window, block_words)
    first, second = next(parts), next(parts, None)
    if second is None:
        return scan(rows, first, window)
    every = stash(scan(rows, first, window), "benchmark-hits").withColumn("times", F.lit(1))
    while second is not None:
        # rows without hits are only needed once
        every = every.unionAll(stash(scan(rows, second, window).where("size(starts) > 0"), "benchmark-hits").withColumn("times", F.lit(0)))
        second = next(parts, None)

    def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            spans = [merged(list(zip(r["starts"], r["ends"]))) for r in rows]
            out = [[r[k] for r in rows] for k in ("doc_id", "mark", "n_words")] + [[[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans], [r["items"] for r in rows]]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "mark", "n_words", "starts", "ends", "items"])

    # rows that repeat id and text are one group, dealt out again by its count; spans of a group are those of one text
    grouped = every.groupBy("doc_id", "mark", "n_words").agg(F.sum("times").alias("times"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.collect_set(F.struct("starts", "ends")).alias("s"))
    flat = grouped.where("times > 0").select("doc_id", "mark", "n_words", F.flatten("s.starts").alias("starts"), F.flatten("s.ends").alias("ends"), "items", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")
    return in_arrow(flat, join_spans, f"doc_id long, mark long, {HITS}")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    found = hits(docs, benchmark, window, block_words)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    items = F.sha2(F.array_join(F.sort_array("items"), ","), 256)
    out = found.select("doc_id", "mark", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window. With one block this is a filter in the same scan; with more, what
    each block leaves is written before the next is taken."""

    def cleaned(docs: DataFrame, items: list[tuple[str | None, str | None]]) -> DataFrame:
        held, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = built(key, held.value, window)
            for batch in batches:
                at = batch.schema.get_field_index("text")
                yield batch.filter(pa.array([not any(next(t.search(w), None) for t in tables) for w in (words(x.as_py()) for x in batch.column(at))], pa.bool_()))

        return in_arrow(docs, clean, docs.schema)

    parts = blocks(benchmark, window, block_words)
    docs, following = cleaned(docs, next(parts)), next(parts, None)
    while following is not None:
        docs, following = cleaned(stash(docs, "benchmark-clean"), following), next(parts, None)
    return docs


__all__ = ["blocks", "build", "contamination", "drop_contaminated", "find", "hits", "words"]
