"""Substring deduplication by relative Lempel-Ziv parsing against blocks of all documents.

Every document is both a reference and parsed against the others. It is cut into blocks around anchors: the anchor of a
window of ``WINDOW`` words is its least hash of ``GRAM`` consecutive words, and the windows in a row that have the same
anchor make a block. A window's anchor depends on the window's words alone, so equal windows of two documents lie in
blocks with equal anchors, and looking up the anchor finds every reference block that could hold a match. Anchors are hashes, not places,
so a text that repeats itself has few blocks.

A factor is a run of words that stands in one reference document with a smaller id. The parse is greedy. A block that
stands whole in such a document is one factor. Where a block shares its anchor with reference blocks of other content, the
blocks of the anchor are parsed one against the other, in the order of their documents: a window that the index of the
reference blocks before has, by hash and then word by word, begins a factor, which is extended as far as its words and the
reference's are the same. Windows inside a factor need no look; the next one looked up is the first that reaches over the
factor's end, and so each window across a factor boundary is checked. Windows that no factor covers join the index. Each
factor is a window long at least; the words of the factors are the duplicate spans. Neighbouring pieces with the same
reference document that overlap by a window less one are one factor.

An anchor of over ``GROUP`` different contents, such as the edge of a passage that very many documents hold, isn't parsed in
one task: its windows are dealt out by 128 bits of hash, and each finds its first document in an index over all of them.

Blocks, not pairs of documents, meet in a shuffle, and copies are pre-aggregated to their smallest id. Texts go through a
shuffle once; those with blocks to parse, once more. Whole blocks are told apart by the hashes of anchor and content.

Defined results: a null text has no words; a document of fewer words than a window keeps all; rows that repeat an id
don't remove each other's words; a row with a null id neither loses words nor makes others lose any; other columns are
ignored. Very long texts are cut and parsed in time and memory in proportion to their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stash, text_mark

WINDOW = 50
GRAM = 20
#: Different contents of an anchor that are parsed in one task.
GROUP = 256

#: Odd multipliers of two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 4096)
        made = []
        for x in (base, pow(base, -1, 2**64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[base] = (made[0], made[1])
    return _powers[base]


class Rolling:
    """Hashes of any range of a word sequence."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        up, self.down = powers(base, n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def hashed(w: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, w), np.uint64, len(w))


def cut(w: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchors, contents, starts, windows) of the blocks of a document; starts are words, windows their numbers."""
    n = len(w) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h = hashed(w)
    first, second = (Rolling(h, b) for b in BASES)
    at = np.arange(len(w) - gram + 1)
    grams = first.ranges(at, at + gram)
    # by value, not by place: a word that repeats for pages makes one block
    least = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).min(axis=1)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    counts = np.diff(np.concatenate([starts, [n]]))
    return least[starts].view(np.int64), second.ranges(starts, starts + counts + window - 1).view(np.int64), starts, counts


def lists(parts: Iterable[np.ndarray], kind: pa.DataType) -> pa.Array:
    parts = list(parts)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int64)).cast(kind))


def blocks(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, mark, anchors, contents, starts, windows) of every row with a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                made = [cut(words(x.as_py()), window, gram) for x in part.column("text")]
                arrays = [lists((m[i] for m in made), k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *arrays], ["doc_id", "mark", "anchors", "contents", "starts", "windows"])

    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, mark long, anchors array<long>, contents array<long>, starts array<int>, windows array<int>").where("size(anchors) > 0")


def covered(n: int, spans: Iterable[tuple[int, int]]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge)[:-1] > 0


class Reference:
    """The blocks of one anchor, in the order of their documents, and an index of their windows."""

    def __init__(self, window: int):
        self.window, self.blocks, self.index = window, [], {}

    def parse(self, doc: int, w: list[bytes]) -> list[tuple[int, int, int]]:
        """Factors (start, stop, reference document) of a block of ``doc``, which then is a reference block itself."""
        size, known = self.window, self.index
        at = np.arange(len(w) - size + 1)
        keys = Rolling(hashed(w), BASES[0]).ranges(at, at + size).tolist()
        number, out, i = len(self.blocks), [], 0
        self.blocks.append((doc, w))
        while i < len(keys):
            held = [(b, p) for b, p in known.get(keys[i], ()) if self.blocks[b][1][p : p + size] == w[i : i + size]]
            found = next(((b, p) for b, p in held if self.blocks[b][0] < doc), None)
            if found is None:
                if not held:
                    known.setdefault(keys[i], []).append((number, i))
                i += 1
                continue
            ref, other = self.blocks[found[0]]
            stop, p = i + size, found[1] + size
            while stop < len(w) and p < len(other) and w[stop] == other[p]:
                stop, p = stop + 1, p + 1
            out.append((i, stop, ref))
            i = stop - size + 1
        return out


def factors(spans: Iterable[tuple[int, int, int]], window: int) -> list[tuple[int, int, int]]:
    """Pieces (start, stop, reference) joined to factors."""
    out: list[tuple[int, int, int]] = []
    for ref, start, stop in sorted((r, a, b) for a, b, r in spans):
        if out and out[-1][2] == ref and start <= out[-1][1] - (window - 1):
            out[-1] = (out[-1][0], max(stop, out[-1][1]), ref)
        else:
            out.append((start, stop, ref))
    return sorted(out)


SPANS = "array<struct<start: int, stop: int, ref: long>>"
DONE = "doc_id long, mark long, n_words long, n_removed long, n_factors long, kept_sha256 string, kept string"
#: What the parse leaves of a document: its digest, or its text and what is to be parsed of it.
PARSED = f"{DONE}, spans {SPANS}, text string, blocks array<struct<anchor: long, start: int, words: string>>, first array<long>, second array<long>, at array<int>, which array<int>"

_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ref", pa.int64())]))
_BLOCK = pa.list_(pa.struct([("anchor", pa.int64()), ("start", pa.int32()), ("words", pa.string())]))
_DIGEST = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())


def parse(rows: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Rows (doc_id, mark, text, pieces) whose pieces are whole factors get their digests; others what is to be parsed."""
    names = ["doc_id", "mark", "n_words", "n_removed", "n_factors", "kept_sha256", "kept", "spans", "text", "blocks", "first", "second", "at", "which"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                out: list[tuple] = []
                for text, pieces in zip(part.column("text").to_pylist(), part.column("pieces").to_pylist()):
                    w = words(text)
                    whole = [(p["start"], p["start"] + p["windows"] + window - 1, p["ref"]) for p in pieces or () if not p["open"]]
                    opened = [p for p in pieces or () if p["open"]]
                    if not opened:
                        out.append((*digest(w, whole, window, keep_text), [], None, None, *[np.zeros(0, np.int64)] * 4))
                        continue
                    cuts = [{"anchor": p["anchor"], "start": p["start"], "words": b" ".join(w[p["start"] : p["start"] + p["windows"] + window - 1]).decode()} for p in opened if not p["hot"]]
                    at = np.concatenate([np.zeros(0, np.int64), *(np.arange(p["start"], p["start"] + p["windows"]) for p in opened if p["hot"])])
                    hashes = []
                    if len(at):
                        h = hashed(w)
                        hashes = [Rolling(h, b).ranges(at, at + window).view(np.int64).tolist() for b in BASES]
                    # different windows of the text, and which of them each place has
                    number: dict[tuple[int, int], int] = {}
                    which = np.array([number.setdefault(x, len(number)) for x in zip(*hashes)], np.int64)
                    different = np.array(list(number), np.int64).reshape(-1, 2)
                    out.append((len(w), 0, 0, None, None, [{"start": a, "stop": b, "ref": r} for a, b, r in whole], text, cuts, different[:, 0], different[:, 1], at, which))
                columns = [pa.array([o[i] for o in out], k) for i, k in enumerate((*_DIGEST, _SPAN, pa.string(), _BLOCK))]
                columns += [lists((o[8 + i] for o in out), k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *columns], names)

    return rows.mapInArrow(run, PARSED)


def digest(w: list[bytes], spans: list[tuple[int, int, int]], window: int, keep_text: bool) -> tuple[int, int, int, str, str | None]:
    gone = covered(len(w), ((a, b) for a, b, _ in spans))
    n = int(gone.sum())
    kept = b" ".join([x for x, g in zip(w, gone.tolist()) if not g] if n else w)
    return len(w), n, len(factors(spans, window)), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None


def relative(groups: DataFrame, window: int) -> DataFrame:
    """(doc_id, mark, spans): factors of the blocks of each anchor; ``groups`` has the blocks of an anchor in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("blocks"):
                reference, out = Reference(window), []
                for b in sorted(group.as_py(), key=lambda b: (b["doc_id"], b["mark"], b["start"])):
                    spans = [{"start": b["start"] + x, "stop": b["start"] + y, "ref": r} for x, y, r in reference.parse(b["doc_id"], words(b["words"]))]
                    if spans:
                        out.append((b["doc_id"], b["mark"], spans))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), _SPAN))], ["doc_id", "mark", "spans"])

    return groups.select("blocks").mapInArrow(run, f"doc_id long, mark long, spans {SPANS}")


def finish(rows: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Digests of rows (doc_id, mark, text, spans, more, first, second, at, which, found): factors from whole blocks, from the
    parse of the others, and from the single windows that were found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 64):
                part = batch.slice(begin, 64)
                out = []
                for r in part.to_pylist():
                    spans = [(s["start"], s["stop"], s["ref"]) for x in (r["spans"], *(r["more"] or ())) for s in x]
                    if r["found"]:
                        found = {(x["first"], x["second"]): x["low"] for x in r["found"]}
                        known = [found.get(x) for x in zip(r["first"], r["second"])]
                        spans += [(a, a + window, known[i]) for a, i in zip(r["at"], r["which"]) if known[i] is not None]
                    out.append(digest(words(r["text"]), spans, window, keep_text))
                columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(_DIGEST)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *columns], [x.split()[0] for x in DONE.split(", ")])

    return rows.mapInArrow(run, DONE)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False, group: int = GROUP) -> DataFrame:
    """(doc_id, mark, n_words, n_removed, n_factors, kept_sha256, kept) of every row; kept is the text that is left, if asked for."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    cut_up = stash(blocks(rows, window, gram), "substring-blocks")
    zipped = F.explode(F.arrays_zip("anchors", "contents", "starts", "windows")).alias("b")
    flat = cut_up.select("doc_id", "mark", zipped).select("doc_id", "mark", F.col("b.anchors").alias("anchor"), F.col("b.contents").alias("content"), F.col("b.starts").alias("start"), F.col("b.windows").alias("windows"))

    # the index: anchors that two documents or more have
    shared = flat.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("content") == F.max("content")).alias("alike")).where("low < high").select("anchor", "low", "alike")
    # written, so that it is broadcast if small, and else joined without an aggregate below, when hot keys can be split
    shared = stash(shared, "substring-shared")
    met = stash(flat.join(shared, "anchor").where("NOT alike OR doc_id > low"), "substring-met")
    other = met.where("NOT alike")
    earliest = stash(other.groupBy("anchor", "content").agg(F.min("doc_id").alias("ref")), "substring-earliest")
    hot = stash(earliest.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > group).select("anchor", F.lit(True).alias("hot")), "substring-hot")
    marked = other.join(earliest, ["anchor", "content"]).join(hot, "anchor", "left").select("doc_id", "mark", "anchor", "start", "windows", "ref", (F.col("doc_id") == F.col("ref")).alias("open"), F.col("hot").isNotNull().alias("hot"))
    pieces = met.where("alike").select("doc_id", "mark", "anchor", "start", "windows", F.col("low").alias("ref"), F.lit(False).alias("open"), F.lit(False).alias("hot")).unionAll(marked)
    by_doc = pieces.distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "start", "windows", "ref", "open", "hot")).alias("pieces"))
    parsed = stash(parse(rows.join(by_doc, ["doc_id", "mark"], "left").select("doc_id", "mark", "text", "pieces"), window, keep_text), "substring-parsed")

    # blocks whose anchor has other contents: those of an anchor meet, each different one once, or their windows do
    waiting = parsed.where("text IS NOT NULL")
    groups = waiting.select("doc_id", "mark", F.explode("blocks").alias("b")).groupBy("b.anchor").agg(F.collect_set(F.struct("doc_id", "mark", F.col("b.start").alias("start"), F.col("b.words").alias("words"))).alias("blocks")).where("size(blocks) > 1")
    more = relative(groups, window).groupBy("doc_id", "mark").agg(F.collect_list("spans").alias("more"))
    single = waiting.select("doc_id", "mark", F.explode(F.arrays_zip("first", "second")).alias("w")).select("doc_id", "mark", "w.first", "w.second")
    index = single.groupBy("first", "second").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("first", "second", "low")
    found = single.join(stash(index, "substring-index"), ["first", "second"]).where("doc_id > low").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "second", "low")).alias("found"))
    done = finish(waiting.select("doc_id", "mark", "text", "spans", "first", "second", "at", "which").join(more, ["doc_id", "mark"], "left").join(found, ["doc_id", "mark"], "left"), window, keep_text)
    return parsed.where("text IS NULL").select(*done.columns).unionAll(done)
