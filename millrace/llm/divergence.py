"""Source divergence audit: how far the words of each source of a language are from those of its other sources and of the
language as a whole.

Single-pass in-memory indexing: a task reads its texts once and keeps the postings of a block, a count of occurrences and
documents for each (language, source, term), until they fill ``BLOCK_BYTES``; the block then leaves as a run in the order of
its terms, a row for each. Runs are dealt out by the hash of (language, term); each shard's runs are merged by the shuffle's sort, which
merges sorted spills by a heap, and a single pass over the merged stream adds neighbours up to frequencies, of which those of
terms in at least ``LEAST_DOCUMENTS`` documents of their language are kept.

With c occurrences of a kept term among a group's N, and V kept terms, the term's share is p = 1 + floor(10^9 (c + 5) /
(N + 5 V)). Two groups differ by the sum of \\|p - q\\| over all kept terms. Most terms are missing from most groups, where p is
a group's constant z, so a pair starts from what follows from the groups' histograms alone, as if no term stood in both, and
terms that stand in both stream by as corrections: the work on a term grows with the sources that have it.

Defined results: null text, language or source is ''. A text without terms still makes its group occur. A group of a
language without kept terms has the value 0 in all pairs. A language of one source has no pairs. Repeated rows count each.
Other columns are ignored. Memory grows with one text's different terms, and with the sources of one language, of which the
result has a row for every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stash

LEAST_DOCUMENTS = 30
SCALE, SMOOTH = 1_000_000_000, 5
TOP_TERMS = 50
#: Postings of a block, about so many bytes; and bytes of text that are cut into terms at once.
BLOCK_BYTES, PIECE_BYTES = 64 * 2**20, 4 * 2**20
#: Rows of an Arrow batch that a run leaves in.
BATCH = 20_000
#: Sources of a language on a side of one matrix of corrections, matrices that a task holds at once, and pairs of sources
#: that are corrected at once.
SIDE, MATRICES, PAIRS = 1024, 16, 1_000_000
#: Fixed value: what isn't a term, a run of ASCII letters and of whatever isn't ASCII; of UTF-8 bytes.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

_RUN = "lang string, term string, docs long, sources array<string>, counts array<long>"


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and the sums of each one's values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v for v in values))


def text(values: pa.Array) -> pa.Array:
    return values.cast(pa.string(), safe=False)


class Block:
    """Postings in memory: for each term, in dictionary codes, and group its occurrences and documents."""

    def __init__(self) -> None:
        self.groups: dict[tuple[bytes, bytes], int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, rows: pa.RecordBatch) -> None:
        """Take in the terms of some texts."""
        names = zip(*(rows.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "source")))
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in names], np.int64)
        lists = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(rows.column("text")).cast(pa.binary()), GAP, " "), " ")
        terms, row = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.greater(pc.binary_length(terms), 0)
        coded, row = terms.filter(full).dictionary_encode(), row.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)
        codes, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        if not n:
            return
        # once for each document and term, then for each group and term
        keys, counts = summed(row * n + codes, np.ones(len(codes), np.int64))
        keys, counts, docs = summed(group[keys // n] * n + keys % n, counts, np.ones(len(keys), np.int64))
        self.parts.append((pa.DictionaryArray.from_arrays(pa.array((keys % n).astype(np.int32)), coded.dictionary), keys // n, counts, docs))
        self.held += coded.dictionary.nbytes + 28 * len(keys)

    def run(self) -> Iterator[pa.RecordBatch]:
        """The block's postings in the order of language, term and source, a row for each language and term."""
        if self.parts:
            whole = pa.chunked_array([p[0] for p in self.parts]).unify_dictionaries()
            terms, n = whole.chunk(0).dictionary, len(whole.chunk(0).dictionary)
            codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in whole.chunks]).astype(np.int64)
            group, counts, docs = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2, 3))
            place, names = np.empty(n, np.int64), sorted(self.groups)
            place[pc.sort_indices(terms).to_numpy(zero_copy_only=False)] = np.arange(n)
            langs = sorted({lang for lang, _ in names})
            at = {x: k for k, x in enumerate(names)}
            rank = np.array([at[x] for x in self.groups], np.int64)
            lang = np.array([langs.index(x) for x, _ in names], np.int64)
            # (language, term, group) as one number: groups are in the order of their languages
            rank = rank[group]
            keys, counts, docs = summed((lang[rank] * n + place[codes]) * len(names) + rank, counts, docs)
            rank, keys = keys % len(names), keys // len(names)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            heads, back = keys[starts], np.empty(n, np.int64)
            back[place] = np.arange(n)
            offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
            columns = [
                text(pa.array(langs, pa.binary()).take(pa.array(heads // n))), text(terms.take(pa.array(back[heads % n]))), pa.array(np.add.reduceat(docs, starts)),
                pa.ListArray.from_arrays(offsets, text(pa.array([s for _, s in names], pa.binary()).take(pa.array(rank)))), pa.ListArray.from_arrays(offsets, pa.array(counts)),
            ]
            made = pa.RecordBatch.from_arrays(columns, ["lang", "term", "docs", "sources", "counts"])
            for k in range(0, made.num_rows, BATCH):
                yield made.slice(k, BATCH)
        self.__init__()


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, term, docs, sources, counts): the runs of all blocks, each in the order of language and term: documents of the
    language, and occurrences in each of its sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                following = max(at + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
                block.add(batch.slice(at, following - at))
                at = following
                if block.held > block_bytes:
                    yield from block.run()
        yield from block.run()

    return docs.mapInArrow(run, _RUN)


def merged(rows: pa.Table, least: int) -> tuple[pa.RecordBatch, pa.Table]:
    """The frequencies of the terms in ``rows`` of runs, merged in their order, and the rows of the last term, which may go on."""
    rows = rows.combine_chunks()
    lang, term = (rows.column(c).cast(pa.binary()).combine_chunks() for c in ("lang", "term"))
    differ = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], 1 + np.flatnonzero(differ)])
    last, starts = rows.slice(starts[-1]), starts[:-1]
    done = rows.slice(0, rows.num_rows - last.num_rows)
    sizes = np.diff(np.append(starts, done.num_rows))
    docs = done.column("docs").to_numpy().astype(np.int64)
    stays = np.add.reduceat(docs, starts) >= least if len(starts) else np.zeros(0, bool)
    some = done.filter(pa.array(np.repeat(stays, sizes))).combine_chunks()
    group = np.repeat(np.arange(stays.sum()), sizes[stays])
    sources, counts = (pa.concat_arrays(some.column(c).chunks) if some.num_rows else pa.array([], some.schema.field(c).type) for c in ("sources", "counts"))
    coded = sources.flatten().dictionary_encode()
    n = max(1, len(coded.dictionary))
    owner = group[pc.list_parent_indices(sources).to_numpy(zero_copy_only=False).astype(np.int64)] if len(group) else np.zeros(0, np.int64)
    keys, sums = summed(owner * n + coded.indices.to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    offsets = np.searchsorted(keys // n, np.arange(stays.sum() + 1))
    heads, total = pa.array(starts[stays]), np.concatenate([[0], np.cumsum(sums)])
    columns = [
        text(lang.take(heads)), text(term.take(heads)), pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), coded.dictionary.take(pa.array(keys % n))), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sums, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "n", "sources", "counts"]), last


def frequencies(runs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, n, sources, counts) of the kept terms: occurrences in the language, and in each source that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                made, open_ = merged(pa.concat_tables([open_, rows]) if open_ else rows, least)
                yield made
        if open_:
            # a row behind all others closes the last term
            end = pa.table([pa.array([""], t) if t == pa.string() else pa.array([0 if t == pa.int64() else []], t) for t in open_.schema.types], schema=open_.schema)
            yield merged(pa.concat_tables([open_, end]), least)[0]

    in_order = runs.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return in_order.mapInArrow(run, "lang string, term string, n long, sources array<string>, counts array<long>")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), in whole numbers that no corpus outgrows; null without kept terms."""
    wide = lambda c: c.cast("decimal(24,0)")
    whole = F.call_function("div", wide(count + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + kept * SMOOTH))
    return F.when(kept > 0, 1 + whole)


def groups(docs: DataFrame, words: DataFrame, flat: DataFrame) -> DataFrame:
    """(lang, source, at, total, lang_total, kept, z) of every group that occurs; ``at``: its place among the language's
    sources; z: the share of a term that it doesn't have."""
    langs = words.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    sums = flat.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    found = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    found = found.na.fill(0, ["total", "lang_total", "kept"])
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return found.select("lang", "source", at.alias("at"), "total", "lang_total", "kept", F.coalesce(share(F.lit(0), F.col("total"), F.col("kept")), F.lit(0)).alias("z"))


def apart(groups_: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: each pair as if no term stood in both of its groups, in two rows, one from each side."""
    bars = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("bars"))
    others = groups_.groupBy("lang").agg(F.collect_list(F.struct("source", "z")).alias("others"))
    rows = groups_.select("lang", "source", "kept", "z").join(bars, ["lang", "source"], "left").join(others, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, source, kept, z, own, rest in zip(*(batch.column(c) for c in ("lang", "source", "kept", "z", "bars", "others"))):
                name, kept, z, own = source.as_py(), kept.as_py(), z.as_py(), own.as_py() or []
                pairs = [(x["source"], x["z"]) for x in rest.as_py() if x["source"] != name]
                own.sort(key=lambda x: x["p"])
                p, n = (np.array([x[k] for x in own], np.int64) for k in ("p", "n"))
                far = np.array([x for _, x in pairs], np.int64)
                below = np.searchsorted(p, far)
                terms, mass = (np.concatenate([[0], np.cumsum(x)]) for x in (n, n * p))
                # the sum over the own terms of |p - far|, less what stands for them in the constant part
                value = far * terms[below] - mass[below] + (mass[-1] - mass[below]) - far * (terms[-1] - terms[below]) - terms[-1] * np.abs(z - far)
                first = np.array([name < x for x, _ in pairs], bool)
                value += np.where(first, kept * np.abs(z - far), 0)
                low, high = ([min(name, x) for x, _ in pairs], [max(name, x) for x, _ in pairs])
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(pairs), pa.string()), pa.array(low, pa.string()), pa.array(high, pa.string()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])

    return rows.mapInArrow(run, "lang string, a string, b string, value long")


def corrections(shares: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: what terms in both groups change, summed over a task's terms."""
    terms = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "source", "p", "z")).alias("own")).where(F.size("own") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        names: dict[str, dict[int, str]] = {}

        def done() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), m in sums.items():
                one, two = np.nonzero(m)
                a, b = ([names[lang][x + k * SIDE] for x in at.tolist()] for at, k in ((one, i), (two, j)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(map(min, a, b), pa.string()), pa.array(map(max, a, b), pa.string()), pa.array(m[one, two], pa.int64())], ["lang", "a", "b", "value"])
            sums.clear()

        for batch in batches:
            lists = batch.column("own")
            x, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            at, p, z = (np.asarray(x.field(k)).astype(np.int64) for k in ("at", "p", "z"))
            coded = batch.column("lang").dictionary_encode()
            langs = coded.dictionary.to_pylist()
            term, lang = np.repeat(np.arange(len(sizes)), sizes), np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            for k in np.unique(lang * (at.max() + 1) + at, return_index=True)[1].tolist() if len(at) else ():
                names.setdefault(langs[lang[k]], {})[int(at[k])] = x.field("source")[k].as_py()
            order = np.lexsort((at, term))
            at, p, z = at[order], p[order], z[order]
            # each of a term's sources meets those behind it
            behind = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(at)) - 1
            ends = np.cumsum(behind)
            begin = 0
            while begin < len(at):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
                many = behind[begin:end]
                i = np.repeat(np.arange(begin, end), many)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                more = np.abs(p[i] - p[j]) - np.abs(p[i] - z[j]) - np.abs(z[i] - p[j]) + np.abs(z[i] - z[j])
                wide = int(at.max()) // SIDE + 1
                tile = (lang[i] * wide + at[i] // SIDE) * wide + at[j] // SIDE
                for t in np.unique(tile).tolist():
                    here = np.flatnonzero(tile == t)
                    key = (langs[t // wide // wide], t // wide % wide, t % wide)
                    m = sums.setdefault(key, np.zeros((SIDE, SIDE), np.int64))
                    np.add.at(m, (at[i[here]] % SIDE, at[j[here]] % SIDE), more[here])
                    if len(sums) > MATRICES:
                        yield from done()
                begin = end
        yield from done()

    return terms.mapInArrow(run, "lang string, a string, b string, value long")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against every other one of its language (``pair``), and the terms
    whose share in it is most above that in the language (``term``, ``top`` at most); greatest values first."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    words = stash(frequencies(blocks(texts, block_bytes), least), "divergence-words")
    flat = words.select("lang", "term", "n", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "n", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    every = stash(groups(texts, words, flat), "divergence-groups")
    met = flat.join(every, ["lang", "source"])
    shares = stash(met.select("lang", "term", "source", "at", "z", share(F.col("count"), F.col("total"), F.col("kept")).alias("p"), share(F.col("n"), F.col("lang_total"), F.col("kept")).alias("q")), "divergence-shares")
    sums = apart(every, shares).unionAll(corrections(shares)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = sums.select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionAll(above.select("*", rank).where(F.col("rank") <= top))
