"""Byte-level BPE: ids, decoded text and token counts of whole texts, exactly as the tokenizers library gives them.

Leaves. A text is cut before each single space that stands between two characters that aren't white space. The
pre-tokenizer always has a boundary there: only its white-space alternatives run across white space, and those can't
start before it; every other alternative takes a space only as its first character. So the pieces' ids, joined, are the
text's ids. The library encodes each piece that a worker hasn't met lately; others come from a bounded cache.

Tree concatenation (:func:`Encoder.tree`), for every text longer than ``LEAF``: it is halved down to leaves, and the
leaves of all texts of a batch are encoded together. Then halves are joined, level by level. At each join a window around
it is encoded anew. It agrees with one side where both have the same tokens between two of the boundaries proven above;
or, in text without such boundaries, over ``AGREE`` bytes or more of letters or digits only: inside such a run the
pre-tokenizer has no boundary, and a BPE encoding is right when each pair of neighbouring tokens is, so the tokens may
change over there. The window grows until both sides agree, at last to both halves, which is exact.

Words. Where only tokens are counted, texts are cut finer (``WORDS``), each cut being a boundary of the pre-tokenizer as
well: between a character that isn't white space and a space or line feed, as white space is only first in an alternative
or all of it; between a letter and a sign such as a point, as no alternative has both in this order; and behind a line
feed that stands alone between characters that aren't white space. The tokens of each word are counted once as long as a
worker keeps it. A word that is one piece of the pre-tokenizer (``ONE``) goes to the library's BPE model as it is.

Overlap resynchronisation (:func:`Encoder.count`), for texts longer than ``CHUNK``: overlapping chunks are encoded, by
words or, where some are long, with offsets, and spliced at a start, common to both, that follows on a character that
isn't white space and has a space or line feed, or inside a run over which both agree; where an overlap has neither, it is
widened, at last to the last boundary.

Defined results: a null text is empty and has no tokens; repeated rows each get a result; special strings inside texts
become special tokens, as is the library's default; other columns are ignored. Very long texts take memory in proportion
to their length, and the joins only re-encode windows around their halves' ends.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_arrow

LEAF = 4_096
WINDOW = 64
AGREE = 32
CHUNK = 32_768
OVERLAP = 1_024
#: Pieces that a worker keeps: the newest half, and the half before it, of which those that are met again move on.
CACHED = 200_000
#: Words whose number of tokens a worker keeps, in halves as well; 319,276 of check_l took 29 MB.
COUNTED = 400_000
#: Characters of the longest piece or word that is kept.
KEPT = 64

SAFE = re.compile(r"(?<=\S)(?= \S)")
#: A piece that stays one between any others of its kind; special strings are left to the library one by one.
SAFE_PIECE = re.compile(r" [^\s<>|](?:[^<>|]*[^\s<>|])?")
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?#$%&*"
#: Words, which joined are the text. Each ends at a boundary, so the next begins at one, and none but a lone line feed ends in white space.
WORDS = re.compile(rf" ?[{_LETTERS}]++(?=[ \n{_SIGNS}]|\Z)|\n(?=\S)|[{_SIGNS}]++(?=[ \n]|\Z)|(?s:.)+?(?:\Z|(?<=\S)(?=[ \n]))")
ONE = re.compile(rf" ?[{_LETTERS}]+|[{_SIGNS}]+|\n")
#: Special strings that ``WORDS`` never cuts and that no word of ``ONE`` holds.
UNCUT = re.compile(rf"[^\s{_SIGNS}]*[<>|][^\s{_SIGNS}]*")
SPACED = re.compile(r"(?<=\S)(?=[ \n])")


class Encoder:
    """One per worker process. ``path``: a tokenizers file of a byte-level BPE without normalizer or prefix space."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, agree: int = AGREE, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.leaf, self.window, self.chunk, self.overlap = leaf, window, chunk, overlap
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}
        self.older_counts: dict[str, int] = {}
        self.model = self.lib.model
        added = {t.content for t in self.lib.get_added_tokens_decoder().values()}
        # a run that is longer than any special string isn't inside one
        self.agree = max(agree, 1 + max((len(t.encode()) for t in added), default=0))
        self.fine = all(map(UNCUT.fullmatch, added))
        # each character of a byte-level token stands for one byte: printable Latin-1 for itself, the others for those from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of_char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.of_byte = {b: c for c, b in of_char.items()} | {0: "\0"}
        self.bytes = [b""] * self.lib.get_vocab_size(with_added_tokens=True)
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = token.encode() if token in added else bytes(of_char[c] for c in token)
        self.width = np.array([len(x) for x in self.bytes], np.int64)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """The ids of each text as little-endian unsigned 32-bit integers, and the joins of its tree."""
        leaves = [self.halved(t) for t in texts]
        parts = iter(self.pieced([x for xs in leaves for x in xs]))
        return [self.tree(xs, [next(parts) for _ in xs]) for xs in leaves]

    def pieced(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, put together from its pieces."""
        cut = [SAFE.split(t) for t in texts]
        new = {p for pieces in cut for p in pieces if p not in self.cache}
        if len(self.cache) + len(new) > CACHED // 2:
            self.cache, self.older = {}, self.cache
            new = {p for pieces in cut for p in pieces}
        cache, older = self.cache, self.older
        fresh = {p: older[p] for p in new if p in older}
        fresh |= self.together([p for p in new if p not in older and len(p) <= 64 and SAFE_PIECE.fullmatch(p)])
        other = [p for p in new if p not in fresh]
        fresh |= zip(other, (np.array(x, "<u4").tobytes() for x in self.plain(other)))
        if len(fresh) <= CACHED // 2:
            cache |= {p: x for p, x in fresh.items() if len(p) <= 64}
        return [b"".join([cache[p] if p in cache else fresh[p] for p in pieces]) for pieces in cut]

    def together(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces that begin with their only space: as one text, of which each is a piece."""
        out: dict[str, bytes] = {}
        for at in range(0, len(pieces), 4_096):
            part = pieces[at : at + 4_096]
            ids = np.array(self.plain(["".join(part)])[0], "<u4")
            ends = 4 * (np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) for p in part])) + 1)
            raw, begin = ids.tobytes(), 0
            for p, end in zip(part, ends.tolist()):
                out[p], begin = raw[begin:end], end
        return out

    def decode(self, ids: bytes) -> str:
        """As the library decodes without skipping special tokens: the tokens' bytes, joined."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def words(self, text: str) -> list[str]:
        return WORDS.findall(text) if self.fine else SAFE.split(text)

    def counted(self, cut: list[list[str]]) -> list[list[int]]:
        """How many tokens each word of each text has."""
        new = set().union(*cut).difference(self.counts)
        if len(self.counts) + len(new) > COUNTED // 2:
            self.counts, self.older_counts = {}, self.counts
            new = set().union(*cut)
        counts, older = self.counts, self.older_counts
        counts |= {w: older[w] for w in new if w in older}
        one = [w for w in new if w not in counts and len(w) <= KEPT and ONE.fullmatch(w)] if self.fine else []
        counts |= zip(one, self.modelled(one))
        other = [w for w in new if w not in counts]
        counts |= zip(other, map(len, self.plain(other)))
        out = [list(map(counts.__getitem__, words)) for words in cut]
        for w in other:
            if len(w) > KEPT:
                del counts[w]
        if len(counts) > COUNTED // 2:
            self.counts = {}
        return out

    def modelled(self, words: list[str]) -> Iterator[int]:
        """The tokens of words that are one piece each, in the characters that stand for their bytes."""
        return map(len, map(self.model.tokenize, "\0".join(words).encode().decode("latin-1").translate(self.of_byte).split("\0") if words else []))

    def halved(self, text: str) -> list[str]:
        """The leaves of a text's tree, a power of two of them, so that the same halves are joined again."""
        leaves = [text]
        while max(map(len, leaves)) > self.leaf:
            leaves = [half for x in leaves for half in (x[: len(x) // 2], x[len(x) // 2 :])]
        return leaves

    def tree(self, leaves: list[str], ids: list[bytes]) -> tuple[bytes, int]:
        """Tree concatenation of a text's leaves: its ids, and how many joins it took."""
        parts, joins = list(zip(leaves, (np.frombuffer(x, "<u4") for x in ids))), 0
        while len(parts) > 1:
            joins += len(parts) // 2
            parts = [(a + b, self.join(a, i, b, j)) for (a, i), (b, j) in zip(parts[::2], parts[1::2])]
        return parts[0][1].tobytes(), joins

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        size = self.window
        while size < max(len(left), len(right)):
            a, b = left[-size:], right[:size]
            text, cut = (a + b).encode(), len(a.encode())
            ids = np.array(self.plain([a + b])[0], "<u4")
            mine = self.starts(ids, 0)
            # tokens of either side within the window; places are bytes from its start
            before, after = left_ids[-cut:] if cut else left_ids[:0], right_ids[: len(text) - cut]
            before = before[np.cumsum(self.width[before][::-1])[::-1] <= cut]
            after = after[np.cumsum(self.width[after]) <= len(text) - cut]
            # a window that takes in a whole half begins or ends with it
            x = (0, 0) if len(a) == len(left) else self.same(before, self.starts(before, cut - int(self.width[before].sum())), ids, mine, a, 0, -2)
            y = (len(ids), len(after)) if len(b) == len(right) else self.same(ids, mine, after, self.starts(after, cut), b, cut, 0)
            x = x or self.agreed(before, self.starts(before, cut - int(self.width[before].sum())), ids, mine, text, 0, (0, cut))
            y = y or self.agreed(ids, mine, after, self.starts(after, cut), text, 0, (cut, len(text)))
            if x and y and x[1] <= y[0]:
                return np.concatenate([left_ids[: 0 if len(a) == len(left) else len(left_ids) - len(before) + x[0]], ids[x[1] : y[0]], right_ids[y[1] :] if len(b) < len(right) else right_ids[:0]])
            size *= 2
        return np.frombuffer(self.pieced([left + right])[0], "<u4")

    def same(self, p: np.ndarray, ps: list[int], q: np.ndarray, qs: list[int], text: str, base: int, which: int) -> tuple[int, int] | None:
        """(i, j): p up to i may go on as q from j, as both have the same tokens between two neighbouring boundaries of
        ``text``, of which ``which`` is the first; i is where the first of them stands."""
        found = [m.start() for m in SAFE.finditer(text)][which:][:2]
        if len(found) < 2:
            return None
        begin, end = (base + len(text[:at].encode()) for at in found)
        (i, k), (j, n) = ((bisect_left(s, begin), bisect_left(s, end)) for s in (ps, qs))
        return (i, j) if k < len(ps) and n < len(qs) and ps[i] == qs[j] == begin and ps[k] == qs[n] == end and np.array_equal(p[i:k], q[j:n]) else None

    def starts(self, ids: list[int], at: int) -> list[int]:
        return [at, *(at + np.cumsum(self.width[ids])).tolist()]

    def agreed(self, p: np.ndarray | list[int], ps: list[int], q: np.ndarray | list[int], qs: list[int], text: bytes, base: int, span: tuple[int, int]) -> tuple[int, int] | None:
        """(i, j): p up to i may go on as q from j, as both have the same tokens around that start."""
        i = bisect_left(ps, span[0])
        run = None
        for i in range(i, len(p)):
            if ps[i + 1] > span[1]:
                break
            j = bisect_left(qs, ps[i])
            if j < len(q) and qs[j] == ps[i] and q[j] == p[i]:
                run = run if run is not None else ps[i]
                if ps[i + 1] - run >= self.agree and i > 0 and ps[i] > run and one_class(text[run - base : ps[i + 1] - base]):
                    return i, j
                # a run that isn't of one class starts again at its last token
                if ps[i + 1] - run >= 4 * self.agree:
                    run = ps[i]
            else:
                run = None
        return None

    def count(self, text: str) -> int:
        """Tokens of a text longer than a chunk, by overlapping chunks."""
        total, at = 0, 0  # up to at, a boundary of the whole text's encoding, all is counted
        first = self.chunked(text, 0, min(len(text), self.chunk))
        while True:
            begin, end, starts, before, _ = first
            if end == len(text):
                return total + before[-1] - before[bisect_left(starts, at)]
            overlap = self.overlap
            while True:
                begin2 = max(at, end - overlap)
                following = self.chunked(text, begin2, min(len(text), begin2 + max(self.chunk, 2 * overlap)))
                cut = self.spliced(text, first, following)
                if cut is not None:
                    break
                if begin2 == at:  # no boundary in all of the chunk: encode twice as far from the last one
                    following = self.chunked(text, at, min(len(text), at + 2 * (end - at)))
                    cut = at
                    break
                overlap *= 2
            total += before[bisect_left(starts, cut)] - before[bisect_left(starts, at)]
            at, first = cut, following

    def spliced(self, text: str, first: tuple, following: tuple) -> int | None:
        """Where the first chunk's encoding may go on as the following one's."""
        end, begin = first[1], following[0]
        common = set(first[2]).intersection(following[2])
        cut = next((p for p in sorted(common) if begin < p < end - 1 and SPACED.match(text, p)), None)
        if cut is None and begin < end and first[4] and following[4] and text[begin:end].isascii():
            run = self.agreed(first[4], first[2], following[4], following[2], text[begin:end].encode(), begin, (begin, end))
            cut = first[2][run[0]] if run else None
        return cut

    def chunked(self, text: str, begin: int, end: int) -> tuple[int, int, list[int], Sequence[int], list[int] | None]:
        """(begin, end, starts and the end, tokens before each, ids): of words, without ids, or of tokens where a word is long."""
        words = self.words(text[begin:end])
        if max(map(len, words), default=0) <= KEPT:
            return begin, end, [*accumulate(map(len, words), initial=begin)], [*accumulate(self.counted([words])[0], initial=0)], None
        e = self.lib.encode(text[begin:end], add_special_tokens=False)
        # a token inside a character has that character's offset, and so isn't taken for a start: starts only grow
        return begin, end, [*accumulate((begin + o[0] for o in self.byte_starts(e, text[begin:end])), max), end], range(len(e.ids) + 1), e.ids

    def byte_starts(self, e, text: str) -> list[tuple[int, int]]:
        """Where each token starts: the library trims a leading space off its offsets, so they follow from the widths."""
        if text.isascii():
            return [(x, 0) for x in self.starts(e.ids, 0)[:-1]]
        of_byte = np.repeat(np.arange(len(text)), [len(c.encode()) for c in text])
        return [(int(of_byte[x]), 0) for x in self.starts(e.ids, 0)[:-1]]


def one_class(x: bytes) -> bool:
    text = x.decode("utf-8", "ignore")
    return text.isalpha() or text.isdecimal()


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def sent(docs: DataFrame, path: str) -> str:
    """``path``, after its file has been sent along for executors that don't have it."""
    docs.sparkSession.sparkContext.addFile(path)
    return path


def local(path: str) -> str:
    """``path`` where executors have it, else the copy that :func:`sent` sent."""
    import os

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def per_text(docs: DataFrame, schema: str, rows: Callable[[list[str]], Iterable[tuple]], step: int = 256) -> DataFrame:
    """doc_id and what ``rows`` gives for each text, over batches of bounded size."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                got = list(rows([x or "" for x in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, f"doc_id long, {schema}")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids as little-endian unsigned 32-bit integers, and their decoding."""
    sent(docs, path)

    def rows(texts: list[str]) -> Iterable[tuple]:
        e = encoder(local(path))
        return ((x, e.decode(x)) for x, _ in e.ids(texts))

    return per_text(docs, "ids binary, decoded string", rows)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_joins): :func:`encode` with digests taken where the ids are made,
    and the joins of each text's tree."""
    sent(docs, path)

    def rows(texts: list[str]) -> Iterable[tuple]:
        e = encoder(local(path))
        return ((len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(e.decode(x).encode()).hexdigest(), n) for x, n in e.ids(texts))

    return per_text(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long", rows)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    sent(docs, path)

    def rows(texts: list[str]) -> Iterable[tuple]:
        e = encoder(local(path))
        short = iter(e.counted([e.words(t) for t in texts if len(t) <= e.chunk]))
        for t in texts:
            n = sum(next(short)) if len(t) <= e.chunk else e.count(t)
            yield len(t.encode()), n, n > limit

    return per_text(docs, "n_bytes long, n_tokens long, over_limit boolean", rows)
