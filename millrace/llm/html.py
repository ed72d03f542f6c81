"""Main text of web pages, by nearest-URL page differencing.

A page is cut into lines, one per block of its markup. Every page is paired with the page of its host whose URL path is
nearest, among those that have other lines; the lines of both are aligned by longest common subsequence, and the lines
that they share are deleted, as a site's pages share them. Two things hold against that: what stands in an article or main
element stays, as a quoted passage or a licence that two articles share is part of both; and of the lines that
differencing leaves, those that elements, roles and class names mark as menus, headers, footers, sidebars, notices,
adverts, forms or comments go as well, as a page may have its own. Scripts, styles and the like are no lines at all.

A class name marks a frame by its last word, words for mere boxes aside; layout-with-sidebar and ad-free don't. An element
that is marked only so, or a form, is no frame if it holds the main element, or more than half of the text of the article
that it stands in; outside articles, if it holds more than half of the page's text and no article stands outside it.
Comments are always frames.

Nearest is the neighbour in the order of (host, path) with the longer common path. Pages with equal lines, as when a page
is crawled twice, are one in that order, so none is compared with its own copy. The order is a range sort with a running
number, dealt out in runs of ``RUN`` numbers and their two outer neighbours, so no host, however large, has to fit a
task. Only hashes of lines are compared; the texts, packed, meet what was shared in one join.

Defined results: a null html is empty and has no text; a page without another in its host shares nothing; repeated rows
each get a result; unclosed and crossing tags end where their parents do; a null url belongs to an empty host; other
columns are ignored. Very long pages: the alignment takes memory in proportion to the lines of both pages, and time to
their product once equal ends and lines that the other page lacks are set aside.
"""

from __future__ import annotations

import itertools
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stash

#: Elements whose content isn't text for readers.
SILENT = frozenset("script style noscript template svg iframe object canvas head title select option button textarea datalist".split())
#: Elements whose content is a page's frame.
FRAME = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr math semantics maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover annotation annotation-xml".split())
#: Elements that end with an open one of their kind, as their end tags may be left out.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Blocks before which an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of class, id and role attributes that mark a page's frame; those that always do; words for boxes, which may stand behind
#: them; and words before them that make a name describe something else.
FRAME_WORDS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent notice newsletter subscribe popup modal share sharing social related comment comments disqus contentinfo complementary search".split())
FIRM_WORDS = frozenset("comment comments disqus related".split())
BOX_WORDS = frozenset("area bar block body bottom box button buttons column container content footer form group header holder inner item items left link links list outer panel primary right row secondary section signup top widget widgets wrap wrapper".split())
NOT_WORDS = frozenset("no not non has with without".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[!?][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_RAW_END = {k: re.compile(rf"</{k}\b[^>]*(?:>|$)", re.I) for k in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "canvas", "object", "annotation", "annotation-xml")}
_SPACE = re.compile(r"\s+")

FRAMED, ARTICLE, OPEN = range(3)
#: Pages of so many numbers in a row are aligned by one task.
RUN = 256
#: Alignments of up to so many pairs of lines take one table.
CELLS = 1_000_000


FIRM, SOFT = 1, 2


def framing(attributes: str) -> int:
    """Whether class, id or role mark a frame: 0, SOFT, or FIRM."""
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in _WORD.findall(name) if len(w) > 1]
            while len(words) > 1 and words[-1] in BOX_WORDS:
                words.pop()
            if words and words[-1] in FRAME_WORDS and NOT_WORDS.isdisjoint(words[:-1]):
                if words[-1] in FIRM_WORDS:
                    return FIRM
                found = SOFT
    return found


@dataclass
class Part:
    """A frame or article of a page: ``kind`` FIRM, SOFT or 0 for an article; the innermost frame and article that it stands in;
    its characters, and those of them that stand in articles."""

    kind: int
    frame: int
    article: int
    main: bool = False
    chars: int = 0
    articles: int = 0


def lines(html: str) -> list[tuple[str, int]]:
    """(text, verdict) of each line of a page, in page order; the verdict is what markup says: FRAMED, ARTICLE or OPEN."""
    found: list[tuple[str, int, int]] = []  # text, and the innermost frame and article, -1 for none
    made: list[Part] = []
    stack: list[tuple[str, tuple[bool, int, int]]] = []  # open elements, and what holds inside: silence, frame, article
    parts: list[str] = []
    outside = (False, -1, -1)
    state = outside

    def flush() -> None:
        if parts and not state[0]:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                found.append((text, state[1], state[2]))
        parts.clear()

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                if name not in INLINE or stack[depth][1] != state:
                    flush()
                # formatting doesn't end the blocks that were opened in it
                if name in INLINE and any(x not in INLINE for x, _ in stack[depth + 1 :]):
                    del stack[depth]
                else:
                    del stack[depth:]
                state = stack[-1][1] if stack else outside
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else n
            if name not in INLINE:
                flush()
            continue
        if name in CLOSES or name in ENDS_P:
            ending = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            block = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), None)
            if block is not None and stack[block][0] in ending:
                flush()
                del stack[block]
                state = stack[-1][1] if stack else outside
        if name not in INLINE:
            flush()
        if name in VOID or m[3].rstrip().endswith("/") and name not in MAIN | FRAME and name in INLINE:
            continue
        silent, frame, article = state
        inside = state
        if silent or name in SILENT:
            inside = (True, frame, article)
        elif name in MAIN:
            if name == "main":
                at_frame = frame
                while at_frame >= 0:
                    made[at_frame].main, at_frame = True, made[at_frame].frame
            made.append(Part(0, frame, article))
            inside = (False, frame, len(made) - 1)
        elif name not in ("html", "body"):
            # an article's own header holds its title
            firm = name in FRAME and name != "form" or name == "header" and article < 0
            kind = FIRM if firm else framing(m[3]) or (SOFT if name == "form" else 0)
            if kind:
                made.append(Part(kind, frame, article))
                inside = (False, len(made) - 1, article)
        if inside != state:
            flush()
        stack.append((name, inside))
        state = inside
    flush()
    return judged(found, made)


def judged(found: list[tuple[str, int, int]], made: list[Part]) -> list[tuple[str, int]]:
    """Lines with their verdict, once it is known what each frame holds."""
    total = articles = 0
    for text, frame, article in found:
        firm, at = False, frame
        while at >= 0:
            firm, at = firm or made[at].kind == FIRM, made[at].frame
        counted = len(text) if article >= 0 and not firm else 0
        total, articles = total + len(text), articles + counted
        for at, above in ((frame, "frame"), (article, "article")):
            while at >= 0:
                made[at].chars += len(text)
                made[at].articles += counted
                at = getattr(made[at], above)
    stays: list[bool] = []  # whether a part stands in no frame, itself included; those around it come first
    for p in made:
        frame = p.kind == FIRM
        if p.kind == SOFT and not p.main:
            frame = 2 * p.chars <= made[p.article].chars if p.article >= 0 else 2 * p.chars <= total or p.articles < articles
        stays.append(not frame and (p.frame < 0 or stays[p.frame]))
    return [(t, FRAMED if f >= 0 and not stays[f] else ARTICLE if a >= 0 else OPEN) for t, f, a in found]


def common(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Positions of ``x`` in a longest common subsequence with ``y``: by one table, or in halves where it would be large."""
    if not len(x) or not len(y):
        return []

    def row(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
        longest = np.zeros(len(y) + 1, np.int32)
        yield longest
        for v in x:
            following = np.zeros_like(longest)
            np.maximum.accumulate(np.maximum(longest[1:], np.where(y == v, longest[:-1] + 1, 0)), out=following[1:])
            longest = following
            yield longest

    def last(rows: Iterator[np.ndarray]) -> np.ndarray:
        return deque(rows, maxlen=1)[0]

    if len(x) == 1:
        return [0] if (y == x[0]).any() else []
    if len(x) * len(y) > CELLS:
        # the split of y at which the halves of x have most in common with its parts
        half = len(x) // 2
        above, below = last(row(x[:half], y)), last(row(x[: half - 1 : -1], y[::-1]))
        cut = int((above + below[::-1]).argmax())
        return common(x[:half], y[:cut]) + [half + i for i in common(x[half:], y[cut:])]
    longest = np.stack(list(row(x, y)))
    i, j, out = len(x), len(y), []
    while i and j:
        if longest[i, j] == longest[i - 1, j]:
            i -= 1
        elif longest[i, j] == longest[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def shared(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``: equal ends first, then what the rest has in common."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    begin = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    end = min(int(differ[0]) if len(differ) else n, n - begin)
    x, y = a[begin : len(a) - end], b[begin : len(b) - end]
    at = np.flatnonzero(np.isin(x, y))
    middle = common(x[at], y[np.isin(y, x)])
    return [*range(begin), *(begin + int(at[i]) for i in middle), *range(len(a) - end, len(a))]


def hashed(found: list[tuple[str, int]]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t, _ in found], np.uint64).view(np.int64)


def addressed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, html) of every row."""
    rest = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)).alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def sign(host: str, hashes: np.ndarray) -> str:
    """Names the pages of a host that have equal lines."""
    return xxhash.xxh3_128_hexdigest(host.encode() + b"\0" + hashes.tobytes())


def hashes(pages: DataFrame) -> DataFrame:
    """(sign, host, path, hashes) of every page with lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                made = [hashed(lines(x.as_py())) for x in part.column("html")]
                signs = [sign(h, x) for h, x in zip(part.column("host").to_pylist(), made)]
                yield pa.RecordBatch.from_arrays([pa.array(signs, pa.string()), part.column("host"), part.column("path"), pa.array(made, pa.list_(pa.int64()))], ["sign", "host", "path", "hashes"])

    return addressed(pages).select("host", "path", "html").mapInArrow(run, "sign string, host string, path string, hashes array<long>").where("size(hashes) > 0")


def packed(pages: DataFrame) -> DataFrame:
    """(page_id, url, sign, texts) of every row: the lines that may stay, each behind the letter of its verdict, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                signs, texts = [], []
                for host, html in zip(part.column("host").to_pylist(), part.column("html")):
                    found = lines(html.as_py())
                    signs.append(sign(host, hashed(found)))
                    # a line has no line break, its white space being single spaces; framed lines only keep their places
                    texts.append(pack("\n".join("" if v == FRAMED else "ao"[v == OPEN] + t for t, v in found).encode()))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(signs, pa.string()), pa.array(texts, pa.binary())], ["page_id", "url", "sign", "texts"])

    return addressed(pages).select("page_id", "url", "host", "html").mapInArrow(run, "page_id long, url string, sign string, texts binary")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (sign, host, path, hashes) with their number in the order of (host, path, sign)."""
    ordered = stash(rows.repartitionByRange("host", "path", "sign").sortWithinPartitions("host", "path", "sign").withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}), "html-order")
    counts = {r.part: r.n for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    starts, total = [], 0
    for i in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(i, 0)
    return ordered.withColumn("number", F.get(F.array(*map(F.lit, starts)), F.col("part")).cast("long") + F.col("place")).drop("part", "place")


def common_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def differences(rows: DataFrame) -> DataFrame:
    """(sign, shared): positions of the lines that the pages of this sign share with their nearest page, if any."""
    one = rows.groupBy("sign").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.first("hashes").alias("hashes"))
    # a run also gets the page before it and the page behind it
    runs = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col("number") + d) / RUN)))
    dealt = numbered(one).withColumn("run", F.explode(runs)).repartition("run").sortWithinPartitions("run", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def align(near: list[dict]) -> tuple[str, list[int]] | None:
            """What the middle one of three pages in a row shares with the nearer of the others."""
            before, page, after = near
            if page is None or page["number"] // RUN != page["run"]:
                return None
            sides = [(common_prefix(page["path"], x["path"]), x["hashes"]) for x in (before, after) if x and x["host"] == page["host"] and x["run"] == page["run"]]
            found = shared(page["hashes"], max(sides, key=lambda s: s[0])[1]) if sides else []
            return (page["sign"], found) if found else None

        near: list = [None, None, None]
        for batch in itertools.chain(batches, [None]):
            out = []
            table = [None] if batch is None else [{k: batch.column(k)[i].as_py() for k in ("sign", "host", "path", "number", "run")} | {"hashes": np.asarray(batch.column("hashes")[i].values)} for i in range(len(batch))]
            for x in table:
                near = [*near[1:], x]
                out.append(align(near))
            out = [x for x in out if x]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([p for _, p in out], pa.list_(pa.int32()))], ["sign", "shared"])

    return dealt.select("sign", "host", "path", "hashes", "number", "run").mapInArrow(run, "sign string, shared array<int>")


def assembled(found: list[tuple[str, str]], gone: set[int]) -> tuple[str, int]:
    """The text of a page's lines, as (letter of verdict, text), and how many lines differencing deleted."""
    deleted = {i for i in gone if found[i][0] != "a"}
    return " ".join(t for i, (v, t) in enumerate(found) if v and i not in deleted), len(deleted)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row of ``pages`` (page_id, url, html); n_shared counts the lines
    that went as the nearest page has them."""
    gone = stash(differences(stash(hashes(pages), "html-lines")), "html-shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                made = []
                for texts, shared in zip(part.column("texts"), part.column("shared")):
                    raw = unpack(texts.as_py()).decode()
                    made.append(assembled([(x[:1], x[1:]) for x in raw.split("\n")], set(shared.as_py() or ())))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([t for t, _ in made], pa.string()), pa.array([len(t) for t, _ in made], pa.int64()), pa.array([n for _, n in made], pa.int64())], ["page_id", "url", "text", "n_chars", "n_shared"])

    rows = packed(pages).join(gone, "sign", "left").select("page_id", "url", "texts", "shared")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared long")
