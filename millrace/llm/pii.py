"""Personal data: patterns for e-mail, IP, card and phone, and terms that disclose them.

Base spans come from regular expressions, leftmost and without overlap for each kind, then checked by value. The method
on top is information-theoretic sanitisation. An entity is a value of a base span, or the pool that its value belongs to: the
domain of an address, the first two numbers of an IP, the first ``POOL`` digits or signs of a card or phone number; so evidence
also gathers where each value stands in one text only. An entity's contexts are the ``REACH`` characters on either side of its
spans. The corpus gives the shares of documents that hold the entity, p(e), the term, p(t), and the
term in a context of the entity, p(e, t). A term discloses an entity when their pointwise mutual information
log2(p(e, t) / (p(e) p(t))) reaches the share ``DISCLOSED`` of the entity's information -log2 p(e), which it has in full
when the term only occurs with the entity. That is p(e | t) >= p(e)^(1 - DISCLOSED), and as counts are small, Chernoff's
bound decides: counts such as those found would come from a smaller p(e | t) with a probability of ``DOUBT`` at most. Copies
prove nothing: a pair counts once for each different text with a context of its own, and ``LEAST`` such are needed. Disclosing terms
become spans of kind "term" wherever they stand in the corpus, and the sanitiser generalises them like the entities.

All of this is DataFrame expressions. Texts are scanned and never shuffled; contexts and terms are pre-aggregated. Terms
are counted over the whole corpus before the counts meet the terms with contexts enough, so that what the join makes grows with
the vocabulary and not with the words.

Defined results: a null text is empty, and stays null when sanitised; repeated rows each get a result; spans are sorted
by start, then kind; where spans overlap, the sanitiser writes the first's sign over their union; other columns are
ignored by the finder and kept by the sanitiser. Very long texts, and texts of tens of thousands of spans, take time and
memory in proportion to both: lists are built in blocks, substrings taken from pieces of the text, and terms are held
against neighbouring spans only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stash, unused

REACH = 60
LEAST = 2
DOUBT = 0.1
DISCLOSED = 0.8
#: Digits at the start of a card or phone number that make its pool, an issuer or an area.
POOL = 6

KINDS = ("email", "ip", "card", "phone", "term")
#: Base patterns. A run that fails is not tried again from its middle: a match starts where its run does, or where the
#: previous match ended (\\G). Quantifiers that can't profit from giving back are possessive, which also spares the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without these hold no match.
NEEDED = {"email": r"[A-Za-z0-9]\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_RANGE = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
TERM = r"\p{L}{4,}+"

SPAN = "array<struct<start: int, rank: int, stop: int, value: string>>"
#: Lists are built in blocks of so many elements, and texts cut into pieces of 2**PIECE characters.
BLOCK, PIECE = 256, 10
#: No more spans without overlap than this reach into a context on either side, as none is shorter than five characters.
NEAR = REACH // 5 + 2


def given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def folded(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """An array of ``kind``: what ``step`` makes of each item in order. It takes the state and an item, and gives the next
    state, whether there is an element, and the element. Blocks of elements are filled and then joined, as each addition
    copies the list that it adds to."""
    none = F.array().cast(f"array<{kind}>")

    def add(acc: Column, x: Column) -> Column:
        following, made, element = step(acc["state"], x)
        return F.struct(following.alias("state"), F.when(made, F.concat(acc["out"], F.array(element.cast(kind)))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        filled = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), add)
        return given(filled, lambda v: F.struct(v["state"].alias("state"), F.concat(acc["out"], F.array(v["out"])).alias("out")))

    def all_blocks(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(v) - 1, F.lit(0)), 8)), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.aggregate(parts, F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), block)["out"])

    return given(items, all_blocks)


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % 2**PIECE), F.lit(0))


def cut(parts: Column, begin: Column, size: Column) -> Column:
    """The substring of a text in :func:`pieces`; a plain substring would count characters from the text's start."""
    first, last = F.shiftright(begin, PIECE), F.shiftright(begin + size, PIECE)
    return F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), begin - F.shiftleft(first, PIECE) + 1, size)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_RANGE)
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def located(text: Column, pattern: str, kind: str, check=None) -> Column:
    """Spans of the matches of ``pattern`` that pass ``check``: the text between matches gives their positions."""
    rank = KINDS.index(kind)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), m.alias("value")))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        start = at + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("stop"), x["value"].alias("value"))
        ok = x["value"].isNotNull() & (check(x["value"]) if check else F.lit(True))
        return start + F.coalesce(x["size"], F.lit(0)), ok, span

    return folded(both, F.lit(0), SPAN[6:-1], step)


def base_spans(text: Column) -> Column:
    """All base spans of a text that isn't null, sorted by start and kind."""
    none = F.array().cast(SPAN)
    kinds = [F.when(text.contains("@") if k == "email" else text.rlike(NEEDED[k]), located(text, PATTERNS[k], k, lambda v, k=k: valid(k, v))).otherwise(none) for k in KINDS[:4]]
    return F.when(text.rlike("[0-9@]"), F.sort_array(F.concat(*kinds))).otherwise(none)


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def united(spans: Column) -> Column:
    """For sorted spans: (number, first, start, far) of the union of overlapping spans that each belongs to; far is where the
    spans up to this one end."""

    def step(state: Column, s: Column) -> tuple[Column, Column, Column]:
        first = (state["number"] < 0) | (s["start"] >= state["far"])
        number, far = state["number"] + first.cast("int"), F.greatest(state["far"], s["stop"])
        return F.struct(number.alias("number"), far.alias("far")), F.lit(True), F.struct(number.alias("number"), first.alias("first"), s["start"].alias("start"), far.alias("far"))

    return folded(spans, F.struct(F.lit(-1).alias("number"), F.lit(0).alias("far")), "struct<number: int, first: boolean, start: int, far: int>", step)


def entities(s: Column) -> Column:
    """Marks of what a base span names: its value, and the pool that values of its kind share."""
    value, rank = F.lower(F.translate(s["value"], " ().-", "")), s["rank"].cast("string")
    pool = F.when(s["rank"] == 0, F.substring_index(F.lower(s["value"]), "@", -1)).when(s["rank"] == 1, F.substring_index(s["value"], ".", 2)).otherwise(F.substring(value, 1, POOL))
    return F.array(F.md5(F.concat(rank, value)), F.md5(F.concat(rank, F.lit(" pool "), pool)))


def contexts(text: Column, spans: Column) -> Column:
    """For each base span: its entities, the terms around it, and a mark of the context."""

    def around(s: Column, u: Column, parts: Column, unions: Column) -> Column:
        begin = F.greatest(s["start"] - REACH, F.lit(0))
        left, right = cut(parts, begin, s["start"] - begin), cut(parts, s["stop"], F.lit(REACH))
        # a term that the context's edge may have cut isn't one
        lefts = F.filter(located(left, TERM, "term"), lambda t: (t["start"] > 0) | (begin == 0))
        rights = F.filter(located(right, TERM, "term"), lambda t: t["stop"] < REACH)
        moved = lambda terms, by: F.transform(terms, lambda t: F.struct((t["start"] + by).alias("start"), t["rank"].alias("rank"), (t["stop"] + by).alias("stop"), F.lower(t["value"]).alias("value")))
        terms = F.concat(moved(lefts, begin), moved(rights, s["stop"]))
        near = F.slice(unions, F.greatest(u["number"] - NEAR, F.lit(0)) + 1, F.lit(2 * NEAR + 1))
        free = F.filter(terms, lambda t: ~F.exists(near, lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
        return F.struct(entities(s).alias("entities"), F.md5(F.concat_ws("\x00", left, right)).alias("context"), free.alias("terms"))

    def each(v: Column) -> Column:
        lasts = F.filter(v["of"], lambda x, i: F.coalesce(F.get(v["of"], i + 1)["first"], F.lit(True)))
        unions = F.zip_with(F.filter(v["of"], lambda x: x["first"]), lasts, lambda a, b: F.struct(a["start"].alias("start"), b["far"].alias("stop")))
        return given(unions, lambda known: F.zip_with(v["spans"], v["of"], lambda s, u: around(s, u, v["parts"], known)))

    return given(F.struct(spans.alias("spans"), united(spans).alias("of"), pieces(text).alias("parts")), each)


def free_terms(base: Column, terms: Column) -> Column:
    """Those of ``terms`` that no base span overlaps: none before reaches into them, and none behind begins in them."""
    is_base = lambda s: s["rank"] < len(KINDS) - 1
    entry = "struct<start: int, rank: int, stop: int, value: string, free: boolean>"
    fields = lambda s: [s[k].alias(k) for k in ("start", "rank", "stop", "value")]
    ahead = folded(F.sort_array(F.concat(base, terms)), F.lit(0), entry, lambda far, s: (F.when(is_base(s), F.greatest(far, s["stop"])).otherwise(far), F.lit(True), F.struct(*fields(s), (~is_base(s) & (far <= s["start"])).alias("free"))))
    return folded(F.reverse(ahead), F.lit(2**31 - 1), SPAN[6:-1], lambda following, s: (F.when(is_base(s), s["start"]).otherwise(following), s["free"] & (following >= s["stop"]), F.struct(*fields(s))))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, spans, contexts) of every row; mark is the text's digest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = rows.select("doc_id", "text", base_spans(F.col("text")).alias("spans"))
    return spans.select("doc_id", F.md5("text").alias("mark"), "spans", F.when(F.size("spans") > 0, contexts(F.col("text"), F.col("spans"))).alias("contexts"))


def disclosing(docs: DataFrame, rows: DataFrame, doubt: float = DOUBT, disclosed: float = DISCLOSED) -> DataFrame:
    """(mark, extra): spans of the terms that disclose any entity, for all texts that hold such terms. ``rows``: what :func:`found` gave."""
    each = rows.where("contexts IS NOT NULL").select("mark", F.explode("contexts").alias("c")).select("mark", F.explode("c.entities").alias("entity"), "c.context", "c.terms")
    terms = each.select("mark", "entity", "context", F.explode("terms.value").alias("term"))
    # documents are counted by row: a row's own repeats count once
    paired = lambda c: F.flatten(F.transform(c["entities"], lambda e: F.transform(c["terms"], lambda t: F.struct(e.alias("entity"), t["value"].alias("term")))))
    by_row = rows.where("contexts IS NOT NULL").select(F.explode(F.array_distinct(F.flatten(F.transform("contexts", paired)))).alias("x")).select("x.*")
    both = by_row.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    seen = terms.groupBy("entity", "term", "context").agg(F.min("mark").alias("mark")).groupBy("entity", "term").agg(F.count_distinct("mark").alias("contexts")).where(F.col("contexts") >= LEAST)
    pairs = stash(seen.join(both, ["entity", "term"]), "pii-pairs")
    if pairs.isEmpty():
        return rows.where("false").select("mark", F.array().cast(SPAN).alias("extra"))

    wanted = stash(pairs.select("term").distinct(), "pii-terms")
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(F.md5(whole).alias("mark"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(whole), F.lit(TERM), F.lit(0)))).alias("term"))
    held = words.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term")
    entities = rows.where("contexts IS NOT NULL").select(F.explode(F.array_distinct(F.flatten(F.transform("contexts", lambda c: c["entities"])))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    n = rows.count()
    counts = pairs.join(held, "term").join(entities, "entity").where(F.col("n_entity") < n)
    together = F.col("contexts")
    share = together / (together + F.greatest(F.col("n_term") - F.col("n_both"), F.lit(0)))
    least = F.pow(F.col("n_entity") / F.lit(float(n)), F.lit(1 - disclosed))
    apart = share * F.log(share / least) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - least))).otherwise(0.0)
    flagged = stash(counts.where(share > least).where(together / share * apart >= F.lit(-math.log(doubt))).select("term").distinct(), "pii-flagged")
    # texts are only scanned for positions where they hold flagged terms
    hits = stash(words.join(flagged, "term").groupBy("mark").agg(F.collect_set("term").alias("flagged")), "pii-hits")
    texts = docs.select(F.md5(whole).alias("mark"), whole.alias("text")).join(hits.select("mark"), "mark", "left_semi").groupBy("mark").agg(F.min("text").alias("text")).join(hits, "mark")
    spots = located(F.col("text"), TERM, "term", lambda v: F.array_contains("flagged", F.lower(v)))
    free = free_terms(F.col("base"), F.col("spots"))
    return stash(texts.select("mark", spots.alias("spots"), base_spans(F.col("text")).alias("base")).select("mark", F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["stop"].alias("stop"), F.lower(t["value"]).alias("value"))).cast(SPAN).alias("extra")), "pii-extra")


def personal_data(docs: DataFrame, doubt: float = DOUBT, disclosed: float = DISCLOSED) -> DataFrame:
    """(doc_id, spans, all_spans) of every row."""
    rows = stash(found(docs), "pii-found")
    extra = disclosing(docs, rows, doubt, disclosed)
    every = F.when(F.col("extra").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", "extra")))
    return rows.select("doc_id", "mark", "spans").join(extra, "mark", "left").select("doc_id", "spans", every.alias("all_spans"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    counts = [count(rank) for rank in range(4)]
    return personal_data(docs).select("doc_id", *counts, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def sanitised(docs: DataFrame, doubt: float = DOUBT, disclosed: float = DISCLOSED) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in angle brackets."""
    names = docs.columns
    mark, base, more, all_ = unused(docs, "pii_mark", "pii_base", "pii_extra", "pii_spans")
    extra = disclosing(docs, stash(found(docs), "pii-found"), doubt, disclosed).select(F.col("mark").alias(mark), F.col("extra").alias(more))
    text = F.col("text").cast("string")
    marked = docs.withColumns({mark: F.md5(F.coalesce(text, F.lit(""))), base: base_spans(F.coalesce(text, F.lit("")))})
    spans = F.when(F.col(more).isNull(), F.col(base)).otherwise(F.sort_array(F.concat(base, more)))
    rows = marked.join(extra, mark, "left").withColumn(all_, spans)
    signs = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        return F.greatest(at, s["stop"]), s["start"] >= at, F.struct(at.alias("begin"), s["start"].alias("stop"), s["rank"].alias("rank"))

    def put(v: Column) -> Column:
        signed = F.transform(v["places"], lambda p: F.concat(cut(v["parts"], p["begin"], p["stop"] - p["begin"]), F.get(signs, p["rank"])))
        return F.concat(F.array_join(signed, ""), cut(v["parts"], v["last"], F.length("text") - v["last"]))

    places = folded(F.col(all_), F.lit(0), "struct<begin: int, stop: int, rank: int>", step)
    last = F.array_max(F.transform(all_, lambda s: s["stop"]))
    signed = given(F.struct(places.alias("places"), pieces(F.col("text")).alias("parts"), last.alias("last")), put)
    clean = F.when(F.col("text").isNull() | (F.size(all_) == 0), F.col("text")).otherwise(signed)
    return rows.withColumn("text", clean).select(*names)
