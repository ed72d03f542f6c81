"""Quality rules: counts of a text, and the divergence of its distributions from those of its language.

The base rules fail a text of fewer than ``MIN_WORDS`` words, or with more than half of its words in three-word windows
that occur twice or more in it. The method on top compares two histograms of a text with references of its language: one
of character classes, one of common words. References are the sums over all texts of that language which pass the base
rules, so they grow with the corpus and need no fixed tables but the word lists. The Jensen-Shannon distance (the root of
the divergence in bits) must not exceed ``MAX_CLASS`` or ``MAX_WORD``; a histogram of fewer than ``MIN_CHARS`` characters
or ``MIN_COMMON`` words is too short to tell, and passes.

All of this is DataFrame expressions. Texts are read once; their histograms, some dozens of numbers, are written to the
shared folder, and references are summed from them and joined back by language.

Defined results: a null text has no words and fails the base rules; languages compare as given, and null is one of them;
a language without a word list is compared by character classes alone; repeated rows each get a result; other columns are
ignored, and a missing ``lang`` counts as null. Very long texts are counted whole, in memory in proportion to their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stash

MIN_WORDS = 50
REPEATED_PERCENT = 50
MIN_CHARS, MAX_CLASS = 200, 0.27
MIN_COMMON, MAX_WORD = 100, 0.3

#: Common words by language.
COMMON = {
    "en": "the of and to in is that for it as was with be by on this are from at or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus au sur pas".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, base columns, classes, commons) of every row."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text, w = F.col("text"), F.col("w")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "lang", "text", words(text).alias("w"), lines.alias("lines"))
    n = F.size("w")
    # three-word windows by 64 bits of hash, which tell the windows of one text apart; most texts have no two alike, and
    # only the others' windows are sorted, so that equal ones are neighbours
    hashes = F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))
    rows = rows.select("doc_id", "lang", "text", "w", "lines", hashes.alias("h"))
    ordered = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    rows = rows.select("doc_id", "lang", "text", "w", "lines", F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered).otherwise(F.array().cast("array<struct<h: bigint, at: int>>")).alias("s"))
    s = F.col("s")
    twice = F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"].eqNullSafe(F.when(i > 0, F.get(s, i - 1)["h"]))) | x["h"].eqNullSafe(F.get(s, i + 1)["h"])), lambda x: x["at"]))
    covered = F.aggregate(twice, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n")), lambda acc: acc["n"])
    only = lambda kind: F.length(F.regexp_replace("text", f"[^{kind}]++", ""))
    chars, solid, symbols = F.length("text"), F.length(F.array_join("w", "")), only(r"#*$%&|<>")
    letters, capitals, digits = F.length(F.regexp_replace("text", r"\P{L}++", "")), only(r"\p{Lu}"), only("0-9")
    listed = F.lit(None)
    for k, v in COMMON.items():
        listed = F.when(F.col("lang") == k, F.array(*map(F.lit, v))).otherwise(listed)
    every = sorted({x for v in COMMON.values() for x in v})
    rows = rows.select(
        "doc_id", "lang", n.cast("long").alias("n_words"), solid.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        chars.alias("chars"), letters.alias("letters"), capitals.alias("capitals"), digits.alias("digits"),
        listed.cast("array<string>").alias("listed"), F.filter("w", lambda x: x.isin(every)).alias("met"),
    )
    # letters that aren't capitals, capitals, digits, white space, symbols, all else
    space = F.col("chars") - F.col("word_chars")
    classes = [F.col("letters") - F.col("capitals"), F.col("capitals"), F.col("digits"), space, F.col("n_symbols"), F.col("chars") - F.col("letters") - F.col("digits") - space - F.col("n_symbols")]
    commons = F.transform("listed", lambda c: F.size(F.filter("met", lambda x: x == c)))
    rows = rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.array(*(c.cast("double") for c in classes)).alias("classes"), commons.cast("array<double>").alias("commons"))
    other = F.col("n_words").cast("double") - F.aggregate("commons", F.lit(0.0), lambda x, y: x + y)
    rows = rows.withColumn("commons", F.coalesce(F.concat("commons", F.array(other)), F.array().cast("array<double>")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def references(counts: DataFrame) -> DataFrame:
    """(lang, class_ref, word_ref): summed histograms of the texts that pass the base rules."""
    good = counts.where("NOT base_failed").groupBy("lang")
    width = max(map(len, COMMON.values())) + 1
    # whole numbers, so that the order of the sum doesn't matter
    add = lambda name, n: F.array(*(F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0.0)) for i in range(n)))
    return good.agg(add("classes", 6).alias("class_ref"), add("commons", width).alias("word_ref")).withColumnRenamed("lang", "ref_lang")


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two histograms; null if one of them is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    size_p, size_q = F.nullif(total(p), F.lit(0.0)), F.nullif(total(q), F.lit(0.0))
    pairs = F.zip_with(p, q, lambda a, b: F.struct((a / size_p).alias("a"), (b / size_q).alias("b")))
    sum_ = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + part(x["a"], (x["a"] + x["b"]) / 2) + part(x["b"], (x["a"] + x["b"]) / 2))
    return F.sqrt(F.greatest(sum_ / 2, F.lit(0.0)))


def judged(docs: DataFrame, max_class: float = MAX_CLASS, max_word: float = MAX_WORD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance,
    word_distance) of every row."""
    counts = stash(counted(docs), "rules-counts")
    rows = counts.join(stash(references(counts), "rules-references"), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    long, wordy = F.aggregate("classes", F.lit(0.0), lambda x, y: x + y) >= MIN_CHARS, (F.size("commons") > 0) & (F.col("n_words") >= MIN_COMMON)
    listed = F.slice("word_ref", 1, F.greatest(F.size("commons"), F.lit(0)))
    rows = rows.withColumn("word_ref", listed)
    rows = rows.withColumns({"class_distance": F.when(long, distance("classes", "class_ref")), "word_distance": F.when(wordy, distance("commons", "word_ref"))})
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"), "class_distance", "word_distance")
