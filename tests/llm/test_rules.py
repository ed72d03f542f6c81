import random
import re
from collections import Counter

from millrace.llm import rules


def plain(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    at = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(at), len(w) < 50 or 100 * len(at) > 50 * len(w)


def corpus():
    r = random.Random(6)
    rows = [(1, None, "en"), (None, "", None), (2, "a b c", "xx"), (3, "a b c a b c", "en"), (4, "x\ny\nx\n\n \n", "en"), (5, "the \U0001f600é# the\x0bof|", "en"), (6, "w " * 30_000, "en"), (7, "a a a a b", "de"), (7, "a a a a b", "de")]
    for i in range(120):
        lang = r.choice(["en", "de", "fr", "es", None, "xx"])
        vocabulary = rules.COMMON.get(lang, ["q", "r"]) + ["word%d" % j for j in range(r.choice([5, 400]))]
        rows.append((10 + i, r.choice([" ", "\n", ". "]).join(r.choice(vocabulary) for _ in range(r.choice([3, 49, 50, 200, 900]))), lang))
    return rows


def test_counts_against_plain(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS w", "2 AS lines", "3 AS kept")
    got = rules.judged(docs).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((i, *plain(t)) for i, t, _ in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)


def test_divergent_texts_go(spark):
    r = random.Random(8)
    good = lambda: " ".join(r.choice(rules.COMMON["en"] + ["Nword%d" % r.randrange(999)] * 20) for _ in range(300))
    rows = [(i, good(), "en") for i in range(60)] + [(100, "### $$$ " * 2 + " ".join("#%d$" % r.randrange(10**9) for _ in range(300)), "en"), (101, " ".join("X%dY" % r.randrange(10**6) for _ in range(60)).upper(), "en")]
    got = {x.doc_id: x for x in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(60)) and not got[100].kept and got[100].class_distance > got[0].class_distance
    assert 0 <= got[0].word_distance <= 1 and got[101].word_distance is None


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rules.judged(docs).count() == 0
