import random
import re
from collections import Counter

import pytest

from millrace.llm import divergence


def plain(rows, least, top):
    counts, docs, groups = {}, {}, set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        for w, n in Counter(words).items():
            counts[lang, source, w] = counts.get((lang, source, w), 0) + n
            docs[lang, w] = docs.get((lang, w), 0) + 1
    kept = {}
    for (lang, w), n in docs.items():
        if n >= least:
            kept.setdefault(lang, []).append(w)
    out = []
    for lang, source in groups:
        terms = kept.get(lang, [])
        others = sorted(s for x, s in groups if x == lang)

        def shares(names):
            total = sum(counts.get((lang, s, w), 0) for s in names for w in terms)
            return {w: 1 + 10**9 * (sum(counts.get((lang, s, w), 0) for s in names) + 5) // (total + 5 * len(terms)) for w in terms}

        own, whole = shares([source]), shares(others)
        found = [(s, sum(abs(p - q) for p, q in zip(own.values(), shares([s]).values()))) for s in others if s != source]
        above = [(w, own[w] - whole[w]) for w in terms if counts.get((lang, source, w)) and own[w] > whole[w]]
        for part, items in (("pair", found), ("term", above)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("block, side, matrices, pairs", [(2**26, 1024, 16, 10**6), (2_000, 3, 2, 5)])
def test_audit_is_that_of_plain_counting(spark, monkeypatch, block, side, matrices, pairs):
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 40 * pairs)
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "MATRICES", matrices)
    monkeypatch.setattr(divergence, "BATCH", 17)
    r = random.Random(8)
    words = ["the", "The", "ÉTÉ", "été", "straße", "x1y", "a-b", "日本", "ǅ", "İi"] + ["t%s" % chr(97 + i) * (1 + i % 3) for i in range(24)]
    rows = [(None, None, None), ("", "", "own"), ("en", "quiet", " 123 \n"), ("en", "quiet", None), ("lone", "one", "word"), ("few", "a", "x"), ("few", "b", "y")]
    for i in range(400):
        lang = r.choice(["en", "en", "de", None])
        source = r.choice(["s0", "s0", "s0", *("s%d" % k for k in range(9)), "ß", None])
        own = words if source == "s0" else r.sample(words, 12)
        rows.append((lang, source, " ".join(r.choice(own) for _ in range(r.randrange(30))) or None))
    rows += [("en", "s0", "the " * 5000)] * 3
    docs = spark.createDataFrame([(*x, 1, "n") for x in rows], "lang string, source string, text string, n int, term string").repartition(7)
    got = sorted(map(tuple, divergence.audit(docs, 20, 6, block).select("lang", "source", "part", "item", "value", "rank").collect()))
    want = plain(rows, 20, 6)
    assert got == want and len({x[2] for x in want}) == 2 and any(x[:3] == ("few", "a", "pair") and x[4] == 0 for x in want)


def test_blocks_are_sorted_runs_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 500)
    docs = spark.createDataFrame([("en", "s", " ".join("w%s" % chr(97 + k % 26) * (1 + k // 26) for k in range(i % 50))) for i in range(200)], "lang string, source string, text string").coalesce(1)
    runs = [tuple(x) for x in divergence.blocks(docs, 5_000).selectExpr("lang", "term", "docs", "aggregate(counts, 0L, (a, b) -> a + b)").collect()]
    breaks = sum(a[:2] >= b[:2] for a, b in zip(runs, runs[1:]))
    assert 3 < breaks < len(runs) / 10 and sum(x[3] for x in runs) == sum(i % 50 for i in range(200))


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_shares_beyond_a_long(spark):
    row = spark.createDataFrame([(3 * 10**12, 10**15, 7)], "c long, n long, v long").select(divergence.share(*map(divergence.F.col, "cnv")).alias("p")).first()
    assert row.p == 1 + 10**9 * (3 * 10**12 + 5) // (10**15 + 35)
