import hashlib
import random
import re
import time

from millrace.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows, items, window=10):
    out = []
    low = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = []
    for i, t in items:
        w = low(t)
        m = min(window, len(w))
        grams += [(i, tuple(w[a : a + m])) for a in range(len(w) - m + 1)] if m else []
    for i, t in rows:
        w, hit, ids = low(t), set(), set()
        for item, g in grams:
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit.update(range(a, a + len(g)))
                    ids.update([] if item is None else [str(item)])
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data():
    r = random.Random(2)
    word = lambda: r.choice(["a", "B", "été", "the", "Of", "x1", "9"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 3, 7, 10, 12, 30])))) for i in range(12)] + [(None, "null id item words here for all ten of them"), (99, None), (1, "same id other text of more than ten words for a second entry"), (3, "dup item"), (3, "dup item")]
    items = [(i, t) for i, t in items if t is None or len(WORD.findall(t)) != 1 or i == 5]
    rows = [(0, None), (1, ""), (None, "x"), (2, "Null-id, ITEM words here\nfor all ten of them!"), (3, "nothing found")]
    for i in range(40):
        parts = [" ".join(word() for _ in range(r.choice([0, 5, 40])))]
        for _ in range(r.choice([0, 1, 2])):
            parts.append(r.choice(items)[1] or "")
            parts.append(" ".join("z%d" % r.randrange(9) for _ in range(5)))
        rows.append((10 + i, ". ".join(parts)))
    return rows + [rows[7], rows[7]], items


def test_against_plain(spark):
    rows, items = data()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS mark", "'q' AS n_words", "3 AS starts")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS mark")
    want = plain(rows, items)
    for size in (10**9, 60):
        got = d.contamination(docs, bench, block_words=size).drop("mark")
        assert sorted(map(tuple, got.collect()), key=str) == want
        kept = d.drop_contaminated(docs, bench, block_words=size)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)


def test_long_items_and_texts_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "PIECE", 40)
    r = random.Random(6)
    words = lambda n: " ".join("w%d" % r.randrange(50) for _ in range(n))
    items = [(i, words(n)) for i, n in enumerate((700, 49, 50, 51, 12))]
    rows = [(i, " ".join([words(30), " ".join(items[i % 5][1].split()[a : a + 15]), words(5)])) for i, a in enumerate((0, 35, 36, 37, 0, 480))] + [(9, items[0][1] * 3 + words(30_000))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(d.blocks(bench, block_words=120))) > 3
    got = sorted(map(tuple, d.contamination(docs, bench, block_words=120).drop("mark").collect()), key=str)
    assert got == plain(rows, items) and all(g[5] for g in got)


def test_equal_endings_build_and_compare(spark):
    """Question sets in which each item ends alike, and short items that are all the same."""
    items = [(str(i), "question %d asks something else again and again which is none of the above" % i) for i in range(20_000)] + [("s%d" % i, "none of these") for i in range(3)]
    began = time.process_time()
    tables = d.build(items)
    spans, found = d.find(d.words("x question 7 asks something else again and again which is none of the above y none of these"), tables)
    assert time.process_time() - began < 20
    assert spans == [(1, 15), (16, 19)] and len(found) == 20_003 and sum(x.nbytes for t in tables for x in (t.at, t.items, t.suffix, t.full)) < 40 * 300_000


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[2:4] for r in d.contamination(docs, none).collect()] == [(2, 0)]
    assert d.contamination(docs.limit(0), none).count() == 0
    assert d.drop_contaminated(docs, none).count() == 1
