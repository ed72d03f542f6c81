import hashlib
import random
import re

import pytest

from millrace.llm import substring


def plain(rows, window=50):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    first = {}
    for i, t in rows:
        w = split(t)
        for a in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for a in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window, many):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b"]) if seed % 2 else "w%d" % r.randrange(500)
    text = lambda n: [word() for _ in range(n)]
    passages = [text(r.choice([window - 1, window, window + 1, 2 * window, 5 * window])) for _ in range(12)]
    rows = [(None, " ".join(passages[3])), (None, None), (5, None), (6, ""), (7, " \t\n")]
    for i in range(many):
        parts = []
        for _ in range(r.choice([1, 2, 4])):
            parts += text(r.choice([0, 3, window, 3 * window]))
            p = r.choice(passages)
            a = r.randrange(len(p))
            parts += r.choice([p, p, p[a:], p[:a], []])
        rows.append((10 + i, r.choice([" ", "\n", "  "]).join(parts)))
    rows += [(1000 + j, rows[10 + j % 3][1]) for j in range(10)] + [(20, " ".join(passages[0] + text(9)))] + rows[12:14]
    near = rows[15][1].split()
    for j in range(8):
        w = list(near)
        if w:
            w[r.randrange(len(w))] = "changed"
        rows.append((2000 + j, " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, window, gram, group", [(2, 50, 20, 256), (4, 10, 4, 256), (1, 12, 3, 256), (4, 10, 4, 3), (3, 12, 3, 0)])
def test_against_plain(spark, seed, window, gram, group):
    rows = corpus(seed, window, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS mark", "'q' AS anchor", "3 AS first")
    got = substring.dedup(docs, window, gram, True, group).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept", "n_factors").collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == plain(rows, window)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert all((r.n_factors > 0) == (r.n_removed > 0) for r in got) and max(r.n_factors for r in got) > 1


def test_parse_is_greedy_and_checks_factor_boundaries():
    w = lambda t: [c.encode() for c in t]
    r = substring.Reference(3)
    assert r.parse(1, w("abcdefgh")) == [] and r.parse(1, w("abcd")) == []  # a document isn't its own reference
    assert r.parse(2, w("xefghiy")) == [(1, 5, 1)]
    # one long factor, then the window across its end, which only the second document has
    assert r.parse(3, w("abcdefghiz")) == [(0, 8, 1), (6, 9, 2)]
    assert substring.factors([(0, 8, 1), (6, 9, 2), (6, 12, 1), (12, 15, 1)], 3) == [(0, 12, 1), (6, 9, 2), (12, 15, 1)]


def test_very_long_text(spark):
    r = random.Random(3)
    long = " ".join("w%d" % r.randrange(10**6) for _ in range(200_000))
    rows = [(1, long), (2, "x " * 60_000 + long[:1000]), (3, "new words " + long + " at its end"), (4, "x " * 70_000)]
    got = {x.doc_id: x for x in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_removed, got[i].n_factors) for i in (1, 3, 4)] == [(0, 0), (200_000, 1), (70_000, 1)]
    assert got[2].n_removed == len(long[:1000].split()[:-1])


def test_empty(spark):
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
