import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import minhash


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                links += rows[i][1] != rows[j][1]
    least = {}
    for i, (d, _) in enumerate(rows):
        ids = [x for x in (d, least.get(find(i))) if x is not None]
        least[find(i)] = min(ids, default=None)
    out = [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]
    return sorted(((*x, x[0] == x[2]) for x in out), key=str), links


def groups_of(r, n, edits, size):
    rows = []
    for g in range(n):
        words = ["w%d" % r.randrange(4000) for _ in range(size)]
        for j in range(r.randrange(2, 7)):
            own = list(words)
            for _ in range(r.randrange(edits)):
                own[r.randrange(size)] = "x%d" % r.randrange(10**6)
            rows.append((1000 * g + j, " ".join(own)))
    return rows


EDGES = [(None, "only this has no id at all"), (None, None), (1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  B"), (8, "a b c"), (8, "a b c"), (9, "é È"), (10, "é è")]


@pytest.mark.parametrize("block, bits", [(512, 1024), (4, 1024), (4, 256)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block, bits):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "OTHERS", 4 * block)
    monkeypatch.setattr(minhash, "BITS", bits)
    r = random.Random(3)
    rows = EDGES + [(d + 100, t) for d, t in groups_of(r, 12, 4, 30) + groups_of(r, 10, 14, 120) + groups_of(r, 3, 90, 900)]
    # two dense groups that share buckets, but hardly links
    words = ["d%d" % r.randrange(900) for _ in range(150)]
    for j in range(40):
        own = list(words)
        for _ in range(r.randrange(4, 16)):
            own[r.randrange(150)] = "y%d" % r.randrange(10**6)
        rows.append((90_000 + j, " ".join(own)))
    # a chain
    words = ["c%d" % r.randrange(5000) for _ in range(200)]
    for j in range(12):
        rows.append((95_000 + j, " ".join(words)))
        for _ in range(7):
            words[r.randrange(200)] = "edit%d" % r.randrange(10**6)
    r.shuffle(rows)
    want, links = plain(rows)
    docs = spark.createDataFrame([(d, t, "a", "b", 1) for d, t in rows], "doc_id long, text string, mark string, BAND string, root int").repartition(5)
    got = sorted(map(tuple, minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == want and links > 40


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_never_reject_what_is_similar_enough():
    r = np.random.default_rng(5)
    passed, total, off = 0, 0, []
    for size in (9, 45, 450, 1800, 9000):
        for _ in range(40):
            shared = r.integers(0, 2**64, size - size // 9, np.uint64)
            pair = [np.unique(np.concatenate([shared, r.integers(0, 2**64, size // 9, np.uint64)])) for _ in range(2)]
            assert minhash.alike_enough(*pair, 80)
            odd = [np.frombuffer(minhash.odd_sketch(x, minhash.signature(x)), np.uint64) for x in pair]
            like, may = minhash.estimates(np.array([2.0 * size]), *minhash.differing(*odd), 80)
            passed, total = passed + int(may[0]), total + 1
            off.append(abs(like[0] - (size - size // 9) / (size + size // 9)))
    assert passed == total and max(off) < 0.1 and np.mean(off) < 0.02
    # and reject what is clearly less
    x, y = np.arange(1, 401, dtype=np.uint64) * np.uint64(2**40 + 7), np.arange(101, 501, dtype=np.uint64) * np.uint64(2**40 + 7)
    odd = [np.frombuffer(minhash.odd_sketch(v, minhash.signature(v)), np.uint64) for v in (x, y)]
    assert not minhash.estimates(np.array([800.0]), *minhash.differing(*odd), 80)[1][0]


def test_a_whole_table_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text over and over").otherwise(F.concat(F.lit("own "), "id", F.lit(" words "), "id")).alias("text"))
    got = {x.component_id: x["count"] for x in minhash.near_duplicates(docs).groupBy("component_id").count().collect()}
    assert got[0] == 1000 and len(got) == 2001
