import random

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import minhash, near


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("block", [minhash.BLOCK, 3])
def test_all_near_copies_go(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(4)
    rows = [(None, "no id"), (7, "an id of two texts which differ"), (7, "so both of these have to stay"), (8, None), (9, " ")]
    for g in range(25):
        base = ["w%d" % r.randrange(5000) for _ in range(r.choice([40, 150, 600]))]
        for j in range(6):
            words = list(base)
            for _ in range(r.randrange(1 + len(words) // 40)):
                words[r.randrange(len(words))] = "new%d" % r.randrange(10**6)
            rows.append((100 + 10 * g + j, " ".join(words)))
    # chains, of which a leader only has its neighbours
    for g in range(4):
        words = ["c%d" % r.randrange(5000) for _ in range(200)]
        for j in range(14):
            rows.append((1000 + 20 * g + j, " ".join(words)))
            for _ in range(3):
                words[r.randrange(len(words))] = "edit%d" % r.randrange(10**6)
    r.shuffle(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held, close = [sets(t) for _, t in rows], 0
    for i in range(len(rows)):
        for j in range(i):
            if len(held[i] & held[j]) >= 0.8 * len(held[i] | held[j]):
                root[find(i)] = find(j)
                close += rows[i][1] != rows[j][1]
    best = {}
    for i, (d, t) in enumerate(rows):
        best.setdefault(find(i), []).append((d is None, d or 0, t or ""))
    want = sorted(min(v)[:2] for v in best.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert close > 50 and sorted((x.doc_id is None, x.doc_id or 0) for x in got) == want
    assert sum(x.doc_id == 7 for x in got) == 2


def test_other_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 10, 20, "x"), (2, "a b c d e f", 11, 21, "y"), (3, "quite another text than these", 12, 22, "z")], "doc_id long, text string, row_id long, ROW_MARK long, won_id string")
    assert sorted(map(tuple, near.keep_one(docs).collect())) == [(1, "a b c d e f", 10, 20, "x"), (3, "quite another text than these", 12, 22, "z")]


def plain_print(text):
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode()) for s in sets(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_links_texts_that_share_no_bucket(spark, monkeypatch):
    """With all MinHash buckets taken away, what SimHash's components hold is linked, and only that."""
    whole = minhash.sketches
    monkeypatch.setattr(minhash, "sketches", lambda *a, **k: whole(*a, **k).withColumn("bands", F.transform("bands", lambda x: F.xxhash64("mark", x))))
    r = random.Random(6)
    rows = []
    for g in range(12):
        base = ["w%d" % r.randrange(5000) for _ in range(1500)]
        for j in range(6):
            words = list(base)
            for _ in range(r.choice([0, 1, 1, 100])):
                words[r.randrange(len(words))] = "new%d" % r.randrange(10**6)
            rows.append((10 * g + j, " ".join(words)))
    prints = {i: plain_print(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in range(i):
            if j in prints and (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted({find(i) for i in prints})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 12 < len(want) < 60 and sorted(x.doc_id for x in near.keep_one(docs).collect()) == want
