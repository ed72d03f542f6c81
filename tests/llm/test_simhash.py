import random

import xxhash
from millrace.llm import simhash


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    root = {f: f for _, f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    keys = list(root)
    for a in keys:
        for b in keys:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    first = {}
    for i, f in fps:
        if i is not None:
            first[find(f)] = min(first.get(find(f), i), i)
    return sorted(((i, f"{f:016x}", first.get(find(f))) for i, f in fps), key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()), key=str)


def corpus():
    r = random.Random(1)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = [(7, None), (8, ""), (9, " \n\t"), (10, "One"), (11, "one two"), (12, "ONE two"), (None, "lost text here now"), (None, "lost text here now"), (13, "É word Ä"), (13, "É word Ä")]
    for i in range(60):
        base = [r.choice(vocabulary) for _ in range(r.choice([5, 80, 400]))]
        for j in range(r.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((100 * i + j + 100, " ".join(words)))
    r.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS component_id", "2 AS mark")
    want = plain_components(rows)
    assert result(simhash.simhash_components(docs)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((x.doc_id for x in kept.collect()), key=str)
    assert ids == sorted({i: c for i, _, c in want if i is None or i == c}, key=str)


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 8)
    r = random.Random(5)
    centre = r.getrandbits(64)
    values = {centre ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 5]))) for _ in range(400)} | {r.getrandbits(64) for _ in range(50)}
    fps = spark.createDataFrame([(simhash.signed(v), i) for i, v in enumerate(values)], "fp long, first long")
    got = {x.node: x.root for x in simhash.components(simhash.links(fps)).collect()}
    root = {v: v for v in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    groups, mine = {}, {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
        mine.setdefault(got.get(simhash.signed(v), simhash.signed(v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_masks_cover():
    import itertools

    masks = simhash.covering_masks(list(range(64)), 3, 1)
    assert all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a, b, c in itertools.combinations(range(64), 3))
    last = simhash.table_masks(3, simhash.SPLITS)[-1]
    assert max(64 - m.bit_count() for m in last) <= 8


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_components_with_one_id_or_none_stay_apart(spark):
    same = " ".join("w%d" % i for i in range(400))
    edited = (same.replace("w%d " % k, "x ", 1) for k in range(399))
    near = next(t for t in edited if 0 < (plain_fingerprint(same) ^ plain_fingerprint(t)).bit_count() <= 3)
    rows = [(7, "one text of this id"), (7, "and quite another one that shares it"), (None, same), (None, near)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(x.doc_id) for x in kept) == ["7", "7", "None"]


def test_very_long_text(spark):
    long = " ".join("w%d" % (i % 1000) for i in range(300_000))
    docs = spark.createDataFrame([(5, long), (4, long + " end"), (9, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    assert got[5].component_id == got[4].component_id == 4 and got[9].component_id == 9
    assert got[5].fp == simhash.fingerprint(long)
