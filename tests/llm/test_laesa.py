import hashlib
import math
import random

import numpy as np
import pytest

from millrace.llm import laesa


def plain(rows, n=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda v: (v[0] is None, hashlib.sha256(f"1:{v[0]}".encode()).hexdigest() if v[0] is not None else "", v[1]))
    centroids = [v for _, v in order[:n]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        met = {}
        for _, v in kept:
            met.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(met[k]) for x in zip(*met[k])] if k in met else c for k, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = {}
    for _, d, k in found:
        per[k] = per.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, per[k], sum(per.values()), sha[k]) for i, d, k in found), key=str)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def result(spark, rows, **args):
    given = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, cluster int, X string")
    return laesa.clusters(given.repartition(3), **args)


@pytest.mark.parametrize("pivots", [8, 1, 0])
def test_clusters_are_those_of_measuring_everything(spark, monkeypatch, pivots):
    monkeypatch.setattr(laesa, "PIVOTS", pivots)
    monkeypatch.setattr(laesa, "CHUNK", 64)
    r = random.Random(2)
    middles = [[r.gauss(0, 2) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, 0.6) for x in r.choice(middles)]) for i in range(400)]
    rows += [(i, [float(i % 3)] * 64) for i in range(400, 460)] + [rows[5], rows[5], (5, [0.25] * 64), (None, [0.5] * 64)]
    rows += [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [1.0] * 63 + [float("nan")]), (904, [float("inf")] + [1.0] * 63), (905, []), (906, [1.0] * 65), (907, [-1e5] * 64)]
    got = result(spark, rows)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == plain(rows)
    if pivots == 8:
        assert got.agg({"measured": "avg"}).first()[0] < 12


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    assert sorted(map(tuple, result(spark, rows).select(*COLUMNS).collect()), key=str) == plain(rows)
    same = [(i, [1.5] * 64) for i in range(40)]
    assert sorted(map(tuple, result(spark, same).select(*COLUMNS).collect()), key=str) == plain(same)
    assert result(spark, [(1, None), (2, [3e38] * 64)]).collect() == [] and result(spark, rows).columns == result(spark, []).columns
