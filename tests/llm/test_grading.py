import random

import numpy as np

from millrace.llm import grading

BAD = ["filthword%s" % x for x in ("a", "ed", "ing", "s")]


def corpus(n=900, seed=4):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["word%d" % r.randrange(2000) for _ in range(r.choice([30, 100, 400]))]
        grade = r.choice([0, 1, 2, 2, 2])
        if grade == 0:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(BAD)
        if grade == 1:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(grade != 1), int(grade == 0)))
    return rows, labels


def test_held_out_accuracy_and_order(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS grade")
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    model = grading.train(docs, known)
    assert (model.thresholds[1:] >= model.thresholds[:-1]).all()
    got = {r.doc_id: r for r in grading.scored(docs, model).collect()}
    held = [(got[i], q, t) for i, q, t in labels[600:]]
    right = [r.kept == (q == 1 and t == 0) for r, q, t in held]
    assert sum(right) / len(right) > 0.97
    assert all(r.p_1 >= r.p_2 and abs(r.expected_grade - r.p_1 - r.p_2) < 1e-9 for r in got.values())
    mean = lambda x: sum(x) / len(x)
    assert mean([r.expected_grade for r, q, t in held if t]) < mean([r.expected_grade for r, q, t in held if not q]) < mean([r.expected_grade for r, q, t in held if q and not t])
    kept = grading.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    again = grading.train(docs.repartition(5), known)
    assert (again.weights == model.weights).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some words"), (3, "some words"), (3, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 1), (None, 1, 1), (7, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = grading.train(docs, labels)
    got = sorted((str(r.doc_id), r.kept) for r in grading.scored(docs, model).collect())
    assert got == [("1", False), ("2", False), ("3", True), ("3", True), ("None", True)]
    assert grading.scored(docs.limit(0), model).count() == 0 and grading.keep_good(docs, model).count() == 3
    assert grading.train(docs.limit(0), labels.limit(0)).weights.sum() == 0


def dense_loss(w, t, x, y, cost, penalty):
    """Weighted negative log likelihood of the cumulative-link model on a dense matrix."""
    total = 0.0
    for row, k, c in zip(x, y, cost):
        score = row @ w
        upper = 1.0 if k == len(t) else 1 / (1 + np.exp(score - t[k]))
        lower = 0.0 if k == 0 else 1 / (1 + np.exp(score - t[k - 1]))
        total -= c * np.log(upper - lower)
    return total / len(y) + penalty * (w @ w) / 2


def test_fit_against_a_plain_dense_fit():
    """The same loss, minimised by plain gradient descent on numeric gradients of a dense matrix."""
    r = np.random.default_rng(3)
    n, d, penalty = 240, 4, 1e-3
    x = (r.random((n, d)) < 0.5).astype(float)
    latent = x @ np.array([2.5, -2.0, 1.5, -2.5]) + r.logistic(size=n)
    y = np.digitize(latent, [-1.0, 1.0])
    model = grading.fit([(np.flatnonzero(row) + 10, int(k)) for row, k in zip(x, y)], rounds=3_000, least_z=0.0, penalty=penalty)
    cost = (np.array([n / (3 * (y == k).sum()) for k in range(3)]) ** 0.5)[y]
    point = np.concatenate([np.zeros(d), [-0.5, 0.5]])
    loss = lambda p: dense_loss(p[:d], p[d:], x, y, cost, penalty)
    for _ in range(400):
        grad = np.array([(loss(point + e) - loss(point - e)) / 2e-5 for e in np.eye(d + 2) * 1e-5])
        point -= 1.0 * grad
    got = np.concatenate([model.weights[10 : 10 + d] * grading.UNIT, model.thresholds])
    assert np.abs(got - point).max() < 0.05 and abs(loss(got) - loss(point)) < 1e-4
    # at the minimum, the numeric gradient is nothing
    assert max(abs(loss(got + e) - loss(got - e)) / 2e-4 for e in np.eye(d + 2) * 1e-4) < 0.01
    tails = model.tails(x @ got[:d])
    want = 1 - 1 / (1 + np.exp((x @ point[:d])[:, None] - point[None, d:]))
    assert np.abs(tails - want).max() < 0.02


def test_sample_is_bounded_and_drawn_from_ids(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows + [(i, "other text %d" % i) for i in range(50)], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(10**6 + i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    seen = []
    fit, grading.fit = grading.fit, lambda rows: seen.extend(rows) or fit(seen)
    try:
        grading.train(docs, known, sample=120)
    finally:
        grading.fit = fit
    assert len(seen) == 120


def test_very_long_text(spark):
    model = grading.Model(np.zeros(2**grading.HASH_BITS, np.int32), np.array([-1.0, 0.0]))
    docs = spark.createDataFrame([(1, "word " * 500_000)], "doc_id long, text string")
    assert [r.kept for r in grading.scored(docs, model).collect()] == [True]


def test_texts_are_taken_in_small_parts():
    """No more than ``TEXTS`` texts of an Arrow batch are held as strings at once."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(n))}) for n in (0, 700, 1)]
    cut = list(grading.parts(batches))
    assert max(x.num_rows for x in cut) == grading.TEXTS and [i for x in cut for i in x.column("doc_id").to_pylist()] == [*range(700), 0]
