"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's score is one sum of hashed-text weights, shared by all grades: P(grade <= k) = sigmoid(threshold_k - score),
with ordered thresholds. From it come the expected grade and the tail probabilities P(grade >= k), by which documents
are selected. Grades from the labels: 0 toxic, 1 of low quality, 2 good.

Features are each different word of the text (in lower case) with its first three to five
bytes, so that inflected words share weight, and the shape of the text in coarse steps: the shares of symbols, marks,
digits, capitals, repeated words and repeated lines.

Training takes a bounded sample of the labelled rows: the ``SAMPLE`` ids with the least hash among the labelled ids that
have a document, drawn from ids alone, so that texts are read once. Their features come to the driver as hashed integers, where features that tell grades apart are
chosen by their z score, and weights and thresholds are fitted by full-batch gradient descent. What is broadcast are
2**``HASH_BITS`` weights.

Defined results: a null text is empty, and an empty text is rejected without regard to the model, as it holds nothing to
keep; without labelled rows of two grades or more there is no model, every score is 0, and documents with words stay;
labels with nulls or for unknown documents are left out, and of several labels for an id the lowest grade counts;
of several texts for an id, that with the least mark is the sample's; repeated rows each get a result; other columns are
ignored. Very long texts are read whole, in memory in proportion to their different words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_arrow, text_mark

SAMPLE = 6_000
HASH_BITS = 20
GRADES = 3
#: A document is kept if it is more likely than this to have the best grade.
TAIL = 0.3
#: Texts that are held as Python strings at once.
TEXTS = 256
#: A worker keeps the weights of about so many words.
KNOWN = 100_000

#: Bytes of a lower-cased text: ASCII other than letters and digits separates words.
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SYMBOLS, _MARKS, _DIGITS, _CAPITALS = b"#*$%&|<>", b"!?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STEPS = (0.01, 0.03, 0.1, 0.3, 0.6)


def slot(feature: bytes) -> int:
    return xxhash.xxh32_intdigest(feature) & (2**HASH_BITS - 1)


def word_slots(word: bytes) -> list[int]:
    return [slot(b"w" + word), *(slot(b"p" + word[:n]) for n in (3, 4, 5) if len(word) > n)]


def split(text: str) -> tuple[set[bytes], list[int]]:
    """The different words of a text, and the slots of its shape: one for each step that a share reaches."""
    raw = text.encode()
    words = text.lower().encode().translate(_SPLIT).split()
    different = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size, share = len(raw) or 1, lambda x: 1 - len(raw.translate(None, x)) / size
    shares = {
        b"symbols": share(_SYMBOLS),
        b"marks": share(_MARKS),
        b"digits": share(_DIGITS),
        b"capitals": share(_CAPITALS),
        b"repeats": 1 - len(different) / (len(words) or 1),
        b"lines": 1 - len(set(lines)) / (len(lines) or 1),
        b"words": 1 - len(words) / 50,
        b"length": min(1.0, size / (len(words) or 1) / 20 - 0.3),
    }
    return different, [slot(b"s%s %d" % (k, i)) for k, x in shares.items() for i, step in enumerate(_STEPS) if len(words) and x >= step]


def slots(text: str) -> np.ndarray:
    words, shape = split(text)
    return np.array([s for w in words for s in word_slots(w)] + shape, np.int64)


#: Weights are whole multiples of this, so that a score doesn't depend on the order of its sum.
UNIT = 1e-6


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    known: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "known": {}}

    def score(self, text: str) -> float:
        known, weights = self.known, self.weights
        words, shape = split(text)
        if len(known) > KNOWN:
            known.clear()
        for w in words.difference(known):
            known[w] = sum(weights.item(s) for s in word_slots(w))
        return (sum(map(known.__getitem__, words)) + sum(weights.item(s) for s in shape)) * UNIT

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit(rows: Iterable[tuple[np.ndarray, int]], grades: int = GRADES, rounds: int = 150, least_z: float = 4.5, penalty: float = 1e-3) -> Model:
    """Fit on (slots, grade) rows; the same rows in the same order give the same model."""
    rows = [(np.asarray(s, np.int32), g) for s, g in rows]
    size = 2**HASH_BITS
    y = np.array([g for _, g in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size, np.int32), np.full(grades - 1, -50.0))
    n = len(rows)
    different = [np.unique(s) for s, _ in rows]
    cols, owner = np.concatenate(different), np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in different])
    del different
    seen = np.bincount(cols, minlength=size).astype(float)
    chosen = np.zeros(size, bool)
    for k in range(1, grades):
        # z score of the feature's share among rows of grade >= k against its share among the others
        high = y >= k
        a, b = high.sum(), (~high).sum()
        if not a or not b:
            continue
        x = np.bincount(cols[high[owner]], minlength=size)
        p = seen / n
        z = np.abs(x / a - (seen - x) / b) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / a + 1 / b))
        chosen |= (seen >= 3) & (z >= least_z)
    used = np.flatnonzero(chosen)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    cols, owner = np.concatenate([s for s, _ in rows]), np.repeat(np.arange(n, dtype=np.int32), [len(s) for s, _ in rows])
    inside = chosen[cols]
    cols, owner = place[cols[inside]], owner[inside]
    w = np.zeros(len(used))
    # thresholds start where the grades' shares lie; the gaps stay positive
    share = np.clip([(y <= k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    t = np.log(np.maximum.accumulate(share) / (1 - np.maximum.accumulate(share)))
    t = np.maximum.accumulate(t + np.arange(grades - 1) * 1e-3)
    balance = np.array([n / (grades * max(1, (y == k).sum())) for k in range(grades)]) ** 0.5
    cost = balance[y]
    moment, moment_t, square, square_t = np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)
    for step in range(1, rounds + 1):
        f = np.bincount(owner, w[cols], minlength=n)
        cdf = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(f[:, None] - t[None, :], -50, 50))), np.ones((n, 1))], axis=1)
        slope = cdf * (1 - cdf)
        p = np.maximum(cdf[np.arange(n), y + 1] - cdf[np.arange(n), y], 1e-9)
        upper, lower = cost * slope[np.arange(n), y + 1] / p, cost * slope[np.arange(n), y] / p
        grad = np.bincount(cols, (upper - lower)[owner], minlength=len(used)) / n + penalty * w
        grad_t = np.array([lower[y == k + 1].sum() - upper[y == k].sum() for k in range(grades - 1)]) / n
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        moment_t, square_t = 0.9 * moment_t + 0.1 * grad_t, 0.99 * square_t + 0.01 * grad_t**2
        rate = 0.1 / (1 + step / 75)
        w -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        t -= rate * (moment_t / (1 - 0.9**step)) / (np.sqrt(square_t / (1 - 0.99**step)) + 1e-6)
        t = np.maximum.accumulate(t)
    weights = np.zeros(size, np.int32)
    weights[used] = np.round(w / UNIT)
    return Model(weights, t)


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, quality, toxic)."""
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("grade"))
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).where("id IS NOT NULL")
    # a bounded number of rows, whatever the size of the input
    drawn = rated.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "id")
    chosen = texts.select("id", "grade", text_mark(F.col("text")).alias("mark"), "text").groupBy("id", "grade").agg(F.min(F.struct("mark", "text")).alias("first")).select("id", "grade", F.col("first.mark").alias("mark"), F.col("first.text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [slots(x or "").astype(np.int32).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), batch.column("grade"), pa.array(made, pa.binary())], ["id", "mark", "grade", "slots"])

    found = in_arrow(chosen, run, "id long, mark long, grade int, slots binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["id"], r["mark"]))
    return fit((np.frombuffer(r["slots"], np.int32), r["grade"]) for r in found)


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, ``TEXTS`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def scored(docs: DataFrame, model: Model, tail: float = TAIL) -> DataFrame:
    """(doc_id, score, expected_grade, p_1, p_2, ..., kept) of every row: p_k is the probability of grade k or better."""
    grades = len(model.thresholds) + 1
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [x.as_py() or "" for x in batch.column("text")]
            scores = np.array([held.value.score(t) for t in texts], float)
            tails = held.value.tails(scores)
            kept = (tails[:, -1] >= tail) & np.array([bool(t) and not t.isspace() for t in texts], bool)
            columns = [scores, tails.sum(axis=1), *tails.T, kept]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "score", "expected_grade", *(f"p_{k}" for k in range(1, grades)), "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, f"doc_id long, score double, expected_grade double, {', '.join(f'p_{k} double' for k in range(1, grades))}, kept boolean")


def keep_good(docs: DataFrame, model: Model, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs`` that the model keeps."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [x.as_py() or "" for x in batch.column(batch.schema.get_field_index("text"))]
            tails = held.value.tails(np.array([held.value.score(t) for t in texts], float))
            yield batch.filter(pa.array([bool(p >= tail) and bool(t) and not t.isspace() for p, t in zip(tails[:, -1], texts)], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
