import public_tokenizers
import pyarrow as pa

from millrace.llm import bpe, grading
from millrace.llm.shared import ARROW_BATCH, ARROW_BYTES, in_arrow


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})


def test_arrow_batches_of_an_operator_are_bounded(spark):
    texts = spark.range(0, 6_000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 400) AS text")
    before = spark.conf.get(ARROW_BATCH, None)
    spark.conf.unset(ARROW_BATCH)
    try:
        bpe.digests(texts, public_tokenizers.path("byte_bpe_50k.json"))
        got = texts.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 6_000 and 1 < max(r.n for r in got) and max(r.bytes for r in got) <= 1.5 * ARROW_BYTES
        # a row of more is a batch, whole
        large = spark.range(0, 3, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 400000) AS text")
        assert [r.n for r in in_arrow(large, sizes, "n long, bytes long").collect()] == [1, 1, 1]
        # a session's own setting stands
        spark.conf.set(ARROW_BATCH, "1m")
        bpe.digests(texts, public_tokenizers.path("byte_bpe_50k.json"))
        assert spark.conf.get(ARROW_BATCH) == "1m"
    finally:
        spark.conf.unset(ARROW_BATCH)
        if before is not None:
            spark.conf.set(ARROW_BATCH, before)


def test_words_kept_by_the_classifier_are_bounded(monkeypatch):
    monkeypatch.setattr(grading, "KNOWN", 50)
    model = grading.fit([(grading.slots("good words"), 2), (grading.slots("bad things"), 0)] * 20)
    plain = [sum(model.weights[s] for s in grading.slots(t)) * grading.UNIT for t in ("good words %d" % i for i in range(200))]
    assert [model.score("good words %d" % i) for i in range(200)] == plain and len(model.known) <= 60
