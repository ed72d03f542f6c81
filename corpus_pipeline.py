"""Corpus pipeline: the stages through which ``documents`` becomes tokenised training text.

Defined results of every stage: a null text is empty; rows that repeat an id are decided by their own texts, and each stays
or goes by itself, but for near duplicates, where of rows with one id and text one stays; a null id is kept as it is; an
empty table gives an empty one; other columns are kept by all stages but the last, whatever their names; very long texts are
read whole, in memory in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontaminate, grading, near, pii
from millrace.llm.queries import tokenizer_file
from millrace.llm.shared import spread, stash, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on a bounded sample of the labelled ones.

    Null and empty texts go, as they hold nothing to keep. Without labels of two grades all other documents stay."""
    return grading.keep_good(docs, grading.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: one document of each group of near duplicates stays, that with the least id; five-word shingles, a Jaccard
    similarity of 0.8 or more. SimHash's components are linked first; MinHash finds the pairs at 0.8 that lie beyond SimHash's
    radius (see the README). All links are confirmed on whole texts.

    Null and empty texts are copies of each other. Of two groups that tie for an id each keeps its own document."""
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts stay, as do all documents if the benchmark is empty."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised in the texts.

    Null texts stay null; where spans overlap, the first's kind stands for their union."""
    return pii.sanitised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, one row for each document; null texts have no tokens."""
    return bpe.digests(docs, tokenizer_file())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Fingerprints, the classifier and BPE can't be expressed in SQL; the tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
