"""The pipeline's near-dedup: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First SimHash links texts (:mod:`millrace.llm.simhash`): fingerprints of the five-word shingles within 3 bits of each
other meet in the covering tables, certainly, and become components. Each text of a component is checked on whole sets
against the component's leader, a text of the fingerprint that most texts have. No covering code of a payable size reaches
all pairs at 0.8, whose fingerprints differ in about 10 bits, so texts that this doesn't link meet in the buckets of
:mod:`millrace.llm.minhash` as well, and a bucket of which SimHash has linked all members is closed at once.

Defined results: a null text is empty, and texts without words are copies of each other; of rows that repeat id and text one
stays; of a component the row with the least id stays, rows without an id last; other columns are kept and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import minhash, simhash
from millrace.llm.shared import stash, text_mark, unused

SHINGLE = 5
#: What stands for the component of texts without words.
BLANK = -(2**63)


def by_simhash(rows: DataFrame) -> DataFrame:
    """(src, dst): each text with the leader of its SimHash component, where the sketches allow the similarity. ``rows``: the
    written sketches."""
    texts = rows.where("size > 0").select("mark", "fp")
    fps = stash(texts.groupBy("fp").agg(F.min("mark").alias("first"), F.count("*").alias("n")), "near-fps")
    roots = simhash.components(simhash.links(fps))
    roots = roots.select(F.col("node").alias("fp"), "root").unionAll(roots.select(F.col("root").alias("fp"), "root").distinct())
    # written, as are leaders, so that joins stand on two plain exchanges, of which Spark can split a hot key's
    members = stash(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "near-members")
    leaders = members.groupBy("root").agg(F.max(F.struct("n", "first")).alias("most"), F.sum("n").alias("texts")).where("texts > 1")
    leaders = stash(members.join(leaders, "root").select("fp", F.col("most.first").alias("leader")), "near-leaders")
    pairs = stash(texts.join(leaders, "fp").where("mark <> leader").select(*minhash.pair("mark", "leader")), "near-pairs")
    return stash(minhash.estimated(pairs, rows, minhash.SIMILAR).select("src", "dst"), "near-first")


def groups(docs: DataFrame) -> DataFrame:
    """(mark, root): of each text that has near copies its component; texts without words are one."""
    rows = stash(minhash.sketches(docs, SHINGLE, prints=True), "near-sketches")
    return minhash.groups(docs, rows, SHINGLE, first=by_simhash(rows)).unionAll(rows.where("size = 0").select("mark", F.lit(BLANK).cast("long").alias("root")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"))
    least = ids.groupBy("mark").agg(F.min(order).alias("w")).join(groups(docs), "mark", "left")
    row_id, row_mark, won_id, won_mark = unused(docs, "row_id", "row_mark", "won_id", "won_mark")
    winners = stash(least.groupBy(F.coalesce("root", "mark").alias("g")).agg(F.min("w").alias("w")).select(F.col("w.doc_id").alias(won_id), F.col("w.mark").alias(won_mark)), "near-kept")
    marked = docs.withColumns({row_id: F.col("doc_id").cast("long"), row_mark: text_mark(F.col("text"))})
    kept = marked.join(winners, F.col(row_id).eqNullSafe(F.col(won_id)) & (F.col(row_mark) == F.col(won_mark)), "left_semi")
    return kept.dropDuplicates([row_id, row_mark]).select(*docs.columns)
