"""run() against a plain version of every stage, and the contract of STAGES."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
from test_decontaminate import plain as plain_decontamination
from test_grading import BAD
from test_pii import plain as plain_pii
from test_simhash import plain_components
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import grading
from millrace.llm.queries import QUERIES


def fixture(folder, spark):
    r = random.Random(12)
    items = [(i, " ".join("bench%d" % r.randrange(10**6) for _ in range(14))) for i in range(5)]
    rows, labels = [], []
    for i in range(260):
        words = ["word%d" % r.randrange(3000) for _ in range(r.choice([30, 120]))]
        grade = r.choice([0, 1, 2, 2, 2, 2])
        if grade == 0:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(BAD)
        if grade == 1:
            words = [w + "###" for w in words]
        if i % 9 == 0:
            words[5:5] = r.choice(items)[1].split()
        if i % 5 == 0:
            words.insert(3, r.choice(["a%d@mail.com" % i, "10.0.0.%d" % (i % 250), "+49 171 %07d" % i]))
        text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(grade != 1), int(grade == 0)))
        if i % 7 == 0:
            rows.append((1000 + i, text, "en", "s", len(text)))
    rows += [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "no id but words here", "en", "s", 20), (3, rows[3][1], "en", "s", 1)]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def hidden(text):
    out, at = "", 0
    for a, _, b, kind in plain_pii(text):
        out, at = (out + text[at:a] + f"<{kind.upper()}>" if a >= at else out), max(at, b)
    return out + text[at:]


def test_against_plain_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, items = fixture(folder, spark)
    model = grading.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    tail = lambda t: model.tails(np.array([model.score(t)]))[0, -1]
    left = [(i, t) for i, t, *_ in rows if t and not t.isspace() and tail(t) >= grading.TAIL]
    assert 100 < len(left) < len(rows)
    groups = {}
    for i, f, c in plain_components(left):
        groups.setdefault((c, f if c is None else ""), []).append((i is None, i or 0, i, f))
    first = {(g[2], g[3]) for g in map(min, groups.values())}
    fps = {(i, f) for i, f, _ in plain_components(left)}
    seen, single = set(), []
    of = {}
    for i, t in left:
        of[(i, t)] = next(f for j, f, _ in plain_components([(i, t)]))
        if (i, of[(i, t)]) in first and (i, of[(i, t)]) not in seen:
            seen.add((i, of[(i, t)]))
            single.append((i, t))
    assert fps >= first
    bad = {w[0] for w in plain_decontamination(single, items) if w[5]}
    clean = [(i, hidden(t)) for i, t in single if i not in bad]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in clean:
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    assert got == sorted(want, key=str) and 50 < len(got) < len(left)


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "personal_data", "tokens"]
    folder = f"file://{tmp_path}"
    fixture(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert name == "tokens" or stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_stages_define_nulls_and_long_texts(spark, tmp_path):
    folder = f"file://{tmp_path}"
    fixture(folder, spark)
    long = "word1 word2 good text here " * 30_000
    rows = [(1, None, None, None, None), (2, "", None, None, 0), (None, "some words of no id", None, None, None), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (4, long + "more", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS mark", "1 AS fp")
    kept = {name: sorted((r.doc_id for r in stage(spark, docs, folder).collect()), key=str) for name, stage in corpus_pipeline.STAGES}
    assert kept["near_duplicates"] == [1, 3, None] and kept["decontamination"] == kept["personal_data"] == kept["tokens"] == [1, 2, 3, 3, 4, None]
    assert not {1, 2} & set(kept["quality_classifier"])


def test_one_query_for_each_operator():
    names = [re.match(r"op(\d+)_", n)[1] for n in QUERIES]
    assert sorted(map(int, names)) == list(range(1, 11))
