import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(7)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "aé漢ñ'", "0123456789", "!?'s \n", "a b\n\t ", "the an in on's 12 ,.", "\U0001f600é ", "<|endoftext|> a"]
    for n in (0, 1, 5, 60, 300, 1500, 5000):
        for a in alphabets:
            yield "".join(r.choice(a) for _ in range(n))
    yield "a" * 5000
    yield " " * 3000 + "x" * 3000
    yield ("x" * 700 + "<|endoftext|>") * 6
    yield "word  two   three\n\n four <|endoftext|> five<|endoftext|>" * 50
    yield "the quick'll brown don't " * 200


def small():
    return bpe.Encoder(PATH, leaf=40, window=8, agree=8, chunk=90, overlap=10)


def test_ids_and_counts_equal_the_library(lib):
    e, cases = small(), list(texts())
    joins = 0
    for t, (got, n) in zip(cases, e.ids(cases)):
        joins += n
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, t[:80]
        assert e.count(t) == len(want), t[:80]
        assert e.decode(got) == lib.decode(want, skip_special_tokens=False) == t
        assert (n > 0) == (len(t) > e.leaf)
    assert joins > 1_000


def test_default_sizes_on_long_unsplit_text(lib):
    r = random.Random(3)
    e = bpe.Encoder(PATH)
    for a in ("abcdefghij", "é漢a", "01"):
        t = "".join(r.choice(a) for _ in range(60_000))
        want = lib.encode(t, add_special_tokens=False).ids
        assert e.ids([t]) == [(np.array(want, "<u4").tobytes(), 15)] and e.count(t) == len(want)


def test_windows_stay_small_in_ordinary_text(lib):
    r = random.Random(4)
    t = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 9))) for _ in range(40_000))
    e, sizes = bpe.Encoder(PATH), []
    plain = e.plain
    e.plain = lambda texts: sizes.extend(map(len, texts)) or plain(texts)
    leaves = e.halved(t)
    parts = e.pieced(leaves)
    sizes.clear()
    got, joins = e.tree(leaves, parts)
    assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    assert joins == len(leaves) - 1 >= 31 and sum(sizes) <= joins * 4 * bpe.WINDOW


def test_frames(spark, lib):
    rows = [(1, "the cat", "x"), (None, None, "y"), (2, "", None), (2, "", None), (3, "a" * 20_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), 7 if i == 3 else 0))
    assert got == sorted(want, key=str)
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.token_counts(docs, PATH).collect()}
    assert counts[3] == (20_000, want[-1][1], True) and counts[None] == (0, 0, False)
    assert bpe.token_counts(docs.limit(0), PATH).count() == 0
    assert {bytes(r.ids)[:4] for r in bpe.encode(docs.where("doc_id = 1"), PATH).collect()} == {np.array([lib.encode("the").ids[0]], "<u4").tobytes()}


def test_pieces_kept_are_bounded_and_those_met_again_stay(lib, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 400)
    r = random.Random(8)
    e, most = bpe.Encoder(PATH), 0
    for _ in range(60):
        cases = ["always here " + " ".join("w%d" % r.randrange(10**6) for _ in range(12)) for _ in range(5)]
        assert [x for x, _ in e.ids(cases)] == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in cases]
        most = max(most, len(e.cache) + len(e.older))
        assert " here" in e.cache
    assert 200 < most <= 400
    large = " ".join("v%d" % i for i in range(1_000))
    assert e.ids([large])[0][0] == np.array(lib.encode(large, add_special_tokens=False).ids, "<u4").tobytes() and len(e.cache) + len(e.older) <= 400


class Seen:
    """A tokenizer or model, and the characters that it was given."""

    def __init__(self, of):
        self.of, self.chars = of, 0

    def encode(self, text, **more):
        self.chars += len(text)
        return self.of.encode(text, **more)

    def encode_batch_fast(self, texts, **more):
        self.chars += sum(map(len, texts))
        return self.of.encode_batch_fast(texts, **more)

    def tokenize(self, text):
        self.chars += len(text)
        return self.of.tokenize(text)


def test_words_are_counted_once_whatever_sign_follows_and_in_long_texts_too(spark, lib, monkeypatch):
    r = random.Random(9)
    known = ["".join(r.choice("etaoinshrdluéß") for _ in range(r.randrange(3, 12))) for _ in range(400)]
    cases = [" ".join(r.choice(known) + r.choice(["", "", ",", ".", ".\nSo", "!!", "***", "'s"]) for _ in range(n)) for n in (50, 3_000, 3_000, 15_000)]
    assert len(cases[-1]) > 3 * bpe.CHUNK
    e = bpe.Encoder(PATH)
    monkeypatch.setitem(bpe._made, PATH, e)
    e.lib, e.model = Seen(e.lib), Seen(lib.model)
    monkeypatch.setattr(bpe, "in_arrow", lambda rows, run, schema: [x for b in run(iter(rows.toArrow().to_batches())) for x in b.to_pylist()])
    got = bpe.token_counts(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"), PATH)
    want = [len(lib.encode(t, add_special_tokens=False)) for t in cases]
    assert [(x["doc_id"], x["n_bytes"], x["n_tokens"]) for x in got] == [(i, len(t.encode()), n) for i, (t, n) in enumerate(zip(cases, want))]
    # each word, alone and with 's and what follows it up to a space, but nothing twice
    assert e.lib.chars + e.model.chars < 30_000 < sum(map(len, cases)) / 5


def test_counts_of_words_equal_the_library(lib, monkeypatch):
    monkeypatch.setattr(bpe, "COUNTED", 600)
    r = random.Random(10)
    parts = ["a", "Word", "don't", "'s", "'re", "é", "ª", "×", "漢", "ǅ", "é", "\U0001f600", "7", "²", "_", ".", ",", "!?", "***", "#", "&", "<", "|>", "<|endoftext|>", "<|endoftext", "\0", " ", " ", " ", "  ", "\n", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　"]
    e, least = bpe.Encoder(PATH), small()
    for _ in range(1_500):
        t = "".join(r.choice(parts) for _ in range(r.randrange(60)))
        n, words = len(lib.encode(t, add_special_tokens=False)), e.words(t)
        assert "".join(words) == t and sum(e.counted([words])[0]) == n == least.count(t), t
        assert len(e.counts) + len(e.older_counts) <= 600
    other = bpe.Encoder(PATH)
    other.fine = False  # as with special strings that hold signs
    assert other.words("a, b.") == ["a,", " b."] and sum(other.counted([other.words("a, b.")])[0]) == 4
    monkeypatch.setattr(bpe, "COUNTED", 20)
    assert sum(map(sum, e.counted([e.words("so %s" % " ".join(map(chr, range(97, 123))))]))) == 27 and len(e.counts) <= 10
