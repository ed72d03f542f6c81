import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from millrace.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def texts():
    r = random.Random(9)
    yield from [None, "", "mail a.b+c@x-y.co.uk_z@q.de, é\U0001f600 x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255", "+1 (555) 123-4567 +49 89 1234567890123456", "4111 1111 1111 1111 and 4111-1111-1111-1112", "5500 0000 0000 0004", "a@b.c" * 30, "@" * 50 + "a@b." + "a" * 3000, "1" * 6000, "1." * 3000, "a." * 4000, "a@" + "b." * 5000 + "c", "+" + "1 " * 3000]
    alphabet = ["a", "B", "@", ".", "-", "_", "+", "1", "25", "4111111111111111", " ", "(", ")", "é", "\n", "4", "0", "10.0.0.1", "x@y.zz", "+49 171 2345678"]
    for _ in range(300):
        yield "".join(r.choice(alphabet) for _ in range(r.choice([5, 20, 60])))


def test_base_spans_and_sanitised_text(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"mark": F.lit(1), "spans": F.lit("x"), "extra": F.lit(2)})
    got = sorted(map(tuple, pii.report(docs).collect()), key=str)
    want = []
    for i, t in rows:
        spans = plain(t)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want.append((i, *(sum(s[1] == j for s in spans) for j in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert got == sorted(want, key=str)
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    texts_ = []
    for i, t in rows:
        out, at = "", 0
        for a, _, b, k in plain(t):
            out, at = (out + t[at:a] + f"<{k.upper()}>" if a >= at else out), max(at, b)
        texts_.append((i, t if t is None else out + t[at:]))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(texts_, key=str)


def test_disclosing_terms(spark):
    r = random.Random(3)
    filler = lambda: " ".join("common%s" % "abcdefgh"[r.randrange(8)] for _ in range(12))
    rows = [(i, f"{filler()} Meyerling at {filler()[:15]} boss@firm.com {filler()}" if i < 5 else filler()) for i in range(60)]
    rows += [(100 + i, "copied Unique words near ip 10.1.2.3 here") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.report(docs).collect()}
    for i, t in rows[:5]:
        a = t.index("Meyerling")
        assert f"term:{a}:{a + 9}" in got[i] and got[i].count("term") == 1, (t, got[i])
    assert not any("term" in got[i] for i, _ in rows[5:])
    clean = {x.doc_id: x.text for x in pii.sanitised(docs).collect()}
    assert "<TERM> at" in clean[0] and "<EMAIL>" in clean[0] and clean[9] == rows[9][1]


def test_many_spans_in_one_long_text(spark):
    """Time in proportion to the spans: 50,000 addresses, between words and in one run, and overlapping kinds."""
    many = " ".join("mail user%d@firm%d.com" % (i, i % 7) for i in range(50_000))
    run = ",".join("10.%d.%d.%d" % (i % 256, i // 256, i % 100) for i in range(10_000))
    mixed_kinds = " ".join("+49 171 555%04d 10.0.%d.%d x@%d.0.0.1.de" % (i, i % 200, i % 100, i % 250) for i in range(2_000))
    rows = [(1, many), (2, run), (3, mixed_kinds), (4, "é" * 5000 + " a@b.de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    got = {x.doc_id: x.spans.split(",") for x in pii.report(docs).collect()}
    clean = {x.doc_id: x.text for x in pii.sanitised(docs).collect()}
    assert time.time() - began < 600
    for i, t in rows:
        assert [x for x in got[i] if x[:4] != "term"] == [f"{k}:{a}:{b}" for a, _, b, k in plain(t)], i
    assert clean[1] == " ".join(["mail <EMAIL>"] * 50_000) and clean[2] == ",".join(["<IP>"] * 10_000) and clean[4] == "é" * 5000 + " <EMAIL>"


def test_terms_are_free_of_spans_around_them(spark):
    """Terms of contexts against all spans of the text."""
    r = random.Random(8)
    parts = ["Term", "worduser@mail.com", "10.0.0.1", "+49 171 2345678", "1.2.3.4@x.de", "ééééname@x.com", "Other", "of", "4111 1111 1111 1111", "+4111111111111111"]
    rows = [(i, r.choice([" ", ""]).join(r.choice(parts) for _ in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for x in pii.found(docs).collect():
        t = dict(rows)[x.doc_id]
        spans = plain(t)
        assert len(x.contexts or []) == len(spans)
        for (a, _, b, _), c in zip(spans, x.contexts or []):
            low = max(0, a - pii.REACH)
            want = [(low + m.start(), low + m.end()) for m in re.finditer(r"[^\W\d_]{4,}", t[low:a]) if m.start() > 0 or low == 0]
            want += [(b + m.start(), b + m.end()) for m in re.finditer(r"[^\W\d_]{4,}", t[b : b + pii.REACH]) if m.end() < pii.REACH]
            want = [(p, q, t[p:q].lower()) for p, q in want if not any(u < q and p < v for u, _, v, _ in spans)]
            assert [(y.start, y.stop, y.value) for y in c.terms] == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(docs).count() == 0 and pii.sanitised(docs).count() == 0


def test_few_contexts_and_all_occurrences(spark):
    words = lambda i: "plain words of this long filler text number %d which all the documents hold and which say nothing" % i
    rows = [(i, words(i)) for i in range(3000)]
    rows += [(4000, f"{words(1)} Meyerling mail boss@firm.com"), (4001, f"{words(2)} other Meyerling text boss@firm.com {words(3)} meyerling {words(4)}")]
    rows += [(4100 + i, "Copyterm near 10.1.2.3 here") for i in range(3)] + [(4200, "Lonely near 10.9.2.3 here")]
    rows += [(4300 + i, f"Twicecopied 10.8.2.3 {words(5)} twicecopied text 10.8.2.3") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.report(docs).collect()}
    for i, t in rows[3000:3002]:
        at = [m.start() for m in re.finditer("meyerling", t.lower())]
        assert [s for s in got[i].split(",") if s.startswith("term")] == [f"term:{a}:{a + 9}" for a in at]
    assert not any("term" in s for i, s in got.items() if i not in (4000, 4001))
    clean = {x.doc_id: x.text for x in pii.sanitised(docs).collect()}
    assert clean[4001].count("<TERM>") == 2 and "eyerling" not in clean[4001]


def flagged_by_counting(rows):
    """Terms that disclose a value or its pool, by plain counting over all texts."""
    context, contexts_of, by_row, holds, entity_rows = 60, {}, {}, {}, {}
    for at, (_, t) in enumerate(rows):
        t = t or ""
        spans = plain(t)
        for m in set(re.findall(r"[^\W\d_]{4,}", t.lower())):
            holds.setdefault(m, set()).add(at)
        for a, _, b, kind in spans:
            low = max(0, a - context)
            left, right = t[low:a], t[b : b + context]
            found = [(low + m.start(), low + m.end()) for m in re.finditer(r"[^\W\d_]{4,}", left) if m.start() > 0 or low == 0]
            found += [(b + m.start(), b + m.end()) for m in re.finditer(r"[^\W\d_]{4,}", right) if m.end() < context]
            terms = {t[p:q].lower() for p, q in found if not any(u < q and p < v for u, _, v, _ in spans)}
            bare = re.sub(r"[ ().-]", "", t[a:b]).lower()
            pool = {"email": t[a:b].lower().rsplit("@", 1)[-1], "ip": ".".join(t[a:b].split(".")[:2])}.get(kind, bare[: pii.POOL])
            for e in ((kind, bare), (kind, "pool", pool)):
                entity_rows.setdefault(e, set()).add(at)
                for x in terms:
                    by_row.setdefault((e, x), set()).add(at)
                    contexts_of.setdefault((e, x), {}).setdefault((left, right), t)
    out, n = set(), len(rows)
    for (e, x), seen in contexts_of.items():
        # a context that several texts share counts for one of them
        texts = len(set(seen.values()))
        if texts < pii.LEAST or len(entity_rows[e]) >= n:
            continue
        share = texts / (texts + max(0, len(holds[x]) - len(by_row[e, x])))
        floor = (len(entity_rows[e]) / n) ** (1 - pii.DISCLOSED)
        if share > floor:
            apart = share * math.log(share / floor) + ((1 - share) * math.log((1 - share) / (1 - floor)) if share < 1 else 0)
            if texts / share * apart >= -math.log(pii.DOUBT):
                out.add(x)
    return out


def test_terms_are_those_of_plain_counting(spark):
    r = random.Random(12)
    words = ["word%s%s" % (a, b) for a in "abcdefghij" for b in "abcdefghij"]
    firms = {"acme": "Zaphod", "globex": "Trillian", "initech": "Marvin"}
    rows = []
    for i in range(1500):
        body = [r.choice(words) for _ in range(40)]
        if i % 50 == 0:
            firm = r.choice(list(firms))
            # each address is new, so only their domain repeats
            body[20:20] = [firms[firm] if r.random() < 0.9 else "nobody", f"user{i}@{firm}.com"] + (["alsonear%s" % "xyz"[i % 3]] if i % 100 == 0 else [])
        if i % 70 == 0:
            body[5:5] = ["nobody", r.choice([f"10.{i % 3}.3.{i % 250}", "+49 171 55%05d" % i])]
        rows.append((i, " ".join(body)))
    rows += [(2000 + i, rows[7 * i][1]) for i in range(40)]
    want = flagged_by_counting(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = set()
    for x in pii.report(docs).collect():
        t = dict(rows)[x.doc_id]
        got |= {t[int(s.split(":")[1]) : int(s.split(":")[2])].lower() for s in x.spans.split(",") if s.startswith("term")}
    assert got == want and {"zaphod", "trillian", "marvin"} <= want and "nobody" not in want, (got, want)


def test_other_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "mail a@b.de", "x", 1, "y", 2.0)], "doc_id long, text string, pii_mark string, PII_BASE int, pii_extra string, pii_spans double")
    assert tuple(pii.sanitised(docs).first()) == (1, "mail <EMAIL>", "x", 1, "y", 2.0)
