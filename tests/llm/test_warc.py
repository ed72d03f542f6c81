import hashlib
import struct

import pytest
import zstandard

from millrace.llm import warc
from millrace.llm.shared import shared_dir


def plain(rows):
    out = []
    for i, u, h in rows:
        p = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == p and j is not None]
        other = max(same) if len(p) >= 1000 and same and max(same) != i else None
        out.append((i, u or "", len(p), hashlib.sha1(p).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(out, key=str)


def rows():
    big = "<html>" + "é x" * 800
    return [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (9, "http://a/9", big), (None, "u", big), (3, "http://b", None), (4, "http://b", ""), (5, "x\r\ny", "small"), (6, "x", "small"), (None, None, "n" * 2000), (None, None, "n" * 2000), (7, "z", "a\r\n\r\nb" * 400), (8, "l", "q" * 3_000_000)] + [(100 + i, f"http://c/{i}", f"<p>page {i} of many</p>" * (i % 90)) for i in range(400)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").selectExpr("*", "'k' AS key", "1 AS n", "2 AS refers_to")
    got = sorted(map(tuple, warc.archived(pages).collect()), key=str)
    assert got == [(i, u.replace("\r", "%0D").replace("\n", "%0A"), *x) for i, u, *x in plain(rows())]
    folder = f"{shared_dir(spark)}/warc-test"
    names = warc.write(pages, folder, archive_bytes=2_000)
    assert names.count() > 8
    back = warc.read(spark, names, folder, payloads=True).collect()
    texts = {i: (h or "") for i, _, h in rows() if i is not None}
    assert all(r.payload.decode() == texts[r.page_id] for r in back if r.record_type == "response" and r.page_id is not None)


def test_archive_format(tmp_path):
    path = tmp_path / "a.warc.zst"
    a = warc.Archive(path.open("wb"))
    raw = [warc.record("response", str(i), f"http://h/{i}", f"<html><body>page {i} text</body></html>".encode() * 20, None, "2024-01-01T00:00:00Z") for i in range(300)]
    for r in raw:
        a.add(r)
    a.close()
    data = path.read_bytes()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    assert data[8 + size : 12 + size] == warc.FRAME and dictionary.dict_id() == zstandard.get_frame_parameters(data[8 + size :]).dict_id
    assert list(warc.frames(data)) == raw
    with pytest.raises(ValueError):
        list(warc.frames(data[:-3]))


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(pages).count() == 0
