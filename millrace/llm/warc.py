"""WARC archives in Zstandard with a dictionary.

Each archive begins with a skippable frame that holds a Zstandard dictionary, built from a bounded number of the
archive's own records; then each record is a frame of its own, compressed with it. So a reader can start at any record,
and small records share what is common to them. Without enough records for a dictionary the leading frame is left out.

Of records with equal payloads of ``REVISIT`` bytes or more, that with the largest page id is stored as response and the
others as revisits of it, without the payload. Equal payloads meet as digests: they are pre-aggregated, and only payloads
that occur twice or more are joined back, so a payload that a third of all pages share adds no page to any one task.

Tasks write archives to a shared folder through pyarrow's file systems, each under the name of its attempt; a row names
each archive that a task finished. Tasks that read open the archives so named, and no others. So a lost executor leaves at
most a file that nobody reads, and no archive goes through a shuffle.

Defined results: a null html is an empty payload; rows that tie for the largest id of a payload are all responses; rows
with a null id and a payload that another row has are revisits of it, or all responses if no row has an id; a null url is
an empty target; other columns are ignored. A very long payload is one record, held whole in memory where it is written and
read; records over ``SAMPLE_RECORD`` bytes aren't used for the dictionary.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.shared import shared_dir, stash

REVISIT = 1_000
#: An archive is closed beyond so many bytes, so that reading one fits a task's memory.
ARCHIVE_BYTES = 16_000_000
#: A dictionary is built from up to so many records and bytes, and has up to so many bytes itself.
SAMPLES, SAMPLE_BYTES, SAMPLE_RECORD, DICTIONARY_BYTES = 200, 1_000_000, 131_072, 32_768
#: Archives that a task reads where there are many.
TOGETHER = 8
LEVEL = 3

#: Fixed values of the formats: the skippable frame that holds a dictionary, and a data frame.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"

NO_ID = "none"


def record(kind: str, page: str, url: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A WARC/1.1 record around an HTTP response; a revisit has the response's header only."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("WARC/1.1\r\n" + "\r\n".join(head)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """A record's headers, in lower case, its HTTP headers as "http", and its payload."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"http": {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


class Archive:
    """Writer of one archive: the first records are held back until a dictionary can be built from them."""

    def __init__(self, out):
        self.out, self.held, self.bytes, self.records = out, [], 0, 0
        self.packer: zstandard.ZstdCompressor | None = None

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.packer:
            self.put(self.packer.compress(raw))
            return
        self.held.append(raw)
        if len(self.held) >= SAMPLES or sum(map(len, self.held)) >= SAMPLE_BYTES:
            self.begin()

    def begin(self) -> None:
        dictionary = None
        try:
            samples = [x for x in self.held if len(x) <= SAMPLE_RECORD]
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples)
        except zstandard.ZstdError:
            pass  # too few records
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
            self.put(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for x in self.held:
            self.put(self.packer.compress(x))
        self.held = []

    def put(self, frame: bytes) -> None:
        self.out.write(frame)
        self.bytes += len(frame)

    def close(self) -> None:
        if not self.packer:
            self.begin()
        self.out.close()


def frames(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed one by one."""
    at, dictionary = 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", raw, 4)[0]
        packed = raw[8 : 8 + size]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == FRAME else packed)
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(raw)
    while at < len(raw):
        one = reader.decompressobj()
        parts, begin = [], at
        while not one.eof:
            if begin >= len(raw):
                raise ValueError("the archive ends inside a record")
            piece = view[begin : begin + 65_536]
            parts.append(one.decompress(piece))
            begin += len(piece)
        at = begin - len(one.unused_data)
        yield b"".join(parts)


def opened(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


def kinds(pages: DataFrame, revisit: int = REVISIT) -> DataFrame:
    """(page_id, url, html, refers_to) of every row; refers_to is null for responses."""
    # 160 and 256 bits of digest and the length tell payloads apart; the digests are made in the scan
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.when(F.octet_length("html") >= revisit, F.sha2("html", 256))
    # the others can't meet any; keys of their own keep them from meeting in one task
    spread = F.coalesce(key, F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    same = rows.select("page_id", key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).where("n > 1 AND refers_to IS NOT NULL").select("key", "refers_to")
    return rows.withColumn("key", spread).join(stash(same, "warc-same"), "key", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")).alias("refers_to"))


def write(pages: DataFrame, folder: str, revisit: int = REVISIT, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) to archives in ``folder``: (name, records, bytes) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        archive, name, done = None, "", []
        for batch in batches:
            for page, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    archive = Archive(system.open_output_stream(f"{path}/{name}", compression=None))
                other = refers_to.as_py()
                archive.add(record("response" if other is None else "revisit", NO_ID if page.as_py() is None else str(page.as_py()), url.as_py().replace("\r", "%0D").replace("\n", "%0A"), html.as_py().encode(), other, date))
                if archive.bytes >= archive_bytes:
                    archive.close()
                    done.append((name, archive.records, archive.bytes))
                    archive = None
        if archive is not None:
            archive.close()
            done.append((name, archive.records, archive.bytes))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["name", "records", "bytes"])

    # the names of finished archives are a table of its own: rows of the attempts that Spark took
    return stash(kinds(pages, revisit).mapInArrow(run, "name string, records long, bytes long"), "warc-archives")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of ``archives`` (name): ids, type and digest, and the payload of responses if asked for."""
    schema = RECORD + ", payload binary" * payloads
    count = archives.count()
    tasks = max(1, min(count, max(3 * spark.sparkContext.defaultParallelism, count // TOGETHER)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with system.open_input_stream(f"{path}/{name}", compression=None) as source:
                    content = source.read()
                out: list[tuple] = []
                for raw in frames(content):
                    out.append(row(parsed(raw), payloads))
                    if len(out) == 1_000:
                        yield made(out, schema)
                        out = []
                yield made(out, schema)

    return archives.select("name").repartition(tasks).mapInArrow(run, schema)


def row(r: dict, payloads: bool) -> tuple:
    page, other = (x and x.removeprefix("<urn:page:").removesuffix(">") for x in (r["warc-record-id"], r.get("warc-refers-to")))
    kind, payload = r["warc-type"], r["payload"]
    digest = r["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of page {page} is not what its digest says")
    out = (None if page == NO_ID else int(page), r["warc-target-uri"], int(r["http"]["content-length"]), digest, kind, None if other is None else int(other))
    return (*out, payload if kind == "response" else None) if payloads else out


def made(out: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], types[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back: one row per page."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    names = write(pages, folder)
    if names.isEmpty():
        return spark.createDataFrame([], StructType.fromDDL(RECORD))
    return read(spark, names, folder)
