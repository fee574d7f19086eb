"""Dictionary-compressed WARC archives: writer and reader.

An archive is a ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary,
then one frame per record, so any record can be read alone with the file's own dictionary.  The dictionary is
trained on the archive's first records, ``SAMPLE_BYTES`` at most; every record is compressed with it.  Records
follow WARC/1.1: a ``response`` holds HTTP headers and the payload; a ``revisit`` (profile identical-payload-digest)
names the response that it repeats.

Of pages with equal payloads of ``LEAST`` bytes or more, that with the smallest page_id becomes the response.
Equality is that of length and SHA-256.  Only (digest, page_id) is grouped, with partial minima, so a payload that
a third of all pages share is no hot group; only digests that occur twice are joined back to the pages.

Defined cases: null html is an empty payload; a null page_id counts as larger than any other, and pages without any
non-null twin are responses; rows with the smallest page_id of their payload are all responses; a null url is written
as ``about:blank``; an empty table writes no archive and gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.shared import filesystem, settle, workspace, writing

LEAST = 100
SAMPLE_BYTES = 2 << 20
DICT_BYTES = 48 << 10
ARCHIVE_BYTES = 64 << 20
SKIPPABLE = 0x184D2A5D
DATE = "2000-01-01T00:00:00Z"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as bytes; a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    # A line break in a header value would end the header.
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from archived records, or None where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8, level=3)
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Writes records to one archive; the first of them are held back to train the dictionary."""

    def __init__(self, out):
        self.out, self.held, self.size, self.records, self.packer = out, [], 0, 0, None

    def add(self, record: bytes) -> None:
        self.size += len(record)
        self.records += 1
        if self.packer is None:
            self.held.append(record)
            if self.size >= SAMPLE_BYTES:
                self._begin()
        else:
            self.out.write(self.packer.compress(record))

    def _begin(self) -> None:
        sample, room = [], SAMPLE_BYTES
        for r in self.held:
            sample.append(r[: max(0, room)])
            room -= len(r)
        words = train([s for s in sample if s])
        if words is not None:
            data = words.as_bytes()
            self.out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
        held, self.held = self.held, []
        for r in held:
            self.out.write(self.packer.compress(r))

    def close(self) -> None:
        if self.packer is None:
            self._begin()


def read_archive(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, streamed; ``f`` is an open binary file."""
    head, words = f.read(8), None
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        words, head = zstandard.ZstdCompressionDict(f.read(struct.unpack("<II", head)[1])), b""

    class Rest:
        def read(self, n: int = -1) -> bytes:
            nonlocal head
            if head:
                out, head = head, b""
                return out
            return f.read(n)

    reader = zstandard.ZstdDecompressor(dict_data=words).stream_reader(Rest(), read_size=1 << 18, read_across_frames=True)
    buffer, at = b"", 0

    def more(n: int) -> bool:
        nonlocal buffer, at
        parts = [buffer[at:]]
        got = 0
        while got < n and (x := reader.read(max(n - got, 1 << 18))):
            parts.append(x)
            got += len(x)
        buffer, at = b"".join(parts), 0
        return got > 0

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more(1):
                if buffer[at:].strip():
                    raise ValueError("the archive ends inside a record")
                return
        lines = buffer[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        at = end + 4
        size = int(headers["Content-Length"])
        while len(buffer) - at < size + 4:
            if not more(size + 4 - (len(buffer) - at)):
                raise ValueError("the archive ends inside a record")
        yield headers, buffer[at : at + size]
        at += size + 4


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the response's page_id for revisits, else null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    p = p.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    long_ = F.octet_length("html") >= least
    first = p.where(long_).groupBy(F.col("digest").alias("_d")).agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1 AND first IS NOT NULL").drop("_n")
    j = p.join(first, (F.col("digest") == F.col("_d")) & long_, "left")
    return j.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives below ``root``; returns the manifest (path, records, raw_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(path: str, w: ArchiveWriter) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [path], "records": [w.records], "raw_bytes": [w.size]})

        def records() -> Iterator[bytes]:
            for rows in batches:
                text = rows.column("html").cast(pa.large_binary())
                for i, (page, url, digest, refers) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")), strict=True)):
                    yield warc_record(page, url, text[i].as_py(), digest, refers)

        left = records()
        while (first := next(left, None)) is not None:
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with writing(path) as out:
                w = ArchiveWriter(out)
                w.add(first)
                while w.size < archive_bytes and (r := next(left, None)) is not None:
                    w.add(r)
                w.close()
            yield done(path, w)

    return settle(with_revisits(pages).mapInArrow(run, "path string, records long, raw_bytes long"), f"{root}/manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path in rows.column("path").to_pylist():
                out, size = [], 0
                fs, name = filesystem(path)
                with fs.open_input_stream(name, compression=None) as f:
                    for h, block in read_archive(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = h["WARC-Type"] == "revisit"
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                        if not revisit and (len(payload) != length or f"sha256:{digest}" != h["WARC-Payload-Digest"]):
                            raise ValueError(f"payload and digest differ in {path}")
                        page, refers = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
                        out.append((page and int(page), length, digest, h["WARC-Type"], refers and int(refers), h["WARC-Target-URI"], None if revisit else payload))
                        size += len(payload)
                        if size >= 4 << 20 or len(out) >= 4096:
                            yield _batch(out)
                            out, size = [], 0
                if out:
                    yield _batch(out)

    n = manifest.count()
    return manifest.select("path").repartition(max(1, min(n, 4096))).mapInArrow(run, RESULT + ", url string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), workspace(spark, "warc"))
    return read_archives(manifest).drop("url", "payload")


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to
FROM f
"""
