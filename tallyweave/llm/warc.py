"""WARC archives: writing page tables as records, and a sequential reader.

Every record is one gzip member, so a reader can start at any of them. The reader inflates piece by piece, takes the
header block up to its empty line, then as many bytes as Content-Length says, and checks that the record ends where
its member ends and that block and payload digests hold. It never holds a whole record.

Equal payloads are stored once: of those of ``LEAST`` bytes or more the record with the largest id is a response and
the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import released, stored
from tallyweave.session import shared_dir

LEAST = 1000
PIECE = 1 << 16
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


class BadRecord(ValueError):
    """An archive that does not follow the format, is cut short, or whose digest differs."""


def digest_name(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    text = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def http_head(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: bytes,
           refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that refers to another page's response."""
    block = http_head(size) + (payload if refers_to is None else b"")
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
             ("WARC-Date", DATE)]
    if url:
        lines.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if refers_to is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    lines += [("WARC-Payload-Digest", digest_name(sha1)),
              ("WARC-Block-Digest", digest_name(hashlib.sha1(block).digest())),
              ("Content-Type", HTTP_TYPE), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head) + deflate.compress(block) + deflate.compress(END) + deflate.flush()


class Member:
    """The bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, source: BinaryIO, held: bytes) -> None:
        self._source, self._raw, self._inflate, self._ready = source, held, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        """Inflate another piece; false at the end of the member."""
        if self._inflate.eof:
            return False
        raw = self._inflate.unconsumed_tail or self._raw or self._source.read(PIECE)
        self._raw = b""
        if not raw:
            raise BadRecord("the archive ends within a record")
        try:
            self._ready += self._inflate.decompress(raw, PIECE)
        except zlib.error as exc:
            raise BadRecord(f"not a gzip member: {exc}") from exc
        return True

    def until(self, mark: bytes) -> bytes:
        """All bytes before ``mark``, which is passed over; the member itself is the bound."""
        held, seen = bytearray(self._ready), 0
        while (at := held.find(mark, seen)) < 0:
            seen, self._ready = max(0, len(held) - len(mark) + 1), b""
            if not self._more():
                raise BadRecord("no end of the header block")
            held += self._ready
        self._ready = bytes(held[at + len(mark):])
        return bytes(held[:at])

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in pieces."""
        while size:
            if not self._ready and not self._more():
                raise BadRecord("the record is shorter than its Content-Length")
            got, self._ready = self._ready[:size], self._ready[size:]
            size -= len(got)
            if got:
                yield got

    def finish(self) -> bytes:
        """Check that nothing follows, and give back the bytes read beyond this member."""
        while self._more():
            if self._ready:
                break
        if self._ready:
            raise BadRecord("more than one record in a gzip member")
        return self._inflate.unused_data


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """Each record in turn: its headers by lower-case name, and the length and SHA-1 of the HTTP body it holds."""
    held = source.read(PIECE)
    while held:
        member = Member(source, held)
        version, _, text = member.until(END).partition(b"\r\n")
        if version != VERSION:
            raise BadRecord(f"unknown version {version[:20]!r}")
        headers = {}
        for line in text.decode().split("\r\n"):
            name, colon, value = line.partition(":")
            if not colon:
                raise BadRecord("a header line without a colon")
            headers[name.strip().lower()] = value.strip()
        try:
            left = int(headers["content-length"])
        except (KeyError, ValueError) as exc:
            raise BadRecord("no valid Content-Length") from exc
        block, payload, size, head = hashlib.sha1(), hashlib.sha1(), 0, b""
        for piece in member.pieces(left):
            block.update(piece)
            if head is not None:  # up to the empty line after the HTTP header
                head += piece
                at = head.find(END)
                if at < 0:
                    continue
                piece, head = head[at + len(END):], None
            payload.update(piece)
            size += len(piece)
        if b"".join(member.pieces(len(END))) != END:
            raise BadRecord("no empty lines after the block")
        if headers.get("warc-block-digest", found := digest_name(block.digest())) != found:
            raise BadRecord("the block digest differs")
        if headers.get("warc-type") == "response" and \
                headers.get("warc-payload-digest", found := digest_name(payload.digest())) != found:
            raise BadRecord("the payload digest differs")
        yield headers, size, payload.digest()
        held = member.finish() or source.read(PIECE)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``folder``, one archive per task.

    Returns (path, records). A null html is an empty payload. Of rows with equal payloads of ``least`` bytes or more,
    those with the largest page_id are responses (repeated rows each), the others revisits; rows without page_id are
    responses. A task writes to a name of its own and renames at the end, so a repeated task leaves one archive.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"))
    sums = rows.select("page_id", F.sha2("html", 256).alias("payload"), F.octet_length("html").alias("size"))
    owners = stored(sums.filter((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("payload")
                    .agg(F.max("page_id").alias("owner"), F.min("page_id").alias("other"))
                    .filter("owner > other").drop("other"))
    revisit = F.col("owner") > F.col("page_id")
    tagged = rows.withColumn("payload", F.sha2("html", 256)).join(owners, "payload", "left").select(
        "page_id", "url", F.when(revisit, None).otherwise(F.col("html")).alias("html"),
        F.octet_length("html").cast("long").alias("size"), F.sha1("html").alias("sha1"),
        F.when(revisit, F.col("owner")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        final = f"{base}/part-{task.partitionId():06d}.warc.gz"
        own, count = f"{final}.{task.taskAttemptId()}", 0
        with files.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(k) for k in range(6)), strict=True):
                    page_id, url, html, size, sha1, refers_to = row
                    out.write(record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes() if html.is_valid
                                     else b"", size.as_py(), bytes.fromhex(sha1.as_py()), refers_to.as_py()))
                    count += 1
        if files.get_file_info(final).type != fs.FileType.NotFound:
            files.delete_file(final)
        files.move(own, final)
        yield pa.RecordBatch.from_pydict({"path": [final], "records": [count]})

    return stored(tagged.mapInArrow(released(write), "path string, records long"))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records of the archives in ``index``.

    A revisit takes size and digest from the response that it names; one whose response is missing or has another
    digest raises.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with files.open_input_stream(path, compression=None) as source:
                    for headers, size, sha1 in read_records(source):
                        kind, refers = headers["warc-type"], headers.get("warc-refers-to")
                        named = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
                        rows.append((page_of(headers["warc-record-id"]), size if kind == "response" else None,
                                     (sha1 if kind == "response" else named).hex(), kind,
                                     None if refers is None else page_of(refers)))
                if len(rows) != expected:
                    raise BadRecord(f"{path} has {len(rows)} records, {expected} were written")
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(),
                                                              pa.int64()), strict=True)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    tasks = max(1, index.count())
    got = stored(index.repartition(tasks).mapInArrow(released(read), schema))
    named = got.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    known = stored(got.filter("record_type = 'response'").join(named, "page_id", "left_semi")
                   .select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full"),
                           F.col("payload_digest").alias("named")).distinct())
    lost = F.raise_error(F.concat(F.lit("no equal response for the revisit of page "), F.col("refers_to")))
    size = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(
        F.when(F.col("named") == F.col("payload_digest"), F.col("full")).otherwise(lost.cast("long")))
    return got.join(known, "refers_to", "left").select(
        "page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder), folder)


SQL = """
WITH sums AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), owned AS (
  SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
         CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS owner
  FROM sums
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner > page_id THEN owner END AS refers_to
FROM owned
"""
