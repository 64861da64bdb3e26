"""WARC archives of pages: one gzip member per record, read back in sequence.

Each task writes the records of its rows into archives of its own below a shared folder and returns their names; the
reader opens an archive as a stream, inflates member after member in small pieces, frames each record by its
Content-Length and checks its digests. A task that is run again writes the same bytes under a new name, and only the
names that a finished task returned are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import materialise, shared_dir

#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
#: Records carry no time of writing of their own, so that a repeated run gives equal bytes.
WARC_DATE = "1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with record_type and refers_to.

    Of pages with equal html of at least ``least`` bytes (null is empty) that of the least page_id is the response, the
    others revisit it. Pages of null id come after all others; if a group has only such, all of it are responses, as
    rows that share the least id are.
    """
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("same"))
    first = pages.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    pages = pages.join(first, "same", "left").withColumn("refers_to", F.when(F.octet_length("html") >= least, F.expr("if(page_id is null or page_id <> first, first, null)")))
    return pages.select("page_id", "url", "html", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has its block's headers only, and the full payload's digest and length."""
    status = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = status if refers_to is not None else status + payload
    clean = "".join(c for c in url or "" if c > " " and c != "\x7f")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": WARC_DATE,
        "WARC-Target-URI": clean,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "WARC-Block-Digest": f"sha1:{digest_of(block)}",
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": str(len(block))}).items() if v)
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + deflate.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write marked pages into archives below ``folder``; (path, records) of each archive."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        out, path, n, size = None, "", 0, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])
        for batch in batches:
            for row in range(len(batch)):
                page_id, url, html, refers_to = (c[row].as_py() for c in batch.columns)
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = record(page_id, url, html.encode(), refers_to)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield done()
        if out is not None:
            out.close()
            yield done()

    return pages.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long")).mapInArrow(task, "path string, records long")


def members(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a stream of pieces."""
    inflate, parts = zlib.decompressobj(31), []
    for piece in stream:
        while piece:
            parts.append(inflate.decompress(piece))
            piece = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a member")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, framed by its Content-Length; digests are verified."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: its length is not {n}")
    if fields["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: its block differs from its digest")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{digest_of(payload)}":
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: its payload differs from its digest")
    return fields, block


def read(archives: DataFrame, folder: str, texts: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record, with ``html`` if asked for."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * texts

    def pieces(stream: object) -> Iterator[bytes]:
        while piece := stream.read(CHUNK):
            yield piece

    def number(field: str | None) -> int | None:
        digits = field[len("<urn:page:") : -1] if field else ""
        return int(digits) if digits else None

    kinds = pa.schema([(part.split()[0], pa.int64() if part.endswith("long") else pa.string()) for part in schema.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for path in (x.as_py() for batch in batches for x in batch.column(0)):
            rows = []
            with store.open_input_stream(path, compression=None) as stream:
                for member in members(pieces(stream)):
                    fields, block = parse(member)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    row = (number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], number(fields.get("WARC-Refers-To")))
                    rows.append((*row, payload.decode()) if texts else row)
                    if len(rows) >= (64 if texts else 4096):
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.types)], schema=kinds)

    n = max(1, archives.count())
    return archives.repartition(min(n, 10_000)).select("path").mapInArrow(task, schema)


def round_trip(spark: SparkSession, pages: DataFrame, texts: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html; further columns are ignored) as archives, then read these.

    One row per page. Null html is empty; white space and control characters of a url are left out. An empty table
    gives no archive and no rows.
    """
    folder = f"{shared_dir(spark, 'warc')}"
    return read(materialise(write(marked(pages), folder), "archives"), folder, texts)
