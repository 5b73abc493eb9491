"""WARC archives as a chunked record table.

Payloads travel as (record id, chunk number) rows of bounded size, on the way into the archive and out of it. The
digest of a record grows with its chunks and stands in each of its rows, so a record is never held whole in Python,
and its last row has the digest of all.

Archives are gzip files with a member for each record. Records with equal payloads are stored once, as the response of
the smallest page id; the others are revisits that name it and carry the payload's digest and length.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import cut_lineage, table
from foretrace.llm.registry import query
from foretrace.sources.writers import scratch_path

CHUNK = 64 * 1024
FILE_BYTES = 256_000_000
BATCH_BYTES = 4_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records bigint, n_bytes bigint"
CHUNKS = (
    "record_id string, page_id bigint, record_type string, refers_to bigint, chunk_no int, data binary, "
    "payload_bytes bigint, payload_digest string, is_last boolean"
)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_name(page: int | None) -> str:
    return "urn:x-page:" + ("" if page is None else str(page))


def page_number(name: str | None) -> int | None:
    tail = (name or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def classify(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = 0) -> DataFrame:
    """Each page's payload with its SHA-1, length, record type and what it refers to.

    Groups of equal payloads are found by digest and length on narrow rows, pre-aggregated; the payloads themselves are
    moved once, by page id, so a payload that very many pages share does not gather in a task.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("bigint").alias("n"),
    )
    narrow = rows.select(F.col("page_id").alias("page"), F.col("sha1").alias("hash"), "n").distinct()
    first = narrow.groupBy("hash", "n").agg(F.min("page").alias("first"))
    verdict = narrow.join(first, ["hash", "n"]).select("page", "hash", "first")
    again = (F.col("n") >= least_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(verdict, rows.page_id.eqNullSafe(verdict.page) & (rows.sha1 == verdict.hash))
    return joined.select(
        "page_id", "url", "payload", "sha1", "n",
        F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def payload_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of at most ``chunk`` payload bytes; a revisit and an empty payload have one empty row."""
    count = F.when(F.col("type") == "revisit", 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") / chunk))).cast("int")
    numbered = records.withColumn("count", count).withColumn("no", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    data = F.when(F.col("type") == "revisit", F.lit(b"")).otherwise(F.substring("payload", F.col("no") * chunk + 1, F.lit(chunk)))
    return numbered.select("page_id", "url", "type", "refers_to", "sha1", "n", "no", (F.col("no") + 1 == F.col("count")).alias("last"), data.alias("data"))


class ArchiveWriter:
    """One archive; records come in chunk by chunk."""

    def __init__(self, path: str):
        self.path, self.bytes, self.records = path, 0, 0
        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(inner), recursive=True)
        self.out = system.open_output_stream(inner, compression=None)
        info = b"software: foretrace\r\nformat: WARC File Format 1.1\r\n"
        self._open([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], len(info))
        self._write(info)
        self._end()

    def _write(self, data: bytes) -> None:
        self._put(self.gzip.compress(data))

    def _put(self, data: bytes) -> None:
        self.bytes += len(data)
        self.out.write(data)

    def _open(self, headers: list[tuple[str, str]], length: int) -> None:
        self.gzip = zlib.compressobj(1, zlib.DEFLATED, 31)
        lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(length))])
        self._write(f"WARC/1.1\r\n{lines}\r\n".encode())

    def _end(self) -> None:
        self._write(b"\r\n\r\n")
        self._put(self.gzip.flush())

    def begin(self, page: int | None, url: str | None, kind: str, refers_to: int | None, sha1: str, n: int) -> None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
        headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_name(page)}>"), ("WARC-Date", DATE)]
        if url is not None:
            headers.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
        headers.append(("WARC-Payload-Digest", "sha1:" + _base32(bytes.fromhex(sha1))))
        if kind == "revisit":
            headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_name(refers_to)}>")]
        headers.append(("Content-Type", "application/http; msgtype=response"))
        self._open(headers, len(http) + (n if kind == "response" else 0))
        self._write(http)
        self.left, self.digest, self.said = (n if kind == "response" else 0), hashlib.sha1(), sha1
        self.check = kind == "response"

    def add(self, data: bytes) -> None:
        self.left -= len(data)
        self.digest.update(data)
        self._write(data)

    def end(self) -> None:
        if self.left or (self.check and self.digest.hexdigest() != self.said):
            raise ValueError("chunks of a record are missing or out of order")
        self._end()
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def write_archives(chunks: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write chunk rows, whose records are in order within a partition, below ``root``; returns the written manifest.

    ``root`` must be a folder that all executors share. Files are named after the attempt that wrote them and count only
    if the manifest lists them, so what a lost task left behind is never read.
    """

    def write(batches):
        part, attempt, archive, seq, rows = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], None, 0, []
        for batch in batches:
            for page, url, kind, refers_to, sha1, n, no, last, data in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    archive = ArchiveWriter(f"{root}/{part:06d}-{seq:06d}-{attempt}.warc.gz")
                if no == 0:
                    archive.begin(page, url, kind, refers_to, sha1, n)
                archive.add(data)
                if last:
                    archive.end()
                    if archive.bytes >= file_bytes:
                        rows.append(archive.close())
                        archive, seq = None, seq + 1
        if archive is not None:
            rows.append(archive.close())
        types = pa.string(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["path", "n_records", "n_bytes"])

    return cut_lineage(chunks.mapInArrow(write, MANIFEST))


class _Members:
    """Reads a gzip file of many members as one stream of bytes, a bounded piece at a time."""

    def __init__(self, path: str):
        system, inner = fs.FileSystem.from_uri(path)
        self.file = system.open_input_stream(inner, compression=None)
        self.gzip, self.raw, self.ready = zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.gzip.eof:
                self.raw, self.gzip = self.gzip.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(CHUNK)
                if not self.raw:
                    return False
            got = self.gzip.decompress(self.raw, CHUNK)
            self.raw = b"" if self.gzip.eof else self.gzip.unconsumed_tail
            if got:
                self.ready += got
                return True

    def read(self, most: int) -> bytes:
        """Between 1 and ``most`` bytes, or none at the end."""
        if not self.ready and not self._more():
            return b""
        out, self.ready = self.ready[:most], self.ready[most:]
        return out

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        while (at := self.ready.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.ready.strip():
                    raise ValueError("an archive ends inside a record")
                return None
        out, self.ready = self.ready[: at + 4], self.ready[at + 4 :]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]) if k}


def record_rows(path: str, chunk: int = CHUNK):
    """The rows of an archive, one after the other: as in ``CHUNKS``."""
    source = _Members(path)
    while (head := source.head()) is not None:
        fields = _fields(head.lstrip())
        length, kind = int(fields["content-length"]), fields["warc-type"]
        http, payload_bytes = {}, None
        if kind in ("response", "revisit"):
            inner = source.head()
            length -= len(inner)
            http = _fields(inner)
            payload_bytes = int(http["content-length"])
        name = fields["warc-record-id"].strip("<>")
        said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        page = page_number(name) if kind in ("response", "revisit") else None
        refers_to = page_number(fields.get("warc-refers-to")) if kind == "revisit" else None
        digest, seen, no, piece = hashlib.sha1(), 0, 0, b""
        while True:
            while length and len(piece) < chunk:
                got = source.read(min(length, chunk - len(piece)))
                if not got:
                    raise ValueError("an archive ends inside a record")
                piece, length = piece + got, length - len(got)
            digest.update(piece)
            seen += len(piece)
            last = not length
            if kind == "response":
                if last and _base32(digest.digest()) != said:
                    raise ValueError(f"{name} does not have the digest that its header states")
                yield name, page, kind, None, no, piece, seen, _base32(digest.digest()), last
            elif kind == "revisit":
                yield name, page, kind, refers_to, no, piece, payload_bytes, said, last
            if last:
                break
            no, piece = no + 1, b""
        if source.head() not in (b"\r\n\r\n", None):
            raise ValueError(f"{name} is not followed by an empty line")


def read_archives(manifest: DataFrame, *, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of all archives: ``payload_bytes`` and ``payload_digest`` are those up to the row's chunk.

    Archives are read by one task each and dealt out by path. Without ``with_data`` the chunks are checked and dropped.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in record_rows(path, chunk):
                    if with_data:
                        held += len(row[5])
                    else:
                        row = (*row[:5], None, *row[6:])
                        if not row[-1]:
                            continue
                    rows.append(row)
                    if held >= BATCH_BYTES or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    partitions = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(partitions, "path").mapInArrow(read, CHUNKS)


def archive_pages(pages: DataFrame, root: str, *, least_revisit: int = 0, chunk: int = CHUNK, **columns: str) -> DataFrame:
    """Write every page as a record below ``root`` and return the manifest.

    A null payload is an empty one, a null URL leaves its header out, null ids are kept and never referred to unless a
    payload has no other. Rows with the id of the response and its payload are all responses. Line ends and spaces in a
    URL are written as %XX. Payloads under ``least_revisit`` bytes are all responses. An empty table makes no file.
    """
    return write_archives(payload_chunks(classify(pages, least_revisit=least_revisit, **columns), chunk), root)


@query("op5_warc_records")
def op5_warc_records(spark, sf_dir):
    manifest = archive_pages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    ends = read_archives(manifest, with_data=False).where("is_last")
    return ends.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["archive_pages", "read_archives", "record_rows", "write_archives"]
