"""WARC archives: write, normalise monolithic gzip files, and read through an offset index.

An archive that was compressed as one gzip stream can only be read from its start.  The
normaliser inflates such a file once, in bounded pieces, rewrites every record as a gzip
member of its own, and writes a sidecar index with each record's offset and length, so that
any record can be read alone and a large file can be split over tasks.

Files are reached through ``pyarrow.fs`` by uri, in a folder that all executors share.
Tasks write under a name of their own and move the file to its final name, and write equal
files when repeated.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldlake.scale import lookup_join, scratch_path

VERSION = b"WARC/1.1"
BREAK = b"\r\n"
CHUNK = 1 << 18
MAX_HEADER = 1 << 16
LEAST_SHARED_BYTES = 100  # smaller payloads are always written in full
DATE = "1970-01-01T00:00:00Z"  # the tables hold no fetch time


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes


def file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_bytes(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in headers], f"Content-Length: {len(block)}".encode(), b"", b""]
    return BREAK.join(lines) + block + BREAK + BREAK


def page_record(page_id, url: str | None, html: str | None, digest: str, size: int, refers_to) -> bytes:
    """Response record of a page, or a revisit that repeats the http header but not the payload."""
    http = BREAK.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {size}".encode(), b"", b""])
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
               ("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return record_bytes(headers, http + (b"" if refers_to is not None else (html or "").encode()))


def _one_line(value: str | None) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value or "")


class Inflated:
    """Bytes of a gzip file of any number of members, inflated once from start to end."""

    def __init__(self, source):
        self.source, self.engine, self.raw, self.ready = source, zlib.decompressobj(31), b"", bytearray()
        self.started = False

    def more(self) -> bool:
        """Inflate one more piece of at most CHUNK bytes; False at the end."""
        while True:
            if not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    if self.started and not self.engine.eof:
                        raise EOFError("the gzip stream is cut off")
                    return False
            if self.engine.eof:
                self.engine = zlib.decompressobj(31)
            self.started = True
            piece = self.engine.decompress(self.raw, CHUNK)
            self.raw = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
            if piece:
                self.ready += piece
                return True

    def until(self, mark: bytes, most: int) -> bytes:
        """Bytes up to and with ``mark``; empty at the end of the file."""
        at = -1
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if seen > most:
                raise ValueError("a record header is too long")
            if not self.more():
                if self.ready.strip():
                    raise ValueError("bytes after the last record")
                return b""
        return self.take(at + len(mark))

    def take(self, size: int) -> bytes:
        while len(self.ready) < size:
            if not self.more():
                raise EOFError("a record is cut off")
        out = bytes(self.ready[:size])
        del self.ready[:size]
        return out

    def rest_of(self, size: int) -> Iterator[bytes]:
        """``size`` bytes in bounded pieces."""
        while size:
            if not self.ready and not self.more():
                raise EOFError("a record is cut off")
            piece = self.take(min(size, len(self.ready)))
            size -= len(piece)
            yield piece


def parse_header(raw: bytes) -> dict[str, str]:
    lines = raw.strip().split(BREAK)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}


def normalise(source, target, index) -> int:
    """Rewrite one archive so that every record is a gzip member; index lines name offset, length, type and id.

    Memory stays at a few pieces whatever the size of the file or of a record.
    """
    data, offset, count = Inflated(source), 0, 0
    while raw := data.until(BREAK + BREAK, MAX_HEADER):
        header = parse_header(raw)
        size = int(header["content-length"])
        packer, written = zlib.compressobj(6, zlib.DEFLATED, 31), 0

        def put(piece: bytes) -> None:
            nonlocal written
            written += len(piece)
            target.write(piece)

        put(packer.compress(raw))
        for piece in data.rest_of(size):
            put(packer.compress(piece))
        if data.take(4) != BREAK + BREAK:
            raise ValueError("a record does not end where its length says")
        put(packer.compress(BREAK + BREAK))
        put(packer.flush())
        index.write((json.dumps({"offset": offset, "length": written, "type": header.get("warc-type"),
                                 "id": header.get("warc-record-id")}) + "\n").encode())
        offset, count = offset + written, count + 1
    return count


def read_record(source, offset: int, length: int) -> Record:
    """One record through its index entry."""
    source.seek(offset)
    data = zlib.decompress(source.read(length), 31)
    raw, _, rest = data.partition(BREAK + BREAK)
    header = parse_header(raw)
    return Record(header, rest[:int(header["content-length"])])


def _finished(system, temporary: str, final: str) -> None:
    """Give a written file its final name; a repeated task finds an equal file there and keeps it."""
    from pyarrow import fs
    if system.get_file_info(final).type == fs.FileType.NotFound:
        system.move(temporary, final)
    else:
        system.delete_file(temporary)


def with_revisits(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Add payload size, digest, and for repeated payloads the page that holds the first one.

    The smallest key of a payload is its response; rows with another key refer to it.  Only
    payloads that occur more than once are looked up, and frequent ones do not skew the join.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    sized = pages.withColumn("__digest", F.sha2(payload, 256)).withColumn("__size", F.octet_length(payload).cast("long"))
    firsts = sized.where((F.col("__size") >= LEAST_SHARED_BYTES) & F.col(key).isNotNull()).groupBy("__digest").agg(
        F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    found = lookup_join(sized, firsts, "__digest", "__n")
    return found.withColumn("__refers", F.when(F.col("__first") != F.col(key), F.col("__first"))).drop("__first", "__n")


def write_monolithic(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one gzip stream per partition; returns ``(path, records)`` of the files once an action runs it."""
    rows = with_revisits(pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).cast("string").alias("h")), "k", "h")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        number = TaskContext.get().partitionId()
        system, base = file_system(folder)
        final, own = f"{base}/part-{number:05d}.warc.gz", f"{base}/_{uuid.uuid4().hex}"
        packer, count, out = zlib.compressobj(6, zlib.DEFLATED, 31), 0, None
        for batch in batches:
            for k, u, h, digest, size, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(own)
                out.write(packer.compress(page_record(k, u, h, digest, size, refers)))
                count += 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            _finished(system, own, final)
            yield pa.RecordBatch.from_pydict({"path": [final], "records": pa.array([count], pa.int64())})

    return rows.select("k", "u", "h", "__digest", "__size", "__refers").mapInArrow(write, "path string, records bigint")


def normalise_files(files: DataFrame, folder: str) -> DataFrame:
    """Normalise each file in ``files`` (``path``): returns ``(path, index, records)`` of the new pairs."""
    def work(batches):
        import pyarrow as pa
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1]
                finals = [f"{base}/{name}", f"{base}/{name}.idx"]
                own = [f"{base}/_{uuid.uuid4().hex}" for _ in finals]
                with system.open_input_stream(path, compression=None) as source, \
                        system.open_output_stream(own[0], compression=None) as target, \
                        system.open_output_stream(own[1], compression=None) as index:
                    count = normalise(source, target, index)
                for a, b in zip(own, finals):
                    _finished(system, a, b)
                yield pa.RecordBatch.from_pydict({"path": [finals[0]], "index": [finals[1]], "records": pa.array([count], pa.int64())})

    return files.select("path").mapInArrow(work, "path string, index string, records bigint")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Entries ``(path, offset, length, type, id)`` of all sidecar files of a normalised folder."""
    rows = spark.read.schema("offset bigint, length bigint, type string, id string").option("pathGlobFilter", "*.idx").json(folder)
    return rows.withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), r"\.idx$", ""))


def read_records(entries: DataFrame) -> DataFrame:
    """Page, type, payload and reference of each indexed record, read by offset.

    Columns ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload``;
    the size and digest are those of the full payload, which a revisit only refers to.
    """
    def read(batches):
        import pyarrow as pa
        from hashlib import sha256
        from urllib.parse import unquote
        opened: tuple[str, object] | None = None
        for batch in batches:
            found = []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if opened is None or opened[0] != path:
                    if opened:
                        opened[1].close()
                    system, place = file_system(path)
                    opened = path, system.open_input_file(unquote(place))
                record = read_record(opened[1], offset, length)
                http, _, payload = record.block.partition(BREAK + BREAK)
                size = int(next(x.split(b":")[1] for x in http.split(BREAK) if x.lower().startswith(b"content-length:")))
                kind, digest = record.headers["warc-type"], record.headers["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and (len(payload) != size or sha256(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {record.headers['warc-record-id']} is damaged")
                found.append((_page(record.headers["warc-record-id"]), record.headers.get("warc-target-uri"), kind, size, digest,
                              _page(record.headers.get("warc-refers-to", "")), payload if kind == "response" else None))
            columns = list(zip(*found)) if found else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [
                "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
        if opened:
            opened[1].close()

    return entries.select("path", "offset", "length").mapInArrow(
        read, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def _page(record_id: str) -> int | None:
    digits = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as archives, normalise them, and read every record back.

    One row per row of ``pages``.  Null html is an empty payload; a null url is an empty
    target; a null key stays null, and its payload is always written in full; rows that
    repeat the response's key are responses too.  An empty table gives no rows, and other
    columns are not read.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark)
    spread = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    written = write_monolithic(spread, f"{folder}/monolithic", "page_id", "url", "html").collect()  # one row per file
    if not written:
        return read_records(spark.createDataFrame([], "path string, offset bigint, length bigint"))
    files = spark.createDataFrame([(r["path"],) for r in written], "path string").repartition(len(written))
    normalise_files(files, f"{folder}/records").collect()
    entries = read_index(spark, f"{folder}/records")
    return read_records(entries)
