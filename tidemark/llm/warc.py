"""WARC archives with an index that is written first, and reads of selected records by byte range.

Every record is a gzip member of its own. While a task writes its archive, it returns one index row per
record (file, offset, length, URL, digest); the index is stored before anything is read. Reads sort the
selected rows by file and offset, merge neighbouring ranges and fetch each merged range once.

A task writes under a name of its own and its rows count only if Spark commits them, so a repeated or
speculative attempt leaves at most a file that no index row names.

Defined results: a null payload is empty, a null URL is written as ``urn:none`` and read back as null, a
null page id is written as ``none``; such a record is always a response. Equal rows give equal records.
Of pages that share the largest id, all are responses. An empty table gives an empty index. Columns
beyond id, URL and payload are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.skew import even_join
from tidemark.llm.words import partitions
from tidemark.session import work_dir, written

INDEX = (
    "page_id long, url string, record_type string, digest string, payload_bytes long, "
    "file string, offset long, length long"
)
RECORD = (
    "page_id long, url string, record_type string, digest string, payload_bytes long, "
    "refers_to long, payload binary"
)
LEAST_SHARED = 1000
FILE_BYTES = 1 << 30
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
_URN = "urn:page:"


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: equal payloads refer to the one with the largest page id.

    Digests are counted with partial sums first; the join back to the pages can be split on a digest
    that many pages share.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha1("payload"))
    shared = (
        rows.filter(F.length("payload") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .drop("n")
    )
    return even_join(rows, shared, ["digest"], "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("page_id") != F.col("newest"), F.col("newest")).alias("refers_to"),
    )


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One record. A revisit keeps the HTTP head with the length of the payload it leaves out."""
    number = lambda n: f"<{_URN}{'none' if n is None else n}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {number(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {'urn:none' if url is None else quote(url, safe=_SAFE)}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {number(refers_to)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(map(chr, range(33, 127)))


def write_archives(pages: DataFrame, path: str | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``page_id, url, html`` below ``path`` (default: the shared work folder); returns the stored index."""
    folder = path or work_dir(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        part, out, name, offset = TaskContext.get().partitionId(), None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, refers_to in zip(
                    *[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")],
                    strict=True,
                ):
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    member = gzip.compress(
                        record_bytes(page_id, url, payload, digest, refers_to, date), compresslevel=4, mtime=0
                    )
                    out.write(member)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((page_id, url, kind, digest, len(payload), name, offset, len(member)))
                    offset += len(member)
                yield _batch(rows, _INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    index = with_revisits(pages).mapInArrow(write, INDEX)
    return written(index, "warc-index").withColumn("folder", F.lit(folder))


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in ddl.split(", "))])


_INDEX_ARROW, _RECORD_ARROW = _arrow(INDEX), _arrow(RECORD)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def parse_record(record: bytes) -> tuple:
    """A record's bytes as a row of ``RECORD``; the digest of a response is checked against its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda v: None if v is None or v.endswith(":none>") else int(v.removeprefix(f"<{_URN}").rstrip(">"))
    url = None if fields["WARC-Target-URI"] == "urn:none" else fields["WARC-Target-URI"]
    return (
        number(fields["WARC-Record-ID"]), url, kind, digest, size,
        number(fields.get("WARC-Refers-To")), payload if kind == "response" else None,
    )


def merged_ranges(places: list[tuple[int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted ``(offset, length)`` pairs as ``(start, end, members)``: near neighbours share a read."""
    ranges: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in places:
        end = offset + length
        if ranges and offset - ranges[-1][1] <= GAP_BYTES and end - ranges[-1][0] <= READ_BYTES:
            start, last, members = ranges.pop()
            ranges.append((start, max(last, end), [*members, (offset, length)]))
        else:
            ranges.append((offset, end, [(offset, length)]))
    return ranges


def read_records(selected: DataFrame) -> DataFrame:
    """The records named by index rows (``folder, file, offset, length``), as ``RECORD`` rows."""
    count = partitions(selected.sparkSession)
    places = (
        selected.select("folder", "file", "offset", "length")
        .repartitionByRange(count, "folder", "file", "offset")
        .sortWithinPartitions("folder", "file", "offset")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_file: dict[tuple[str, str], list[tuple[int, int]]] = {}
            for folder, file, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                by_file.setdefault((folder, file), []).append((offset, length))
            for (folder, file), wanted in by_file.items():
                files, base = pafs.FileSystem.from_uri(folder)
                with files.open_input_file(f"{base}/{file}") as archive:
                    for start, end, members in merged_ranges(wanted):
                        data = archive.read_at(end - start, start)
                        rows = []
                        for offset, length in members:
                            member = data[offset - start : offset - start + length]
                            rows.append(parse_record(zlib.decompress(member, wbits=31)))
                        yield _batch(rows, _RECORD_ARROW)

    return places.mapInArrow(read, RECORD)


def scan_archive(data: bytes) -> list[tuple]:
    """All records of one archive without its index, for checks of small files."""
    rows, stream = [], io.BytesIO(data)
    while member := stream.read():
        reader = zlib.decompressobj(wbits=31)
        rows.append(parse_record(reader.decompress(member) + reader.flush()))
        stream = io.BytesIO(reader.unused_data)
    return rows
