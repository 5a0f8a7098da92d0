"""WARC archives: a distributed writer and a splittable reader.

The writer makes each record a gzip member of its own. Pages with the same payload are
stored once; the others are revisit records that name it. Every task writes files under
a name of its own attempt and reports them in a manifest table, which Spark commits; files
of a failed attempt are in no manifest and are never read.

The reader cuts the files into byte ranges. A task looks for the gzip magic in its range,
takes a place for the start of a record only if it decodes to a WARC header, and
owns the records that start inside its range, wherever they end. So every record is
read by one task, and a lost task reads its own range again.

Files are opened by pyarrow from the folder's address (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stockloom.sources.scratch import keep, new_path

from .common import column

MAGIC = b"\x1f\x8b\x08"
#: Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_VERSION = b"WARC/1."
#: A file is closed beyond so many bytes; a range has so many.
FILE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20
_CHUNK = 1 << 16
#: A task reads at least one range and, of a large archive, about so many.
RANGES_PER_TASK = 128


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def record(key, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A gzip member with one record; a revisit, without the payload, if it refers to another."""
    revisit = refers_to is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(key)),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else len(payload)))),
    ]
    if url:
        fields.append(("WARC-Target-URI", "".join(url.split())))
    if revisit:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", _PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    parts = [head.encode(), http, b"" if revisit else payload, b"\r\n\r\n"]
    return b"".join([squeeze.compress(part) for part in parts] + [squeeze.flush()])


def revisits(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Key, digest and ``refers_to`` of each row whose payload a larger key has as well.

    Digests are reduced to their largest key before they are joined; a payload that a third
    of the rows share is a join of narrow rows, which Spark splits.
    """
    digests = keep(pages.select(F.col(key).alias("key"), _digest(payload).alias("digest")), "page_digests")
    latest = digests.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return digests.join(latest, "digest").where("key != refers_to").select("key", "digest", "refers_to").distinct()


def _digest(payload: str):
    return F.unhex(F.sha1(F.coalesce(F.col(payload).cast("binary"), F.lit(b""))))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write one record per row; the manifest, a table of path, bytes and records.

    A null payload is empty. Of equal payloads, the one with the largest key is a
    response and those with smaller keys revisit it; rows that repeat a key are all
    alike. Other columns of the input are not read.
    """
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")
    )
    others = keep(revisits(pages, key, payload), "revisits")
    rows = rows.join(
        others.withColumnRenamed("key", "other"),
        (F.col("key") == F.col("other")) & (F.unhex(F.sha1("payload")) == F.col("digest")),
        "left",
    ).select("key", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        names, sizes, counts, out = [], [], [], None
        for batch in batches:
            for k, u, body, to in zip(*[column(batch, c) for c in ("key", "url", "payload", "refers_to")]):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names)}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    names.append(name)
                    sizes.append(0)
                    counts.append(0)
                member = record(k, u, body, to)
                out.write(member)
                sizes[-1] += len(member)
                counts[-1] += 1
                if sizes[-1] >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        paths = [f"{folder.rstrip('/')}/{name}" for name in names]
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "bytes", "records"]
        )

    return keep(rows.mapInArrow(run, "path string, bytes bigint, records bigint"), "warc_manifest")


class _Range:
    """A byte range of a file, held in memory, and what follows it, read on demand."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.end, self.size = file, start, end, file.size()
        self.held = file.read_at(end - start + len(MAGIC) - 1, start)

    def read(self, at: int) -> bytes:
        inside = at - self.start
        if inside < len(self.held):
            return self.held[inside : inside + _CHUNK]
        return self.file.read_at(_CHUNK, at)

    def candidate(self, at: int) -> int | None:
        """The next place of the magic whose first byte is inside the range."""
        found = self.held.find(MAGIC, at - self.start)
        return None if found < 0 or self.start + found >= self.end else self.start + found


class _Member:
    """A gzip member, decoded piece by piece."""

    def __init__(self, source: _Range, at: int):
        self.source, self.at, self.end = source, at, None
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bytes:
        """The next decoded bytes; none at the end of the member."""
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail or self.source.read(self.at)
            if not raw:
                raise ValueError("the archive ends inside a record")
            if not self.inflate.unconsumed_tail:
                self.at += len(raw)
            out = self.inflate.decompress(raw, 1 << 20)
            if self.inflate.eof:
                self.end = self.at - len(self.inflate.unused_data)
            if out:
                return out
        return b""

    def head(self) -> tuple[dict[str, str], bytes] | None:
        """The WARC header fields and what was decoded behind them; None if this is no record.

        Headers may have any length. Once the version line is decoded this is a record, and
        what ends or breaks before its header does is an error.
        """
        got, looked = bytearray(), 0
        try:
            while (end := got.find(b"\r\n\r\n", looked)) < 0:
                looked = max(0, len(got) - 3)
                part = self.more()
                got += part
                if not got.startswith(_VERSION) and (not part or not _VERSION.startswith(got)):
                    return None
                if not part:
                    raise ValueError("a record ends inside its header")
        except (zlib.error, ValueError):
            if got.startswith(_VERSION):
                raise
            return None
        return _fields(bytes(got[:end])), bytes(got[end + 4 :])


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


_READ = (
    "record_id string, record_type string, url string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, "
    "path string"
)


def records_in(file, path: str, start: int, end: int, payload: bool) -> Iterator[tuple]:
    """The records that start in a byte range.

    The digest of a response is computed from its payload and held against its header; that
    of a revisit, and its length, are those of the payload it refers to. Records follow each
    other without a gap, so whatever comes behind a record and is none is an error.
    """
    source = _Range(file, start, end)
    at, follows = source.candidate(start), False
    while at is not None:
        member = _Member(source, at)
        try:
            found = member.head()
        except (zlib.error, ValueError) as wrong:
            raise ValueError(f"{path}: the record at byte {at} cannot be read: {wrong}") from wrong
        if found is None:
            if follows:
                raise ValueError(f"{path}: no record begins at byte {at}, where one ends")
            at = source.candidate(at + 1)
            continue
        fields, block = found
        kind = fields.get("warc-type", "")
        left = int(fields["content-length"]) - len(block)
        while b"\r\n\r\n" not in block and (part := member.more()):
            block += part
            left -= len(part)
        http, _, body = block.partition(b"\r\n\r\n")
        declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        hash_, size, kept = hashlib.sha1(), 0, []
        wanted = int(fields["content-length"]) - len(http) - 4
        part = body
        while True:
            part = part[: max(0, wanted - size)]
            hash_.update(part)
            size += len(part)
            if payload and part:
                kept.append(part)
            part = member.more()
            if not part:
                break
        if kind == "revisit":
            length, digest, content = int(_fields(http).get("content-length", 0)), declared, None
        else:
            length, digest = size, base64.b32encode(hash_.digest()).decode()
            content = b"".join(kept) if payload else None
            if size != wanted or declared not in ("", digest):
                raise ValueError(f"{path}: the record at byte {at} does not have the payload it declares")
        yield fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), length, digest, content
        at, follows = source.candidate(member.end), True
        if member.end < min(end, source.size) and at != member.end:
            raise ValueError(f"{path}: no record begins at byte {member.end}, where one ends")


def read(manifest: DataFrame, payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the files in a manifest (path, bytes): ids, type, url, payload and its digest,
    and the path of the file.

    ``payload`` false leaves the payloads out (the digests are still computed from them).
    Headers may have any length. A file of another size than the manifest has, one that ends
    inside a record or has something between records, and a payload that is not the one its header
    declares, are errors. An empty manifest has no records. ``complete`` holds the
    records that were read against the manifest's numbers.
    """
    files = manifest.where("bytes > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = files.select("path", "bytes", F.explode(starts).alias("start"))
    ranges = ranges.select("path", "bytes", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    # By number: adaptive execution would merge the tasks, as the rows that name the ranges are small.
    n = files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 0
    tasks = max(1, min(n, max(manifest.sparkSession.sparkContext.defaultParallelism * 4, n // RANGES_PER_TASK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _READ.split(", ")]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for path, size, start, end in zip(*[column(batch, c) for c in ("path", "bytes", "start", "end")]):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    if file.size() != size:
                        raise ValueError(f"{path}: {file.size()} bytes, but the manifest has {size}")
                    rows: list[tuple] = []
                    held = 0
                    for row in records_in(file, path, start, end, payload):
                        rows.append((*row, path))
                        held += len(row[-1] or b"")
                        if len(rows) >= 1000 or held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

    return ranges.repartition(tasks, "path", "start").mapInArrow(run, _READ)


def complete(records: DataFrame, manifest: DataFrame) -> None:
    """An error unless each file of a manifest gave as many records as were written to it."""
    found = records.groupBy("path").agg(F.count(F.lit(1)).alias("found"))
    wrong = manifest.join(found, "path", "full").where("coalesce(found, 0) != coalesce(records, 0)").first()
    if wrong is not None:
        raise ValueError(f"{wrong.path}: {wrong.found or 0} records were read, {wrong.records or 0} written")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all pages to the shared folder and read the archives back, one row per record.

    Fewer or more records than were written, in any file, are an error. A null payload is
    empty, repeated rows and null keys are records like any other, and no page gives no row.
    """
    manifest = write(pages, new_path(pages.sparkSession, "warc"), key, url, payload)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("bigint"))
    records = keep(read(manifest, payload=False).drop("payload", "url"), "warc_records")
    complete(records, manifest)
    return records.select(
        number("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
