"""WARC archives of pages: a deterministic sharded writer, and a reader.

* Equal payloads are found by digest, one line per digest that occurs twice; the page with the smallest id becomes the
  response record, the others revisit records that refer to it.
* Shards are ranges of ids with about equal bytes, worked out from a histogram of ``BUCKETS`` equal slices of the id
  range, so that reruns cut alike whatever the number of tasks. A shard is written in order of ids by one task, which
  holds a record at a time, and goes on to a new file when the compressed size reaches ``roll_bytes``.
* Headers and digests are made anew; record ids follow from page and payload, dates from a parameter: reruns give equal
  bytes. A file is written under a temporary name and renamed when whole, so a task can be lost and run again at any
  time. Only files that the manifest lists count; it is a table, committed by Spark when all files stand.

Pages travel through one shuffle. Files go to a folder that all executors reach by URI (``file:``, ``hdfs:``, ``s3:``).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.sources.shared import SharedTable, materialise, scratch_path

BUCKETS = 1 << 14
#: Shards hold at least so many bytes, and there are at most so many shards.
SHARD_BYTES = 32 << 20
SHARDS = 8192
#: Compressed size at which a shard goes on to its next file; pages compress to about a fifth, so a shard has some files.
ROLL_BYTES = 2 << 20
#: Tasks that read archives back, at most.
READERS = 1 << 14
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
_END = b"\r\n\r\n"


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(value: str) -> str:
    """A value fit for one header line."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, copy: int, refers: tuple[int | None] | None, date: str) -> bytes:
    """One record; ``copy`` counts rows of the same page and payload, ``refers`` holds the id that a revisit refers to."""
    name = digest(payload)
    own = lambda page, n: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}:{name}:{n}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {own(page_id, copy)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{name}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {own(refers[0], 0)}")
        if refers[0] is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers[0]}")
    return "\r\n".join(lines).encode() + _END + block + _END


class _File:
    """A file under a temporary name."""

    def __init__(self, folder: str, shard: int, number: int):
        self.system, root = fs.FileSystem.from_uri(folder)
        self.shard, self.number, self.name = shard, number, f"pages-{shard:06d}-{number:05d}.warc.gz"
        self.final, self.temporary = f"{root}/{self.name}", f"{root}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.system.create_dir(root, recursive=True)
        self.out = self.system.open_output_stream(self.temporary, compression=None)
        self.sha, self.size, self.records = hashlib.sha256(), 0, 0

    def add(self, data: bytes) -> None:
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def commit(self) -> tuple:
        self.out.close()
        self.system.move(self.temporary, self.final)
        return self.shard, self.number, self.name, self.records, self.size, self.sha.hexdigest()


_MANIFEST = "shard long, number long, name string, records long, bytes long, sha256 string"
_COLUMNS = [c.split()[0] for c in _MANIFEST.split(", ")]


def _shards(sizes: DataFrame, shard_bytes: int) -> DataFrame:
    """``bucket, shard``, at most ``BUCKETS`` + 1 lines, from ``bucket, bytes`` of each page."""
    totals = sizes.groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    order = Window.orderBy("bucket")
    before = F.sum("bytes").over(order) - F.col("bytes")
    least = F.greatest(F.lit(shard_bytes), F.ceil(F.sum("bytes").over(Window.partitionBy()) / SHARDS))
    return totals.select(F.col("bucket").alias("of"), F.floor(before / least).cast("long").alias("shard"))


def write_archives(
    pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE,
) -> SharedTable:
    """Write a record per row and return the manifest (``shard, number, name, records, bytes, sha256``).

    Page ids are integers. A null payload is empty, a null URL leaves its header out. Of rows with equal payloads of
    ``min_bytes`` at least, the one with the smallest id is the response; null ids come last and are no ids to refer to.
    Of rows that repeat an id and payload the first (by URL) is taken, the others revisit it. No rows: no files.
    """
    plain = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    )
    narrow = materialise(plain.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes")), "payloads")
    firsts = narrow.df.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    twins = materialise(firsts.filter("n > 1").drop("n"), "twins")
    notes = narrow.df.join(twins.df, "digest").select("page_id", "digest", "first").distinct()
    low, high = narrow.df.agg(F.min("page_id"), F.max("page_id")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // BUCKETS))
    bucket = F.coalesce(F.floor((F.col("page_id") - F.lit(low or 0)) / width), F.lit(BUCKETS)).cast("int")
    # A line of headers costs some bytes as well.
    shards = materialise(_shards(narrow.df.select(bucket.alias("bucket"), (F.col("bytes") + 512).alias("bytes")), shard_bytes), "shards")
    rows = plain.select("page_id", F.sha1("payload").alias("digest"), F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first"))
    both = rows.unionByName(notes.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "first"))
    # The shards' table has at most BUCKETS + 1 lines.
    dealt = both.withColumn("bucket", bucket).join(F.broadcast(shards.df), F.col("bucket") == F.col("of"))
    order = [F.col("shard"), F.col("page_id").isNull(), F.col("page_id"), F.col("digest"), F.col("kind"), F.col("url")]
    lines = dealt.select("shard", "page_id", "digest", "kind", "url", "payload", "first").repartition("shard").sortWithinPartitions(*order)
    manifest = materialise(lines.mapInArrow(_writer(folder, roll_bytes, date), _MANIFEST), "manifest")
    for table in (narrow, twins, shards):
        table.drop()
    return manifest


def _writer(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        file: _File | None = None
        note = last = None
        copy = 0

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=_COLUMNS)

        for batch in batches:
            columns = [batch.column(k) for k in range(7)]
            for row in range(batch.num_rows):
                shard, page, name, kind, url, payload, first = (c[row].as_py() for c in columns)
                if kind == 0:
                    note = ((page, name), first)
                    continue
                if file and (file.shard != shard or file.size >= roll_bytes):
                    made.append(file.commit())
                    number = file.number + 1 if file.shard == shard else 0
                    file = _File(folder, shard, number)
                file = file or _File(folder, shard, 0)
                copy = copy + 1 if last == (page, name) else 0
                last = (page, name)
                twin = note and note[0] == last
                refers = (note[1],) if twin and (copy or note[1] != page) else None
                file.add(record(page, url, payload.encode(), copy, refers, date))
        if file:
            made.append(file.commit())
        if made:
            yield listed()

    return run


def _members(system: fs.FileSystem, path: str) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    with system.open_input_stream(path, compression=None) as stream:
        inflate, parts, rest = zlib.decompressobj(31), [], b""
        while data := rest or stream.read(1 << 20):
            parts.append(inflate.decompress(data))
            rest = b""
            if inflate.eof:
                yield b"".join(parts)
                rest = inflate.unused_data
                inflate, parts = zlib.decompressobj(31), []


def parse(data: bytes) -> dict:
    """The page of a record: id, bytes and digest of the whole payload, type, and the id referred to. Fails if a digest
    or length of the record does not fit its content."""
    head, block = data.split(_END, 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, payload = block.split(_END, 1)
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    name = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (size != len(payload) or name != digest(payload)):
        raise ValueError(f"payload of {fields['WARC-Record-ID']}")
    number = lambda key: int(fields[key]) if key in fields else None
    return {
        "page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": name, "record_type": kind,
        "refers_to": number("X-Refers-To-Page-Id"), "url": fields.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None,
    }


_PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def read_archives(manifest: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` (and ``url, payload``, which revisits lack) of
    every record of the files in the manifest, each read as a stream by one task and checked against its digests."""
    schema = T.StructType([*_PAGE.fields, *([T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType())] if with_payload else [])])
    target = pa.schema([pa.field(f.name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, size, total = [], 0, 0
                for data in _members(system, f"{root}/{name}"):
                    found.append({c: v for c, v in parse(data).items() if c in target.names})
                    size, total = size + (len(data) if with_payload else 1000), total + 1
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(found, target)
                        found, size = [], 0
                if total != records:
                    raise ValueError(f"{name} holds {total} records, not {records}")
                if found:
                    yield pa.RecordBatch.from_pylist(found, target)

    # An explicit number of partitions (adaptive execution joins small ones otherwise), a task per file up to READERS.
    files = max(1, min(READERS, manifest.count()))
    return manifest.select("name", "records").repartition(files, "name").mapInArrow(run, schema)


def written_and_read(pages: DataFrame, **more) -> DataFrame:
    """Write archives below the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **more).df, folder)
