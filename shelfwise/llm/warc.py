"""WARC archives in seekable Zstandard bundles.

Every task writes bundles: records are grouped into Zstandard frames that can be decompressed one by one, and a
skippable frame at the end (the seek table of the seekable format) lists the sizes of all frames.  An index row a
record says in which bundle and frame it lies and where in the decompressed frame it begins, so a record is read by
decompressing one frame.  A payload that occurs more than once is stored once; the other records are revisits.

Bundles get a name of their own for every attempt of a task and the index is written by Spark's commit, so a lost
executor or a repeated task leaves at most files that no index row names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.llm.common import Out, rows, spark_schema
from shelfwise.operators.keyed import join_hot
from shelfwise.session import cut_lineage, durable_path

FRAME_BYTES = 1 << 20  # a frame is closed from this size on; a larger record has a frame of its own
BUNDLE_BYTES = 256 << 20  # compressed
TASK_BYTES = 64 << 20  # compressed bytes that a reading task gets

# fixed values of the seekable Zstandard format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = pa.schema([("bundle", pa.string()), ("frame", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()),
                   ("page_id", pa.string()), ("record_type", pa.string())])
FRAMES = pa.schema([("bundle", pa.string()), ("frame", pa.int64()), ("at", pa.int64()), ("packed", pa.int64()), ("size", pa.int64())])
RECORDS = pa.schema([("record_id", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def file_system(path: str):
    """(file system, path in it) of a folder or file that all executors reach."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def record(kind: str, record_id: str, page_id: str | None, url: str | None, digest: str, n: int, payload: bytes, date: str,
           refers_id: str | None, refers_to: str | None) -> bytes:
    """One WARC/1.1 record.  Its block is an HTTP response; a revisit holds the header of that response only."""
    def clean(text: str) -> str:
        return quote(text, safe="%/:?#[]@!$&'()*+,;=~-._")

    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
            ("WARC-Target-URI", clean(url) if url else record_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        head.append(("Page-ID", quote(page_id, safe="")))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_id}>")]
        if refers_to is not None:
            head.append(("Page-Refers-To", quote(refers_to, safe="")))
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``start``."""
    cut = data.index(b"\r\n\r\n", start)
    first, *lines = data[start:cut].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {start}")
    head = dict(line.split(": ", 1) for line in lines)
    end = cut + 4 + int(head["Content-Length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {start} is cut off")
    return head, data[cut + 4:end], end + 4


def describe(head: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS; the digest of a stored payload is computed again and must agree."""
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(http.rpartition(b"Content-Length: ")[2])
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != n or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    page, refers = head.get("Page-ID"), head.get("Page-Refers-To")
    return (head["WARC-Record-ID"][1:-1], None if page is None else unquote(page), kind, head["WARC-Target-URI"], n, digest,
            None if refers is None else unquote(refers), payload if kind == "response" else None)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Bundle:
    """Writes one bundle; ``add`` tells where a record lies."""

    def __init__(self, folder: str, level: int):
        import zstandard

        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        store, inner = file_system(self.path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        self.file = store.open_output_stream(inner, compression=None)
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.held, self.size, self.sizes, self.written = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.held and self.size + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.sizes), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        packed = self.compress(b"".join(self.held))
        self.file.write(packed)
        self.sizes.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of every frame, read from the end of a bundle."""
    end = file.size()
    file.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * n)
    out, at = [], 0
    for packed, size in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((at, packed, size))
        at += packed
    return out


def _write(folder: str, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, out = None, Out(INDEX)
        columns = "record_id", "page_id", "url", "sha1", "n", "payload", "revisit", "refers_id", "refers_to"
        for record_id, page_id, url, sha1, n, payload, revisit, refers_id, refers_to in rows(batches, *columns, held=64):
            if bundle is None:
                bundle = Bundle(folder, level)
            kind = "revisit" if revisit else "response"
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            url = None if url is None else url.decode("utf-8", "replace")
            data = record(kind, record_id, page_id, url, digest, n, payload or b"", date, refers_id, refers_to)
            frame, start = bundle.add(data)
            if out.add(bundle.path, frame, start, len(data), record_id, page_id, kind):
                yield out.take()
            if bundle.written >= BUNDLE_BYTES:
                bundle.close()
                bundle = None
        if bundle is not None:
            bundle.close()
        yield out.take()
    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
                   least_bytes: int = 0, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` into bundles below ``folder``; gives the index (a written table).

    The payload is the column's UTF-8 as it is, also where it is invalid; null is empty.  Of records with equal payloads of at
    least ``least_bytes`` bytes the one with the smallest id is a response (a null id counts as larger than any; of rows with
    the same id the one with the smallest address, and one only of equal rows), the others are revisits that refer to it.
    A null address is replaced by the record's identifier.  Other columns are ignored.  An empty table gives an empty index and no file.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    staged = cut_lineage(pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").cast("binary").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("n"),
        F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("key"), F.monotonically_increasing_id().alias("row")))
    name = F.md5(F.concat_ws("/", F.col("page_id").cast("string"), "sha1", F.col("row").cast("string")).cast("binary"))
    cuts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    staged = staged.withColumn("record_id", F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cuts)))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("nowhere"), "url", "row", "record_id")
    groups = cut_lineage(staged.where(F.col("n") >= least_bytes).groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("times"))
                         .where("times > 1").select("key", "first"))
    known = join_hot(staged, groups, "key", "left")
    revisit = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False)) & (F.col("n") >= least_bytes)
    out = known.select(
        "record_id", F.col("page_id").cast("string").alias("page_id"), "url", "sha1", "n", F.when(~revisit, F.col("payload")).alias("payload"), revisit.alias("revisit"),
        F.col("first.record_id").alias("refers_id"), F.col("first.page_id").cast("string").alias("refers_to"))
    return cut_lineage(out.mapInArrow(_write(folder, level, date), spark_schema(INDEX)))


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Out(FRAMES)
    for (bundle,) in rows(batches, "bundle"):
        store, inner = file_system(bundle)
        with store.open_input_file(inner) as file:
            for frame, place in enumerate(seek_table(file)):
                if out.add(bundle, frame, *place):
                    yield out.take()
    yield out.take()


def _frame(bundle: str, at: int, packed: int, size: int) -> bytes:
    import zstandard

    store, inner = file_system(bundle)
    with store.open_input_file(inner) as file:
        return zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=size)


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(RECORDS)
        for bundle, at, packed, size in rows(batches, "bundle", "at", "packed", "size"):
            data, place = _frame(bundle, at, packed, size), 0
            while place < len(data):
                head, block, place = parse(data, place)
                *row, payload = describe(head, block)
                if out.add(*row, payload if with_payload else None, size=len(payload or b"") if with_payload else 0):
                    yield out.take()
        yield out.take()
    return run


def _typed(records: DataFrame, id_type: str) -> DataFrame:
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def frames(index: DataFrame) -> DataFrame:
    """(bundle, frame, at, packed, size) of all frames, from the seek tables of the bundles."""
    return index.select("bundle").distinct().mapInArrow(_frames, spark_schema(FRAMES))


def read_archives(spark: SparkSession, index: DataFrame, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """Every record of the bundles, read frame by frame; damaged records end the job.

    A revisit has the size and digest of the payload it refers to and no payload.
    """
    found = cut_lineage(frames(index))
    packed = found.agg(F.sum("packed")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-packed // TASK_BYTES))
    dealt = found.repartition(tasks, "bundle", "frame")
    return _typed(dealt.mapInArrow(_read(with_payload), spark_schema(RECORDS)), id_type)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, last, data = Out(RECORDS), None, b""
    for bundle, at, packed, size, start in rows(batches, "bundle", "at", "packed", "size", "start"):
        if (bundle, at) != last:
            data, last = _frame(bundle, at, packed, size), (bundle, at)
        head, block, _ = parse(data, start)
        row = describe(head, block)
        if out.add(*row, size=len(row[-1] or b"")):
            yield out.take()
    yield out.take()


def fetch(index: DataFrame, ids: DataFrame, id_type: str = "long") -> DataFrame:
    """The records of the pages in ``ids`` (page_id); only the frames that hold one are read, each once."""
    wanted = index.withColumn("page_id", F.col("page_id").cast(id_type)).join(ids.select("page_id").distinct(), "page_id", "left_semi")
    placed = wanted.select("bundle", "frame", "start").join(frames(wanted), ["bundle", "frame"])
    return _typed(placed.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "start").mapInArrow(_fetch, spark_schema(RECORDS)), id_type)


def archive_folder(spark: SparkSession) -> str:
    return durable_path(spark, "warc")
