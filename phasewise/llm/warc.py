"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames of some records each and a
skippable frame with the seek table of the published seekable format, so any
frame is found from the end of the file. The index maps each record to its
bundle, frame and offset in the frame's plain bytes. Bundles are written under
names of their own and the index is what commits them: a task that runs again
leaves a file that no index row names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Fixed values of the seekable format: skippable frame 0xE, and the footer's magic number.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Plain bytes after which a frame, and compressed bytes after which a bundle is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Plain bytes of frames that a reading task gets, about.
READ_BYTES = 64 << 20
#: Shortest payload that may be replaced by a revisit record.
LEAST_REVISIT = 100
#: The fixed date keeps archives of equal pages equal.
DATE = "2000-01-01T00:00:00Z"

INDEX = "page_id long, bundle string, frame int, frame_offset long, record_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])


def record_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{page_id}')}>"


def _clean(value: str | None) -> str:
    return "".join(" " if c in "\r\n" else c for c in value or "")


def record(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record; a revisit has the full payload's size and digest but not its bytes."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: {record_urn(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case names), content, and the position after the record at `at`."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    begin = end + 4
    stop = begin + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} has no end")
    return fields, data[begin:stop], stop + 4


class BundleWriter:
    """Writes records to one bundle; add() returns (frame, offset in the frame)."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.plain, self.table, self.size = bytearray(), [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.plain and len(self.plain) + len(data) > FRAME_BYTES:
            self._frame()
        at = len(self.table), len(self.plain)
        self.plain += data
        return at

    def _frame(self) -> None:
        packed = self.packer.compress(bytes(self.plain))
        self.sink.write(packed)
        self.table.append((len(packed), len(self.plain)))
        self.size += len(packed)
        self.plain = bytearray()

    def close(self) -> None:
        if self.plain:
            self._frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class BundleReader:
    """Frames of a bundle by number, found through the seek table at its end."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("the bundle has no seek table")
        width = 12 if descriptor & 0x80 else 8
        source.seek(size - 9 - count * width)
        table = source.read(count * width)
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.source.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        if len(data) != plain:
            raise ValueError("the seek table and the frame differ in length")
        return data


def with_revisits(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) as page_id, url, payload, digest, size, refers_to.

    Of equal payloads of LEAST_REVISIT bytes or more, all but those of the
    smallest page_id refer to it. A null html is an empty payload. Rows that
    share this page_id, or have none, are responses.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    full = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    full = full.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    firsts = full.where((F.col("size") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = firsts.where("first < last").select("digest", "first")
    out = full.join(firsts, "digest", "left")
    return out.select("page_id", "url", "payload", "digest", "size", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write one record per row to bundles under `path`, which all executors share; INDEX, kept there as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        writer, name = None, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, size, refers_to in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "size", "refers_to")), strict=True):
                    page_id = page_id.as_py()
                    data = record(page_id, url.as_py(), digest.as_py(), size.as_py(), refers_to.as_py(), payload.as_py())
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        writer = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None))
                    frame, at = writer.add(data)
                    rows.append((page_id, name, frame, at, len(data)))
                    if writer.size >= BUNDLE_BYTES:
                        writer.close()
                        writer = None
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "bundle", "frame", "frame_offset", "record_bytes"])
        except BaseException:
            # No index row names what is left of this bundle.
            if writer is not None:
                writer.sink.close()
            raise
        if writer is not None:
            writer.close()

    spark = pages.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    with_revisits(pages).mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """RECORDS of the archives under `path`: all, or those that `index` (rows of INDEX) names.

    Each frame is read once by one task; a response whose payload doesn't have
    the digest of its header is an error.
    """
    whole = index is None
    index = spark.read.schema(INDEX).parquet(f"{path}/index") if whole else index
    frames = index.groupBy("bundle", "frame").agg(*([] if whole else [F.collect_set("frame_offset").alias("offsets")]), F.sum("record_bytes").alias("plain"))
    frames = scratch.keep(frames, "frames")
    n, plain = frames.agg(F.count("*"), F.coalesce(F.sum("plain"), F.lit(0))).first()
    # The number of tasks follows the archives' bytes; the index itself is so small that Spark would read it in one.
    tasks = max(1, min(n, max(scratch.partitions(spark), -(-plain // READ_BYTES))))
    frames = frames.repartitionByRange(tasks, F.xxhash64("bundle", "frame")).sortWithinPartitions("bundle", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        name, reader = None, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["bundle"] != name:
                        if reader is not None:
                            reader.source.close()
                        name = row["bundle"]
                        reader = BundleReader(fs.open_input_file(f"{base}/{name}"))
                    yield _records(reader.frame(row["frame"]), None if whole else row["offsets"], f"{name}, frame {row['frame']}")
        finally:
            if reader is not None:
                reader.source.close()

    return frames.mapInArrow(run, RECORDS)


def _records(data: bytes, offsets: list[int] | None, place: str) -> pa.RecordBatch:
    """RECORDS of a frame: all, or those at `offsets`."""
    found = []
    for at in _offsets(data) if offsets is None else offsets:
        fields, content, _ = parse(data, at)
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and hashlib.sha256(content).hexdigest() != digest:
            raise ValueError(f"{place}, byte {at}: the payload is damaged")
        number = lambda key: int(fields[key]) if key in fields else None
        size = len(content) if kind == "response" else number("x-payload-length")
        found.append((number("x-page-id"), fields["warc-target-uri"], kind, number("x-refers-to-page-id"), size, digest, content if kind == "response" else None))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)


def _offsets(data: bytes) -> Iterator[int]:
    at = 0
    while at < len(data):
        yield at
        at = parse(data, at)[2]


def op9_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them.

    A null html is an empty payload, very long ones are frames of their own;
    rows that share a page_id, or have none, get a record each; no rows give no
    rows.
    """
    path = scratch.new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op9_seekable_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""
}
