"""Alignment readers: SAM text, and BAM by a block decoder of its own.

file_order is the record's place in its file; what counts a read name once
depends on it, so it is kept from the start. Convert to Parquet partitioned by
chrom for repeated use: ranges are then pruned by the files' statistics.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise import schemas

#: Base and CIGAR codes, fixed values of the format.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_SCALARS = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_ROWS = 4096


def inflate_blocks(source) -> Iterator[bytes]:
    """Plain bytes of the gzip members of a file object, one block at a time."""
    waiting = b""
    unpack = zlib.decompressobj(31)
    while True:
        data = waiting or source.read(1 << 20)
        if not data:
            return
        try:
            out = unpack.decompress(data)
        except zlib.error as e:
            raise ValueError("the file isn't block-gzipped") from e
        if out:
            yield out
        waiting = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            unpack = zlib.decompressobj(31)


class _Bytes:
    """Reads exact lengths from a stream of blocks."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.data, self.at = blocks, b"", 0

    def take(self, n: int) -> bytes:
        parts = []
        while n > 0:
            if self.at == len(self.data):
                self.data, self.at = next(self.blocks, b""), 0
                if not self.data:
                    break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        if n > 0 and parts:
            raise ValueError("the file ends within a record")
        return b"".join(parts)


def tags_of(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            code, count = _SCALARS[chr(raw[at])], struct.unpack_from("<I", raw, at + 1)[0]
            values = struct.unpack_from(f"<{count}{code}", raw, at + 5)
            out[name], at = ",".join(map(str, values)), at + 5 + struct.calcsize(f"<{count}{code}")
        else:
            code = _SCALARS[kind]
            value = struct.unpack_from(f"<{code}", raw, at)[0]
            out[name], at = value.decode() if kind == "A" else str(value), at + struct.calcsize(f"<{code}")
    return out


def decode_bam(source) -> Iterator[tuple]:
    """Rows of schemas.ALIGNMENTS of a BAM file object."""
    stream = _Bytes(inflate_blocks(source))
    if stream.take(4) != b"BAM\1":
        raise ValueError("no BAM file")
    stream.take(struct.unpack("<i", stream.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        names.append(stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode())
        stream.take(4)
    order = 0
    while head := stream.take(4):
        raw = stream.take(struct.unpack("<i", head)[0])
        tid, pos, name_len, mapq, _, ops, flag, length, mate, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", raw)
        at = 32 + name_len
        cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{ops}I", raw, at)) or "*"
        at += 4 * ops
        packed = raw[at : at + (length + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:length] or "*"
        at += (length + 1) // 2
        scores = raw[at : at + length]
        qual = "*" if not length or scores[0] == 255 else bytes(q + 33 for q in scores).decode()
        tags = tags_of(raw[at + length :])
        yield raw[32 : at][: name_len - 1].decode(), flag, names[tid] if tid >= 0 else "*", pos, mapq, cigar, names[mate] if mate >= 0 else "*", mate_pos, seq, qual, tags, tags.get("CB"), order
        order += 1


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Records of BAM files; each file streams through one task, many files in parallel."""
    schema = pa.schema([("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos0", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_chrom", pa.string()), ("mate_pos0", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("cb", pa.string()), ("file_order", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            cols[10] = [list(t.items()) for t in cols[10]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for uri in batch["path"].to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
                with fs.open_input_stream(at, compression=None) as source:
                    rows = []
                    for row in decode_bam(source):
                        rows.append(row)
                        if len(rows) == _ROWS:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, schemas.ALIGNMENTS)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text; file_order rises with the line in its file."""
    lines = spark.read.text(path).withColumn("file_order", F.monotonically_increasing_id())
    lines = lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
    c = F.col("c")
    rest = F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(0)))
    tag = F.transform(rest, lambda x: F.struct(F.substring(x, 1, 2), F.regexp_extract(x, r"^..:.:(.*)$", 1)))
    mate = F.when(F.get(c, F.lit(6)) == "=", F.get(c, F.lit(2))).otherwise(F.get(c, F.lit(6)))
    rows = lines.select(F.split("value", "\t").alias("c"), "file_order").withColumn("tags", F.map_from_entries(tag))
    return rows.select(
        F.get(c, F.lit(0)).alias("qname"), F.get(c, F.lit(1)).try_cast("int").alias("flag"), F.get(c, F.lit(2)).alias("chrom"), (F.get(c, F.lit(3)).try_cast("long") - 1).alias("pos0"), F.get(c, F.lit(4)).try_cast("int").alias("mapq"), F.get(c, F.lit(5)).alias("cigar"),
        mate.alias("mate_chrom"), (F.get(c, F.lit(7)).try_cast("long") - 1).alias("mate_pos0"), F.get(c, F.lit(9)).alias("seq"), F.get(c, F.lit(10)).alias("qual"), "tags", F.col("tags")["CB"].alias("cb"), "file_order",
    )


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .bam, .sam, or a Parquet table of schemas.ALIGNMENTS."""
    if path.endswith(".bam"):
        return read_bam(spark, path)
    return read_sam(spark, path) if path.endswith((".sam", ".sam.gz")) else spark.read.parquet(path)


def is_paired(alignments: DataFrame) -> bool:
    """Whether the first record is of a pair."""
    row = alignments.limit(1).select("flag").first()
    return bool(row and row[0] & 1)


def on_range(alignments: DataFrame, chrom: str, first: int, last: int) -> DataFrame:
    """Records of a chromosome that start in first..last (0-based), for files with statistics."""
    return alignments.where((F.col("chrom") == chrom) & F.col("pos0").between(first, last))
