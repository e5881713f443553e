"""Variant readers: VCF text, plain or (block-)gzipped, and PLINK 2 triplets.

A reader gives one row for each record: chrom, pos0, pos, end, id, ref, alts and
GT, a map from sample to genotype. records_to_variants() makes one row for each
ALT and filters; every format goes through it, so all filters hold for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions import columns as C

_readers: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_PACKED = (".gz", ".bgz", ".zst")


def register(*extensions: str):
    """Decorator: the reader of files with these extensions."""

    def add(reader):
        _readers.update(dict.fromkeys(extensions, reader))
        return reader

    return add


def supported() -> list[str]:
    return sorted(_readers)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def format_of(path: str) -> str:
    name = path.lower()
    for end in _PACKED:
        name = name.removesuffix(end)
    extension = name.rsplit("/", 1)[-1].rpartition(".")[2]
    if extension not in _readers:
        raise ValueError(f"unsupported variant format {extension!r}; supported: {', '.join(supported())}")
    return extension


def read_records(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Records of a variant file, by its extension or the format given."""
    reader = _readers[format] if format else _readers[format_of(path)]
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return reader(spark, path)


def header_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of a VCF, from its column line."""
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    if not line:
        raise ValueError(f"{path} has no #CHROM line")
    return line[0][0].rstrip("\r\n").split("\t")[9:]


@register("vcf")
def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """VCF 4 text; samples are those of the #CHROM line."""
    names = header_samples(spark, path)
    if len(set(names)) != len(names):
        raise ValueError(f"{path} has a sample twice")
    data = ~F.col("value").startswith("#") & (F.trim("value") != "")
    # Header lines are null for every expression, wherever the optimiser puts the filter.
    cols = F.split(F.when(data, F.regexp_replace("value", "\r$", "")), "\t")
    rows = spark.read.text(path).where(data).select(cols.alias("c"), F.split(F.get(cols, F.lit(8)), ":").alias("f"))
    slot = F.array_position("f", F.lit("GT"))
    gt = F.transform(F.slice("c", 10, len(names)) if names else F.array().cast("array<string>"), lambda x: F.when(slot > 0, F.try_element_at(F.split(x, ":"), slot.cast("int"))))
    keys = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    pos = F.get("c", F.lit(1)).try_cast("long")
    return rows.select(
        F.get("c", F.lit(0)).alias("chrom"), (pos - 1).alias("pos0"), pos.alias("pos"), (pos - 1 + F.length(F.get("c", F.lit(3)))).alias("end"), F.get("c", F.lit(2)).alias("id"),
        F.get("c", F.lit(3)).alias("ref"), F.split(F.get("c", F.lit(4)), ",").alias("alts"), F.map_from_arrays(keys, gt).alias("GT"),
    )


def read_pvar(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, chrom, pos0, pos, end, id, ref, alts) of a .pvar; chromosome names get the prefix chr."""
    names = next((r[0].lstrip("#").split("\t") for r in spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()), ["CHROM", "ID", "CM", "POS", "ALT", "REF"])
    at = {n: i for i, n in enumerate(names)}
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    rows = rows.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])).toDF("ordinal long, value string")
    pos = F.get(c, F.lit(at["POS"])).try_cast("long")
    return rows.select("ordinal", C.with_chr(F.get(c, F.lit(at["CHROM"]))).alias("chrom"), (pos - 1).alias("pos0"), pos.alias("pos"), (pos - 1 + F.length(F.get(c, F.lit(at["REF"])))).alias("end"), F.get(c, F.lit(at["ID"])).alias("id"), F.get(c, F.lit(at["REF"])).alias("ref"), F.split(F.get(c, F.lit(at["ALT"])), ",").alias("alts"))


def read_psam(spark: SparkSession, path: str) -> list[str]:
    """Sample ids in file order; bounded by the number of samples of a study."""
    rows = [r[0] for r in spark.read.text(path).collect() if r[0].strip()]
    head = rows[0].lstrip("#").split("\t") if rows[0].startswith("#") else ["FID", "IID"]
    body = rows[1:] if rows[0].startswith("#") else rows
    return [r.split("\t")[head.index("IID")] for r in body]


def decode_hardcalls(data: bytes, samples: int, variants: int) -> Iterator[list[str]]:
    """Genotypes of a .pgen of fixed-width hardcalls (storage mode 2), two bits a sample."""
    if data[:2] != b"\x6c\x1b":
        raise ValueError("no PLINK 2 genotype file")
    if data[2] != 2:
        raise ValueError("only fixed-width hardcalls (storage mode 2) are read; rewrite the file with fixed-width records")
    names = np.array(["0/0", "0/1", "1/1", "./."])
    width = -(-samples // 4)
    for v in range(variants):
        row = np.frombuffer(data, np.uint8, width, 12 + v * width)
        codes = (row[:, None] >> np.array([0, 2, 4, 6])) & 3
        yield names[codes.reshape(-1)[:samples]].tolist()


@register("pgen")
def read_pgen(spark: SparkSession, path: str) -> DataFrame:
    """A .pgen with its .pvar and .psam; genotypes are unphased."""
    stem = path.removesuffix(".pgen")
    samples = read_psam(spark, f"{stem}.psam")
    variants = read_pvar(spark, f"{stem}.pvar")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"].to_pylist():
                count = int.from_bytes(content[3:7], "little")
                if int.from_bytes(content[7:11], "little") != len(samples):
                    raise ValueError("the .psam and the .pgen differ in their number of samples")
                for at, gts in enumerate(decode_hardcalls(content, len(samples), count)):
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([gts], pa.list_(pa.string()))], ["ordinal", "g"])

    calls = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "ordinal long, g array<string>")
    keys = F.array(*map(F.lit, samples))
    return variants.join(calls, "ordinal").select("chrom", "pos0", "pos", "end", "id", "ref", "alts", F.map_from_arrays(keys, "g").alias("GT"))


def sample_list(samples: str | Sequence[str] | None, spark: SparkSession | None = None) -> list[str] | None:
    """A list, a comma list, or a file with one sample on each line."""
    if samples is None:
        return None
    if not isinstance(samples, str):
        return list(samples)
    if spark is not None and "," not in samples and "/" in samples and exists(spark, samples):
        return [r[0].strip() for r in spark.read.text(samples).collect() if r[0].strip()]
    return [s.strip() for s in samples.split(",") if s.strip()]


def records_to_variants(
    records: DataFrame,
    samples: Sequence[str] | None = None,
    known: Sequence[str] | None = None,
    het_only: bool = True,
    biallelic_only: bool = True,
    include_indels: bool = False,
    max_indel_len: int = 10,
    include_gt: bool = True,
) -> DataFrame:
    """One row for each ALT that passes: chrom, pos0, pos, end, id, ref, alt, alts, and a genotype column for each sample.

    Without samples all variants of the allowed types are kept. With several,
    a variant stays if it is heterozygous in any of them; without genotypes in
    the output only the first sample decides.
    """
    if samples and known is not None and (bad := [s for s in samples if s not in known]):
        raise ValueError(f"unknown samples: {', '.join(bad)}")
    rows = records.where(F.size("alts") == 1) if biallelic_only else records
    rows = rows.select("*", F.posexplode("alts").alias("alt_at", "alt")).where(C.type_allowed(F.col("ref"), F.col("alt"), include_indels, max_indel_len))
    out = ["chrom", "pos0", "pos", "end", "id", "ref", "alt", "alts"]
    if not samples:
        return rows.select(*out)
    used = list(samples) if include_gt else list(samples)[:1]
    gts = {s: F.col("GT")[s] for s in used}
    if het_only:
        hits = [C.is_het(g, F.col("alt_at") + 1) for g in gts.values()]
        any_hit = hits[0]
        for h in hits[1:]:
            any_hit = any_hit | h
        rows = rows.where(any_hit)
    if len(used) == 1:
        rows = rows.where(~F.coalesce(F.contains(gts[used[0]], F.lit(".")), F.lit(True)))
    names = {s: "GT" if len(used) == 1 else f"GT_{s}" for s in used}
    picked = [g.alias(names[s]) for s, g in gts.items()] if include_gt else []
    return rows.select(*out, *picked)


def read_variants(spark: SparkSession, path: str, samples: str | Sequence[str] | None = None, format: str | None = None, **filters) -> DataFrame:
    """Filtered variants of a file; filters are those of records_to_variants()."""
    records = read_records(spark, path, format)
    names = sample_list(samples, spark)
    kind = format or format_of(path)
    known = (header_samples(spark, path) if kind == "vcf" else read_psam(spark, path.removesuffix(".pgen") + ".psam")) if names else None
    return records_to_variants(records, names, known, **filters)


def allele_count_filter(records: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Records with both an ALT and a non-ALT allele among the samples: allele count from 1 to one below their number."""
    every = F.flatten(F.array(*[F.coalesce(F.transform(F.split(F.col("GT")[s], r"[|/]"), lambda x: F.try_to_number(F.when(x != ".", x), F.lit("999")).cast("int")), F.array().cast("array<int>")) for s in samples]))
    count = F.size(F.filter(every, lambda x: x > 0))
    return records.where((count >= 1) & (count <= 2 * len(samples) - 1))


def query_region(variants: DataFrame, chrom: str, first: int, last: int) -> DataFrame:
    """Variants of a 1-based closed range."""
    return variants.where((F.col("chrom") == chrom) & F.col("pos").between(first, last))


def genotype_at(records: DataFrame, chrom: str, pos: int, sample: str) -> DataFrame:
    """Genotype string, code, alleles and phasing of one sample at a place."""
    gt = F.col("GT")[sample]
    return records.where((F.col("chrom") == chrom) & (F.col("pos") == pos)).select(
        gt.alias("gt"), C.genotype_code(gt).alias("code"), C.alleles(gt, F.col("ref"), F.col("alts")).alias("alleles"), C.is_phased(gt).alias("phased")
    )


def mostly_phased(records: DataFrame, sample: str, first: int = 100) -> bool:
    """Whether over half of the first records' genotypes are phased, a sniff of the file's head."""
    share = records.limit(first).agg(F.avg(C.is_phased(F.col("GT")[sample]).cast("int"))).first()[0]
    return bool(share and share > 0.5)


def variants_to_bed(variants: DataFrame) -> DataFrame:
    """chrom, pos0, end, ref, alt and the genotype columns."""
    return variants.select("chrom", "pos0", "end", "ref", "alt", *[c for c in variants.columns if c == "GT" or c.startswith("GT_")])
