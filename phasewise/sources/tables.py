"""Readers of tab- and comma-separated genomic tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise import schemas
from phasewise.functions import columns as C

_BED = re.compile(r"\.(bed|narrowPeak|broadPeak)(\.gz)?$", re.IGNORECASE)
_GENES = re.compile(r"\.(gtf|gff3?)(\.gz)?$", re.IGNORECASE)
_DONOR_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def is_gene_file(path: str) -> bool:
    """GTF or GFF3 by extension; BED and peak files aren't, others are an error."""
    if _GENES.search(path):
        return True
    if _BED.search(path):
        return False
    raise ValueError(f"{path}: regions must be a BED, narrowPeak, broadPeak, GTF or GFF3 file")


def read_bed(spark: SparkSession, path: str, names: bool = True) -> DataFrame:
    """chrom, start, end and region: the fourth column, or chrom_start_end without one."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|\\s*$)")).select(c.alias("c"))
    chrom, start, end = F.get("c", F.lit(0)), F.get("c", F.lit(1)).try_cast("long"), F.get("c", F.lit(2)).try_cast("long")
    label = C.interval_label(chrom, start, end)
    name = F.coalesce(F.get("c", F.lit(3)), label) if names else label
    return rows.select(chrom.alias("chrom"), start.alias("start"), end.alias("end"), name.alias("region"))


@dataclass(frozen=True)
class Genes:
    table: DataFrame  # seqname, start (0-based), end, <attribute>, <parent>
    feature: str
    attribute: str
    parent: str


def read_genes(spark: SparkSession, path: str, feature: str | None = None, attribute: str | None = None, parent: str | None = None) -> Genes:
    """Rows of one feature of a GTF or GFF3 file; what isn't named is found from the file's contents in one pass each."""
    names = "seqname source feature start end score strand frame attribute".split()
    df = spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"{n} {'long' if n in ('start', 'end') else 'string'}" for n in names), quote="")
    if feature is None:
        there = df.agg(*[F.max((F.col("feature") == f).cast("int")).alias(f) for f in ("gene", "transcript", "exon")]).first()
        feature = next((f for f in ("gene", "transcript", "exon") if there[f]), None)
        if feature is None:
            raise ValueError(f"{path} has no gene, transcript or exon")
    df = df.where(F.col("feature") == feature)
    wanted = [f"{feature}_id", "ID", "Name", "Parent", "transcript_id", "gene_id"]
    if attribute is None or parent is None:
        seen = df.agg(*[F.max(F.contains("attribute", F.lit(w)).cast("int")).alias(str(i)) for i, w in enumerate(wanted)]).first()
        there = {w for i, w in enumerate(wanted) if seen[str(i)]}
        attribute = attribute or next((w for w in wanted[:3] if w in there), None)
        if attribute is None:
            raise ValueError(f"{path} has no ID, Name or {feature}_id")
        parent = parent or next((w for w in wanted[3:] if w in there), attribute)
    column = f"groupby_{attribute}" if parent == attribute else parent
    table = df.select("seqname", (F.col("start") - 1).alias("start"), "end", C.attribute(F.col("attribute"), attribute).alias(attribute), C.attribute(F.col("attribute"), parent).alias(column))
    return Genes(table, feature, attribute, column)


def genes_as_regions(genes: Genes) -> DataFrame:
    """chrom, start, end, region and gene_parent."""
    t = genes.table
    return t.select(F.col("seqname").alias("chrom"), "start", "end", F.col(genes.attribute).alias("region"), F.col(genes.parent).alias("gene_parent"))


def read_regions(spark: SparkSession, path: str, names: bool = True, feature: str | None = None, attribute: str | None = None, parent: str | None = None) -> DataFrame:
    if is_gene_file(path):
        return genes_as_regions(read_genes(spark, path, feature, attribute, parent))
    return read_bed(spark, path, names)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """A counts table by its header: chrom, pos, ref_count and alt_count are needed; empty cells of these are an error when read."""
    df = spark.read.csv(path, sep="\t", header=True, mode="FAILFAST", ignoreLeadingWhiteSpace=False)
    need = ("chrom", "pos", "ref_count", "alt_count")
    if missing := [c for c in need if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    whole = [c for c in ("pos0", "pos", "ref_count", "alt_count", "other_count") if c in df.columns]
    filled = {c: F.coalesce(F.col(c).cast("long"), F.raise_error(F.lit(f"a row has no {c}")).cast("long")) for c in whole}
    return df.withColumns(filled)


def _ordinal(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Rows numbered in file order."""
    return df.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF(f"{kind} string, {name} long")


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """barcode, bc_idx in line order."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("barcode"))
    return _ordinal(rows, "bc_idx", "barcode")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """barcode, group of a file without header; more columns are ignored."""
    c = F.split("value", "\t")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(c, F.lit(0)).alias("barcode"), F.get(c, F.lit(1)).alias("group"))


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=schemas.FRAGMENTS)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Expected positions of swapped reads: qname, mate, pos1, pos2; lines of fewer than five columns are left out."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(c) >= 5)
    return rows.select(F.get(c, F.lit(0)).alias("qname"), F.get(c, F.lit(1)).try_cast("int").alias("mate"), F.get(c, F.lit(2)).try_cast("long").alias("pos1"), F.get(c, F.lit(3)).try_cast("long").alias("pos2")).where("pos1 is not null")


def read_intersections(spark: SparkSession, path: str, samples: tuple[str, ...] = ()) -> DataFrame:
    """Overlaps of reads and variants that another tool wrote, a row for each."""
    names = "chrom string, start long, stop long, read string, mapq int, strand string, v_chrom string, v_pos0 long, v_end long, ref string, alt string"
    gts = "".join(f", GT_{s} string" for s in samples) if len(samples) > 1 else ", GT string"
    df = spark.read.csv(path, sep="\t", schema=names + gts)
    mate = F.regexp_extract("read", "/([12])$", 1).try_cast("int")
    out = df.withColumns({"mate": mate, "read": F.regexp_replace("read", "/[12]$", "")})
    return out.dropDuplicates(["read", "mate", "chrom", "v_pos0", "v_end", "ref", "alt"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Donors of a cohort: exactly donor_id, vcf_sample and bam, each unique, sorted by donor."""
    df = spark.read.csv(path, sep="\t", header=True)
    if df.columns != ["donor_id", "vcf_sample", "bam"]:
        raise ValueError("a manifest has the columns donor_id, vcf_sample and bam")
    checks = [F.count_if(~F.coalesce(F.col("donor_id").rlike(_DONOR_ID), F.lit(False))).alias("bad"), F.count("*").alias("n")]
    r = df.agg(*checks, *[F.count_distinct(c).alias(c) for c in df.columns]).first()
    if not r["n"] or r["bad"] or any(r[c] != r["n"] for c in df.columns):
        raise ValueError("donor ids must be plain names; donors, samples and files must be given and occur once")
    return df.orderBy("donor_id")


def check_sample_sheet(df: DataFrame, needed: tuple[str, ...], unique: tuple[str, ...] = ("sample",)) -> DataFrame:
    """The sheet itself if it has the needed columns, no empty cells there and no `unique` key twice."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"the sample sheet lacks {', '.join(missing)}")
    empty = [F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(c) for c in needed]
    r = df.agg(*empty, F.count("*").alias("__n"), F.count_distinct(*unique).alias("__u")).first()
    if bad := [c for c in needed if r[c]]:
        raise ValueError(f"empty cells in {', '.join(bad)}")
    if r["__n"] != r["__u"]:
        raise ValueError(f"{', '.join(unique)} must be unique")
    return df


def read_sample_sheet(spark: SparkSession, path: str, needed: tuple[str, ...], unique: tuple[str, ...] = ("sample",)) -> DataFrame:
    return check_sample_sheet(spark.read.csv(path, header=True), needed, unique)


def read_gene_matrix(spark: SparkSession, path: str) -> DataFrame:
    """geneID, sample_id, total_count of a gene by sample table."""
    df = spark.read.csv(path, sep="\t", header=True)
    names = [c for c in df.columns if c != df.columns[0]]
    return df.withColumnRenamed(df.columns[0], "gene_id").unpivot("gene_id", names, "sample_id", "total_count").withColumn("total_count", F.col("total_count").cast("long"))
