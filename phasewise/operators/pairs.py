"""Read pairs, splits by name, and the filter on remapped copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phasewise.functions import columns as C
from phasewise.operators.interval_join import READ_BIN, interval_join, word_hits

PAIRED, PROPER, UNMAPPED, REVERSE, FIRST, SECONDARY, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x10, 0x40, 0x100, 0x800


def has_any(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(F.lit(mask)) != 0


def primary(reads: DataFrame, proper: bool = False) -> DataFrame:
    """Mapped primary records; with `proper` only those of proper pairs."""
    out = reads.where(~has_any(F.col("flag"), UNMAPPED | SECONDARY | SUPPLEMENTARY))
    return out.where(has_any(F.col("flag"), PROPER)) if proper else out


def mate_pairs(reads: DataFrame) -> DataFrame:
    """(chrom, qname, r1, r2): structs of the first two eligible records of each name on a chromosome; r1 is the first mate.

    Names with one such record only are orphans and left out; see orphans().
    """
    by = W.partitionBy("chrom", "qname").orderBy("file_order")
    rows = primary(reads, proper=True).withColumn("__n", F.row_number().over(by)).where("__n <= 2")
    whole = F.struct(*[c for c in reads.columns if c not in ("chrom", "qname")])
    first = has_any(F.col("flag"), FIRST)
    g = rows.groupBy("chrom", "qname").agg(
        F.count("*").alias("n"),
        F.min_by(whole, F.struct(~first, F.col("file_order"))).alias("r1"),
        F.max_by(whole, F.struct(~first, F.col("file_order"))).alias("r2"),
    )
    return g.where("n = 2").drop("n")


def orphans(reads: DataFrame) -> DataFrame:
    """(chrom, qname) of names with a single eligible record."""
    return primary(reads, proper=True).groupBy("chrom", "qname").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def overlapping_names(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """qname of reads whose aligned span, splices included, holds any part of a variant."""
    r = primary(reads).select("qname", "chrom", "pos0", (F.col("pos0") + C.reference_length(F.col("cigar"))).alias("__end"))
    v = variants.select(F.col("chrom").alias("__c"), F.col("pos0").alias("__s"), F.col("end").alias("__e"))
    return word_hits(r, v, ("chrom", "pos0", "__end"), ("__c", "__s", "__e")).select("qname").distinct()


def overlap_masks(reads: DataFrame, variants: DataFrame, indel: Column) -> DataFrame:
    """(qname, mask) of names that overlap a variant; `indel` is a condition on variants."""
    r = primary(reads).select("qname", "chrom", "pos0", (F.col("pos0") + C.reference_length(F.col("cigar"))).alias("__end"))
    hits = word_hits(r, variants, ("chrom", "pos0", "__end"), ("v_chrom", "v_pos0", "v_end"), snv=~indel, indel=indel)
    return hits.groupBy("qname").agg(C.overlap_mask(F.col("snv"), F.col("indel")).alias("mask"))


def split_by_overlap(reads: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to_remap, keep): all records of names that overlap a variant, and the others."""
    names = overlapping_names(reads, variants)
    return reads.join(names, "qname", "left_semi"), reads.join(names, "qname", "left_anti")


def read_variants(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """A row for each read and variant that overlap, once for each (read, variant, mate): the first in order of start and file."""
    mate = F.when(has_any(F.col("flag"), FIRST), 1).otherwise(2)
    r = primary(reads).select(
        F.col("chrom"), F.col("pos0").alias("start"), (F.col("pos0") + C.reference_length(F.col("cigar"))).alias("stop"), F.col("qname").alias("read"),
        mate.alias("mate"), "mapq", F.when(has_any(F.col("flag"), REVERSE), "-").otherwise("+").alias("strand"), "file_order",
    )
    # By start, an earlier record has a variant of a later one too, unless the variant begins behind it. So equal
    # overlaps are told before the join, by reads, and never shuffled.
    earlier = W.partitionBy("read", "mate", "chrom").orderBy("start", "file_order", "stop", "mapq", "strand").rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumn("__from", F.max("stop").over(earlier)).drop("file_order")
    v = variants.select(*[F.col(c).alias(f"v_{c}" if c in ("chrom", "pos0", "end") else c) for c in variants.columns])
    key = ["v_chrom", "v_pos0", "v_end", "ref", "alt"]
    more = [c for c in v.columns if c not in key]
    # Of equal variants one stays.
    rest = F.min(F.struct(*more)) if more else F.lit(None)
    v = v.groupBy(*key).agg(rest.alias("__rest")).select(*[F.col(c) if c in key else F.col("__rest")[c].alias(c) for c in v.columns])
    out = interval_join(r, v, ("chrom", "start", "stop"), ("v_chrom", "v_pos0", "v_end"), READ_BIN)
    return out.where(F.col("__from").isNull() | (F.col("v_pos0") >= F.col("__from"))).drop("__from")


def classified_copies(remapped: DataFrame, slop: int = 0, sidecar: DataFrame | None = None, tag: str = C.TAG) -> DataFrame:
    """(orig, name, total, match): each remapped copy whose pair is complete.

    A copy matches if both mates lie where they are expected, in either order:
    at the positions of the sidecar (qname, pos1, pos2) if it lists the copy, else
    at those its name carries, within the tolerance.
    """
    base = F.regexp_replace("qname", "/[12]$", "")
    rows = primary(remapped, proper=True).withColumn("name", base)
    pairs = rows.groupBy("name").agg(F.count("*").alias("n"), F.max_by(F.struct("pos0", "mate_pos0"), "file_order").alias("at")).where("n >= 2")
    d = pairs.withColumn("d", C.decode_name(F.col("name"), tag)).where("d is not null").select("name", "at.*", "d.*")
    tolerance = C.slop_of(slop, F.col("delta1"), F.col("delta2"))
    if sidecar is not None:
        side = sidecar.select(F.regexp_replace("qname", "/[12]$", "").alias("name"), F.col("pos1").alias("s1"), F.col("pos2").alias("s2")).dropDuplicates(["name"])
        d = d.join(side, "name", "left")
        tolerance = F.when(F.col("s1").isNotNull(), F.lit(slop).cast("long")).otherwise(tolerance)
        d = d.withColumns({"pos1": F.coalesce("s1", "pos1"), "pos2": F.coalesce("s2", "pos2")})
    return d.select("orig", "name", "total", C.positions_match(F.col("pos0"), F.col("mate_pos0"), F.col("pos1"), F.col("pos2"), tolerance).alias("match"))


def remap_verdicts(remapped: DataFrame, slop: int = 0, sidecar: DataFrame | None = None, tag: str = C.TAG) -> DataFrame:
    """(orig, verdict): kept, moved (a copy lies elsewhere) or missing (not all copies came back)."""
    copies = classified_copies(remapped, slop, sidecar, tag)
    g = copies.groupBy("orig").agg(F.count("*").alias("n"), F.min(F.col("match").cast("int")).alias("all"), F.max("total").alias("total"))
    verdict = F.when(F.col("all") == 0, "moved").when(F.col("n") < F.col("total"), "missing").otherwise("kept")
    return g.select("orig", verdict.alias("verdict"))


def filter_remapped(to_remap: DataFrame, remapped: DataFrame, keep: DataFrame | None = None, slop: int = 0, sidecar: DataFrame | None = None, tag: str = C.TAG) -> DataFrame:
    """Records of to_remap all whose copies came back to their place, and those of keep."""
    good = remap_verdicts(remapped, slop, sidecar, tag).where("verdict = 'kept'").select(F.col("orig").alias("qname"))
    out = to_remap.join(good, "qname", "left_semi").select(*to_remap.columns)
    return out if keep is None else out.unionByName(keep)


def filter_stats(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("kept", "moved", "missing")])
