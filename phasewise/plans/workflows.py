"""The user-facing queries, from files to result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions import columns as C
from phasewise.operators import cells as cell_ops
from phasewise.operators import counting, imbalance, pairs, rewrite
from phasewise.sinks import bundle
from phasewise.sources import alignments as A
from phasewise.sources import tables as T
from phasewise.sources import variants as V


def count_variants(
    spark: SparkSession, alignments: str, variants: str, samples: str | Sequence[str] | None = None, regions: str | None = None, region_names: bool = True,
    feature: str | None = None, attribute: str | None = None, parent: str | None = None, min_qual: int = 0, **filters,
) -> DataFrame:
    """chrom, pos0, pos, ref, alt, [GT], [region, gene_parent], ref_count, alt_count, other_count."""
    v = V.read_variants(spark, variants, samples, **filters)
    v = v.drop("id", "alts")
    if regions:
        v = counting.region_features(v, T.read_regions(spark, regions, region_names, feature, attribute, parent))
    keys = ["chrom", "pos0", "pos", "end", "ref", "alt"]
    counted = counting.count_bulk(A.read_alignments(spark, alignments), v.select(*keys).distinct(), min_qual)
    out = v.join(counted, keys)
    return out.select(*[c for c in v.columns if c != "end"], "ref_count", "alt_count", "other_count")


def count_cohort(spark: SparkSession, manifest: str, variants: str, out: str, regions: str | None = None, **options) -> dict:
    """A locked bundle of the counts of every donor of a manifest; see sinks.bundle."""
    donors = T.read_manifest(spark, manifest)
    parts = {d["donor_id"]: count_variants(spark, d["bam"], variants, [d["vcf_sample"]], regions, **options) for d in donors.collect()}
    return bundle.write_bundle(bundle.cohort_counts(parts, regions is not None), donors, out, {"variants": variants, "regions": regions})


def count_cells(spark: SparkSession, alignments: str, variants: str, barcodes: str, samples: str | Sequence[str] | None = None, regions: str | None = None, min_qual: int = 0, **filters) -> dict[str, DataFrame]:
    """coo, snps, cells and, with regions, features."""
    v = V.read_variants(spark, variants, samples, **filters).drop("alts", "id")
    snps = cell_ops.dense_index(v.dropDuplicates(["chrom", "pos0", "ref", "alt"]), ["chrom", "pos0", "ref", "alt"], "snp_idx")
    cells = T.read_barcodes(spark, barcodes)
    coo = counting.count_cells(A.read_alignments(spark, alignments), snps, cells, min_qual)
    out = {"coo": coo, "snps": snps, "cells": cells}
    if regions:
        hits = counting.region_features(snps, T.read_regions(spark, regions))
        out["features"] = hits.select("region", "snp_idx").distinct()
    return out


def find_imbalance(spark: SparkSession, counts: str, **options) -> DataFrame:
    """operators.imbalance.find_imbalance() of a counts table; groupby is another name of region."""
    if "groupby" in options:
        options["region"] = options.pop("groupby")
    return imbalance.find_imbalance(T.read_counts(spark, counts), **options)


def labelled_cells(cells: DataFrame, groups: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """`cells` (barcode, bc_idx) with the group of their barcode, only wanted ones if given; unknown names are an error."""
    out = cells.join(groups, "barcode", "left")
    if wanted:
        there = {r[0] for r in groups.where(F.col("group").isin(*wanted)).select("group").distinct().collect()}
        if missing := [w for w in wanted if w not in there]:
            raise ValueError(f"no cells in the groups {', '.join(missing)}")
        out = out.where(F.col("group").isin(*wanted))
    return out


def _cell_inputs(data: dict[str, DataFrame], groups: DataFrame, wanted, sample_gt: str | None, z_cutoff: float | None):
    coo, snps = data["coo"], data["snps"]
    features = data["features"] if "features" in data else cell_ops.variant_features(snps)
    if sample_gt:
        snps = cell_ops.het_only(snps, sample_gt)
        coo, features = coo.join(snps.select("snp_idx"), "snp_idx", "left_semi"), features.join(snps.select("snp_idx"), "snp_idx", "left_semi")
    if z_cutoff is not None:
        totals = snps.join(counting.sparse_totals(coo, "snp_idx"), "snp_idx", "left").fillna(0, ["ref_count", "alt_count"])
        kept, features = cell_ops.drop_outliers(totals, features, z_cutoff)
        snps = snps.join(kept.select("snp_idx"), "snp_idx", "left_semi")
        coo = coo.join(snps.select("snp_idx"), "snp_idx", "left_semi")
    return coo, snps, features, labelled_cells(data["cells"], groups, wanted)


def find_imbalance_cells(data: dict[str, DataFrame], groups: DataFrame, wanted: Sequence[str] | None = None, gt: str | None = None, phased: bool = False, z_cutoff: float | None = None, **options) -> DataFrame:
    """operators.cells.find_imbalance_groups() of count_cells()'s tables; gt: genotype column of snps to filter by."""
    coo, snps, features, cells = _cell_inputs(data, groups, wanted, gt, z_cutoff)
    return cell_ops.find_imbalance_groups(coo, snps, features, cells, gt=gt if phased else None, **options)


def compare_imbalance(data: dict[str, DataFrame], groups: DataFrame, wanted: Sequence[str] | None = None, gt: str | None = None, phased: bool = False, z_cutoff: float | None = None, **options) -> DataFrame:
    coo, snps, features, cells = _cell_inputs(data, groups, wanted, gt, z_cutoff)
    return cell_ops.compare_groups(coo, snps, features, cells, gt=gt if phased else None, **options)


def make_reads(spark: SparkSession, alignments: str, variants: str, sample: str, indels: bool = False, max_indel: int = 10, tag: str = C.TAG) -> dict[str, DataFrame]:
    """copies to align again, and the records to_remap (their originals) and keep."""
    reads = A.read_alignments(spark, alignments)
    if not A.is_paired(reads):
        raise ValueError("only paired reads can be swapped")
    records = V.read_records(spark, variants)
    if not V.mostly_phased(records, sample):
        raise ValueError("the genotypes must be phased")
    v = V.read_variants(spark, variants, [sample], include_indels=indels, max_indel_len=max_indel)
    copies = rewrite.make_copies(reads, v, indels=indels, max_indel=max_indel, tag=tag)
    changed = copies.where("name is not null").select("qname").distinct()
    lost = copies.where("outcome = 'unmappable'").select("qname").distinct()
    keep = reads.join(changed, "qname", "left_anti").join(lost, "qname", "left_anti")
    return {"copies": copies, "to_remap": reads.join(changed, "qname", "left_semi"), "keep": keep}


def filter_remapped(spark: SparkSession, to_remap: str, remapped: str, keep: str | None = None, slop: int = 0, positions: str | None = None, tag: str = C.TAG) -> DataFrame:
    read = lambda path: A.read_alignments(spark, path)
    side = T.read_positions(spark, positions) if positions else None
    return pairs.filter_remapped(read(to_remap), read(remapped), read(keep) if keep else None, slop, side, tag)
