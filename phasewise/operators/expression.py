"""Gene-level aggregates, mono-allelic expression, fragments, haplotype layers, export tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phasewise.functions import columns as C
from phasewise.functions.betabinom import binomial_two_sided
from phasewise.operators.fdr import bh_adjust
from phasewise.operators.interval_join import interval_join


def gene_counts(counts: DataFrame, how: str = "sum") -> DataFrame:
    """gene_id, ref_count, alt_count, total_count, alt_ratio (0 without reads); how: sum, mean or max."""
    f = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    g = counts.groupBy("gene_id").agg(f("ref_count").alias("ref_count"), f("alt_count").alias("alt_count"))
    g = g.withColumn("total_count", F.col("ref_count") + F.col("alt_count"))
    return g.withColumn("alt_ratio", C.safe_ratio(F.col("alt_count"), F.col("total_count"), 0.0))


def gene_matrix(genes: DataFrame, value: str = "total_count", samples: list[str] | None = None) -> DataFrame:
    """One row for each gene, one column for each sample, 0 where there is none. Naming the samples saves a pass."""
    p = genes.groupBy(F.col("gene_id").alias("geneID")).pivot("sample_id", samples) if samples else genes.groupBy(F.col("gene_id").alias("geneID")).pivot("sample_id")
    out = p.agg(F.sum(value).cast("long"))
    return out.fillna(0)


def mono_allelic(counts: DataFrame, min_count: int = 10, ratio: float = 0.8, alpha: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """`counts` with total_count, alt_ratio, pvalue, mae_status, padj and significant; rows under min_count or without reads go."""
    rows = counts.withColumn("total_count", F.col("ref_count") + F.col("alt_count")).where((F.col("total_count") > 0) & (F.col("total_count") >= min_count))
    rows = rows.withColumn("alt_ratio", F.col("alt_count") / F.col("total_count"))
    status = F.when(F.col("alt_ratio") >= ratio, "MAE_ALT").when(F.col("ref_count") / F.col("total_count") >= ratio, "MAE_REF").otherwise("BIALLELIC")
    # Each distinct pair of counts is tested once.
    pairs = rows.select(F.col("ref_count").cast("long").alias("__r"), F.col("alt_count").cast("long").alias("__a")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(pvalue=binomial_two_sided(b["__a"].to_numpy(), (b["__r"] + b["__a"]).to_numpy()))

    tested = pairs.mapInPandas(run, "__r long, __a long, pvalue double")
    rows = rows.join(tested, (F.col("ref_count").cast("long") == tested["__r"]) & (F.col("alt_count").cast("long") == tested["__a"])).drop("__r", "__a")
    rows = bh_adjust(rows.withColumn("mae_status", status), "pvalue", "padj", by)
    return rows.withColumn("significant", (F.col("padj") < alpha) & (F.col("mae_status") != "BIALLELIC"))


def expressed_genes(genes: DataFrame, least: int = 10, share: float = 0.5, least_samples: int = 2) -> DataFrame:
    """gene_id of genes with `least` reads in a share of the samples, and in two at least."""
    n = genes.select("sample_id").distinct().count()
    need = max(least_samples, int(-(-n * share // 1)))
    return genes.groupBy("gene_id").agg(F.count_if(F.col("total_count") >= least).alias("n")).where(F.col("n") >= need).select("gene_id")


def aberrant(fit: DataFrame, alpha: float = 0.05, z: float = 0.0) -> DataFrame:
    """Rows of an expression-outlier fit (padj, zscore), made elsewhere, marked aberrant."""
    return fit.withColumn("aberrant", (F.col("padj") <= alpha) & (F.abs(F.col("zscore")) >= z))


def fragment_counts(fragments: DataFrame, snps: DataFrame, min_fragments: int = 1) -> DataFrame:
    """(barcode, chrom, pos, ref, alt, overlap_count) of cells with min_fragments overlaps in all."""
    s = snps.select(F.col("chrom").alias("__c"), F.col("pos0").alias("__s"), (F.col("pos0") + 1).alias("__e"), "pos", "ref", "alt")
    hits = interval_join(fragments, s, ("chrom", "start", "end"), ("__c", "__s", "__e"))
    cells = hits.groupBy("barcode", "chrom", "pos", "ref", "alt").agg(F.count("*").alias("overlap_count"))
    totals = cells.groupBy("barcode").agg(F.sum("overlap_count").alias("t")).where(F.col("t") >= min_fragments).select("barcode")
    return cells.join(totals, "barcode", "left_semi")


def fragment_pseudobulk(cells: DataFrame, min_cells: int = 1) -> DataFrame:
    """chrom, pos, ref, alt, ref_count, alt_count, n_cells. Overlaps have no allele, so alt_count is 0: not for allelic tests."""
    g = cells.groupBy("chrom", "pos", "ref", "alt").agg(F.sum("overlap_count").alias("ref_count"), F.count("*").alias("n_cells"))
    return g.where(F.col("n_cells") >= min_cells).select("chrom", "pos", "ref", "alt", "ref_count", F.lit(0).cast("long").alias("alt_count"), "n_cells")


def _pieces(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Nonempty intervals cut at the borders of bins: __bin, __low, __high."""
    each = df.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return each.withColumns({"__low": F.greatest(F.col(start), F.col("__bin") * width), "__high": F.least(F.col(end), (F.col("__bin") + 1) * width)})


def _swept(rows: DataFrame, *sums: str) -> DataFrame:
    """`rows` (chrom, __bin, __x, __turn, ...) with running sums of columns along each bin, by place and turn."""
    along = W.partitionBy("chrom", "__bin").orderBy("__x", "__turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumns({c: F.sum(c).over(along) for c in sums})


def fragment_coverage(fragments: DataFrame, snps: DataFrame, min_fragments: int = 1, min_cells: int = 1, width: int = 1 << 10) -> DataFrame:
    """fragment_pseudobulk() of fragment_counts(), without a row for each fragment or cell and variant.

    Only borders of fragments are shuffled: how many variants lie before a border
    tells a cell's overlaps, how many began and ended before a variant tells its
    own, and of each cell the union of its fragments does so for cells.
    """
    long = lambda n: F.lit(n).cast("long")
    points = snps.groupBy("chrom", "pos0", "pos", "ref", "alt").agg(F.count("*").alias("times"))
    points = points.withColumns({"__bin": F.floor(F.col("pos0") / width), "__x": F.col("pos0").cast("long")})
    f = fragments.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "barcode").where("barcode is not null")
    # Variants before each border; borders come before variants at their place.
    side = F.explode(F.array(F.struct(F.col("__low").alias("x"), long(-1).alias("sign")), F.struct(F.col("__high").alias("x"), long(1).alias("sign"))))
    borders = _pieces(f, "start", "end", width).select("chrom", "__bin", "barcode", side.alias("b")).select("chrom", "__bin", F.col("b.x").alias("__x"), F.lit(0).alias("__turn"), "barcode", F.col("b.sign").alias("sign"), long(0).alias("before"))
    # What lies at one place goes as one row.
    places = points.groupBy("chrom", "__bin", "__x").agg(F.sum("times").alias("before")).select("chrom", "__bin", "__x", F.lit(1).alias("__turn"), "before")
    ranked = _swept(borders.unionByName(places, allowMissingColumns=True), "before").where("sign is not null")
    totals = ranked.groupBy("barcode").agg(F.sum(F.col("sign") * F.col("before")).alias("t")).where(F.col("t") >= min_fragments)
    f = f.join(totals.select("barcode"), "barcode", "left_semi")
    # The part of a fragment that no earlier one of its cell covers.
    earlier = W.partitionBy("barcode", "chrom").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    f = f.withColumn("own", F.greatest("start", F.max("end").over(earlier)))
    both = F.explode(F.array(*[F.struct(F.col(c).alias("s"), long(n).alias("n"), long(1 - n).alias("own")) for c, n in (("start", 1), ("own", 0))]))
    spans = f.select("chrom", "end", both.alias("b")).select("chrom", F.col("b.s").alias("s"), "end", F.col("b.n").alias("n"), F.col("b.own").alias("cells"))
    steps = _pieces(spans, "s", "end", width).select("chrom", "__bin", "n", "cells", side.alias("b"))
    # side's signs are those of the ranks: a fragment begins with -1.
    steps = steps.groupBy("chrom", "__bin", F.col("b.x").alias("__x")).agg(*[F.sum(-F.col("b.sign") * F.col(c)).alias(c) for c in ("n", "cells")]).withColumn("__turn", F.lit(0))
    at = points.withColumns({"__turn": F.lit(1), "n": long(0), "cells": long(0)})
    over = _swept(at.unionByName(steps, allowMissingColumns=True), "n", "cells").where(F.col("times").isNotNull() & (F.col("cells") >= max(1, min_cells)))
    return over.select("chrom", "pos", "ref", "alt", (F.col("n") * F.col("times")).alias("ref_count"), long(0).alias("alt_count"), F.col("cells").alias("n_cells"))


def snps_in_peaks(snps: DataFrame, peaks: DataFrame) -> DataFrame:
    p = peaks.select(F.col("chrom").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    out = interval_join(snps.withColumn("__end", F.col("pos0") + 1), p, ("chrom", "pos0", "__end"), ("__c", "__s", "__e"), how="left_semi")
    return out.select(*snps.columns)


def haplotype_layers(counts: DataFrame, phases: DataFrame) -> DataFrame:
    """`counts` with hap1 and hap2; phases: snp_id, gt. Without a phase, or 0|1, the reference is haplotype 1."""
    key = C.snp_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))
    p = phases.select("snp_id", (F.col("gt") == "1|0").alias("__flip"))
    j = counts.withColumn("snp_id", key).join(p, "snp_id", "left")
    flip = F.coalesce("__flip", F.lit(False))
    pick = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    return j.withColumns({"hap1": pick("ref_count", "alt_count"), "hap2": pick("alt_count", "ref_count")}).drop("__flip")


def export_table(counts: DataFrame) -> DataFrame:
    """`counts` with total, ref_ratio (null without reads), hap1_count and hap2_count by genotype (0|1: reference first)."""
    total = F.col("ref_count") + F.col("alt_count")
    flip = F.col("GT") == "1|0" if "GT" in counts.columns else F.lit(False)
    flip = F.coalesce(flip, F.lit(False))
    hap: dict[str, Column] = {
        "total_count": total,
        "ref_ratio": F.try_divide(F.col("ref_count"), total),
        "hap1_count": F.when(flip, F.col("alt_count")).otherwise(F.col("ref_count")),
        "hap2_count": F.when(flip, F.col("ref_count")).otherwise(F.col("alt_count")),
    }
    return counts.withColumns(hap)


def cell_qc(coo: DataFrame) -> DataFrame:
    """bc_idx, n_snps, total, ref and alt sums of each cell."""
    return coo.groupBy("bc_idx").agg(F.count("*").alias("n_snps"), F.sum(F.col("ref") + F.col("alt") + F.col("other")).alias("total"), F.sum("ref").alias("ref_total"), F.sum("alt").alias("alt_total"))


def pivot_groups(coo: DataFrame, cells: DataFrame, groups: list[str]) -> DataFrame:
    """snp_idx with ref, alt and other sums of each of `groups` as columns."""
    j = coo.join(cells, "bc_idx")
    return j.groupBy("snp_idx").pivot("group", groups).agg(*[F.sum(c).alias(c) for c in ("ref", "alt", "other")]).fillna(0)
