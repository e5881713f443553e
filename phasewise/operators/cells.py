"""Imbalance within and between groups of cells, from sparse counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.functions import columns as C

from phasewise.functions import betabinom as bb
from phasewise.functions.groups import whole_groups
from phasewise.operators.fdr import bh_adjust
from phasewise.operators.imbalance import alternative, fit_dispersion, fit_regions, terms


def variant_features(snps: DataFrame) -> DataFrame:
    """(region, snp_idx): each place of `snps` as a region of its own, for counts without regions."""
    return snps.select(C.variant_label(F.col("chrom"), F.col("pos0") + 1).alias("region"), "snp_idx")


def het_only(snps: DataFrame, gt: str) -> DataFrame:
    return snps.where(F.col(gt).isin("0|1", "1|0", "0/1", "1/0"))


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 by `order`, in parallel: ranges are sorted apart and shifted by what lies before.

    This is one of few uses of an RDD: the shift must come from the very same
    partitions that are numbered, which two queries on a sampled range
    partitioning don't promise.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return parts.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(_with_long(df, name))


def _with_long(df: DataFrame, name: str):
    from pyspark.sql import types as T

    return T.StructType([*df.schema.fields, T.StructField(name, T.LongType(), False)])


def drop_outliers(snps: DataFrame, features: DataFrame, z_cutoff: float) -> tuple[DataFrame, DataFrame]:
    """Without all variants of regions that hold one whose total is over z_cutoff deviations from the mean.

    snps: snp_idx, ref_count, alt_count; features: region, snp_idx. Deviation is that of the population.
    """
    total = F.col("ref_count") + F.col("alt_count")
    mean, deviation = snps.agg(F.avg(total), F.stddev_pop(total)).first()
    odd = snps.where(F.abs(F.try_divide(total - F.lit(mean), F.lit(deviation))) > z_cutoff).select("snp_idx")
    regions = features.join(odd, "snp_idx", "left_semi").select("region").distinct()
    gone = features.join(regions, "region", "left_semi").select("snp_idx").distinct()
    return snps.join(gone, "snp_idx", "left_anti"), features.join(gone, "snp_idx", "left_anti")


def group_sums(coo: DataFrame, cells: DataFrame) -> DataFrame:
    """(group, snp_idx, ref, alt): pseudobulk counts. cells: bc_idx, group; cells without one are left out."""
    g = coo.join(cells.where("group is not null"), "bc_idx")
    return g.groupBy("group", "snp_idx").agg(F.sum("ref").alias("ref"), F.sum("alt").alias("alt"))


def whole_dispersion(coo: DataFrame, snps: DataFrame, pseudocount: int) -> float:
    """Dispersion of the totals of all variants, those without reads too."""
    sums = coo.groupBy("snp_idx").agg(F.sum("ref").alias("ref"), F.sum("alt").alias("alt"))
    rows = snps.select("snp_idx").join(sums, "snp_idx", "left").select((F.coalesce("ref", F.lit(0)) + pseudocount).alias("ref"), (F.coalesce("alt", F.lit(0)) + pseudocount).alias("alt"))
    return fit_dispersion(rows.withColumn("N", F.col("ref") + F.col("alt")), (1e-6, 1 - 1e-6))


def _shifted(sums: DataFrame, pc: int) -> DataFrame:
    return sums.withColumns({"ref": F.col("ref") + pc, "N": F.col("ref") + F.col("alt") + 2 * pc})


def find_imbalance_groups(coo: DataFrame, snps: DataFrame, features: DataFrame, cells: DataFrame, min_count: int = 10, pseudocount: int = 1, gt: str | None = None) -> DataFrame:
    """group, region, num_snps, mu, null_ll, alt_ll, pval, fdr_pval.

    features: region, snp_idx. gt: phased genotype column of snps. A region
    counts in a group if its variants with reads there have min_count of them.
    """
    rho = whole_dispersion(coo, snps, pseudocount)
    sums = _shifted(group_sums(coo, cells), pseudocount).where(F.col("N") > 2 * pseudocount)
    rows = sums.join(features.select("region", "snp_idx").distinct(), "snp_idx")
    enough = rows.groupBy("group", "region").agg((F.sum("N") >= F.count("*") * 2 * pseudocount + min_count).alias("ok")).where("ok").drop("ok")
    rows = rows.join(enough, ["group", "region"])
    phase = snps.select("snp_idx", (F.substring(gt, 1, 1).cast("byte") if gt else F.lit(None).cast("byte")).alias("gt"))
    rows = rows.join(phase, "snp_idx").select("group", F.col("region").cast("string"), F.lit("").alias("chrom"), F.col("snp_idx").alias("pos"), "ref", "N", "gt", F.lit(rho).alias("rho"))
    out = fit_regions(rows, gt is not None, keys=("group", "region"), exact_single=True)
    out = bh_adjust(out, by=("group",))
    return out.select("group", "region", F.col("snp_count").alias("num_snps"), "mu", "null_ll", "alt_ll", "pval", "fdr_pval")


def group_pairs(cells: DataFrame) -> DataFrame:
    """(group1, group2): unordered pairs of different groups; as many rows as the few groups have pairs."""
    g = cells.where("group is not null").select("group").distinct()
    return g.select(F.col("group").alias("group1")).join(F.broadcast(g.select(F.col("group").alias("group2"))), F.col("group1") < F.col("group2"))


def compare_groups(coo: DataFrame, snps: DataFrame, features: DataFrame, cells: DataFrame, min_count: int = 10, pseudocount: int = 1, gt: str | None = None, shared_snps: bool = True) -> DataFrame:
    """group1, group2, region, num_snps, combined_mu, mu1, mu2, null_ll, alt_ll, pval, fdr_pval.

    One mean for both groups against one for each. shared_snps: only variants
    that both groups have enough reads of; else each group its own, in regions
    that both have (num_snps then counts group1's).
    """
    rho = whole_dispersion(coo, snps, pseudocount)
    sums = _shifted(group_sums(coo, cells), pseudocount).where(F.col("N") > min_count + 2 * pseudocount)
    phase = snps.select("snp_idx", (F.substring(gt, 1, 1).cast("byte") if gt else F.lit(None).cast("byte")).alias("gt"))
    f = features.select(F.col("region").cast("string").alias("region"), "snp_idx").distinct()
    rows = sums.join(f, "snp_idx").join(phase, "snp_idx")
    pairs = group_pairs(cells)
    one = rows.join(F.broadcast(pairs), rows["group"] == pairs["group1"]).drop("group").withColumn("side", F.lit(0).cast("byte"))
    two = rows.join(F.broadcast(pairs), rows["group"] == pairs["group2"]).drop("group").withColumn("side", F.lit(1).cast("byte"))
    both = one.unionByName(two)
    key = ["group1", "group2", "region"]
    if shared_snps:
        common = both.groupBy(*key, "snp_idx").agg(F.count_distinct("side").alias("n")).where("n = 2").drop("n")
        both = both.join(common, [*key, "snp_idx"])
    limit = F.count("*") * 2 * pseudocount + min_count
    enough = both.groupBy(*key, "side").agg((F.sum("N") >= limit).alias("ok")).where("ok").groupBy(*key).agg(F.count("*").alias("n")).where("n = 2").drop("n")
    both = both.join(enough, key)
    cols = both.select(*key, "side", "ref", "N", F.coalesce("gt", F.lit(-1).cast("byte")).alias("gt"), F.lit(rho).alias("rho"), F.lit("").alias("chrom"), F.col("snp_idx").alias("pos"))
    cells_ = cols.groupBy(*key, "side", "ref", "N", "gt", "rho").agg(F.count("*").alias("c"), F.min(F.struct("chrom", "pos", "ref", "N", "gt")).alias("head"))
    dealt = cells_.repartition(*key).sortWithinPartitions(*key, "side")
    phased = gt is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, key):
            n = table.num_rows
            side = table["side"].to_numpy()
            ends = np.append(starts[1:], n)
            middle = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
            tables = []
            for lo, hi in ((starts, middle), (middle, ends)):
                rows_ = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
                at = np.concatenate(([0], np.cumsum(hi - lo)[:-1]))
                tables.append(terms(table.take(pa.array(rows_)).combine_chunks(), at))
            f1, f2 = (alternative(t, phased) for t in tables)
            m = len(starts)
            both_mu = bb.golden_section(lambda x: f1(x) + f2(x), 0.0, 1.0, m)
            mu1, mu2 = bb.golden_section(f1, 0.0, 1.0, m), bb.golden_section(f2, 0.0, 1.0, m)
            null, alt = -(f1(both_mu) + f2(both_mu)), -(f1(mu1) + f2(mu2))
            p = bb.chi2_sf(np.maximum(-2 * (null - alt), 0.0))
            size = tables[0].sums(tables[0].c).astype(np.int64)
            out = [table[k].take(pa.array(starts)).combine_chunks() for k in key]
            out += [pa.array(x) for x in (size, both_mu, mu1, mu2, null, alt, p)]
            yield pa.RecordBatch.from_arrays(out, [*key, "num_snps", "combined_mu", "mu1", "mu2", "null_ll", "alt_ll", "pval"])

    kinds = ", ".join(f"{k} {dict(cols.dtypes)[k]}" for k in key)
    out = dealt.mapInArrow(run, f"{kinds}, num_snps long, combined_mu double, mu1 double, mu2 double, null_ll double, alt_ll double, pval double")
    return bh_adjust(out, by=("group1", "group2"))
