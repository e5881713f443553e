"""Allelic imbalance by beta-binomial likelihood-ratio tests.

The dispersion is fitted under the null and then held, and each region's mean
is fitted by golden section. Likelihoods depend on counts alone, so rows
are first counted by (region, ref, N, phase): a region with very many variants
becomes a small histogram before it is shuffled, and whole partitions of
regions are optimised in step on arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.functions import betabinom as bb
from phasewise.functions import columns as C
from phasewise.functions.groups import whole_groups
from phasewise.operators.fdr import bh_adjust

#: Histogram rows that the driver fits a dispersion on; above, every step is a Spark aggregate.
DRIVER_ROWS = 2_000_000
RHO_BOUNDS = (0.001, 0.999)
DONOR_BOUNDS = (1e-6, 1 - 1e-6)
#: Starts of the search for the two parameters of the linear model, fixed values.
STARTS = ((0, 0), (-3, 0), (-6, 0), (3, 0), (0, -0.2), (-3, -0.2), (-6, -0.2), (3, -0.2))
MODELS = ("single", "linear", "per_donor")
#: Columns that are never the region, fixed values.
METADATA = frozenset(
    "chrom pos0 pos start stop end ref alt GT genotype ref_count alt_count other_count total_count N sample donor_id vcf_sample ref_base alt_base parent gene_parent index".split()
)


def region_column(names: list[str]) -> str | None:
    """The first column that isn't metadata."""
    return next((n for n in names if n not in METADATA and not n.startswith("groupby_")), None)


def prepared(counts: DataFrame, region: str | None, min_count: int, pseudocount: int, phased: bool, dedup: bool, sample: str | None) -> DataFrame:
    """chrom, pos, region, ref, alt, N, gt, sample: rows with pseudocounts that have enough reads."""
    label = C.variant_label(F.col("chrom"), F.col("pos")) if region is None else F.col(region).cast("string")
    gt = C.phase(F.col("GT")) if phased and "GT" in counts.columns else F.lit(None).cast("byte")
    who = F.col(sample).cast("string") if sample else F.lit(None).cast("string")
    ref, alt = F.col("ref_count").cast("long") + pseudocount, F.col("alt_count").cast("long") + pseudocount
    rows = counts.select(F.col("chrom").cast("string"), F.col("pos").cast("long"), label.alias("region"), ref.alias("ref"), alt.alias("alt"), (ref + alt).alias("N"), gt.alias("gt"), who.alias("sample"))
    rows = rows.where(F.col("N") >= min_count + 2 * pseudocount)
    return rows.dropDuplicates(["chrom", "pos", "region", "ref", "alt", "N", "gt"]) if dedup else rows


def phase_is_usable(rows: DataFrame) -> bool:
    """Both phases must occur."""
    row = rows.agg(F.max((F.col("gt") == 0).cast("int")), F.max((F.col("gt") == 1).cast("int"))).first()
    return bool(row[0]) and bool(row[1])


def null_objective(histogram: DataFrame) -> Callable[[Callable[[np.ndarray], np.ndarray]], float]:
    """Negative log-likelihood at mean one half of a histogram (ref, N, c), as a function of rho(N)."""
    rows = histogram.select("ref", "N", "c")
    small = rows.limit(DRIVER_ROWS + 1).toArrow()
    if small.num_rows <= DRIVER_ROWS:
        k, n, c = (small[x].to_numpy() for x in ("ref", "N", "c"))
        return lambda rho: float(-(c * bb.log_pmf(k, n, 0.5, rho(n))).sum())

    def summed(rho: Callable[[np.ndarray], np.ndarray]) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k, n, c = (b[x].to_numpy() for x in ("ref", "N", "c"))
                yield pa.RecordBatch.from_arrays([pa.array([float(-(c * bb.log_pmf(k, n, 0.5, rho(n))).sum())])], ["v"])

        return rows.mapInArrow(run, "v double").agg(F.sum("v")).first()[0] or 0.0

    return summed


def histogram_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ref", "N").agg(F.count("*").alias("c"))


def fit_dispersion(rows: DataFrame, bounds: tuple[float, float] = RHO_BOUNDS) -> float:
    """One dispersion for all rows (ref, N)."""
    f = null_objective(histogram_of(rows))
    best = bb.golden_section(lambda x: np.array([f(lambda n, r=float(x[0]): np.full(len(n), r))]), *bounds)
    return float(bb.clamp_rho(best[0]))


def linear_rho(d1: float, d2: float, n):
    return bb.clamp_rho(bb.expit(np.clip(d1 + n * d2, -10, 10)))


def fit_linear_dispersion(rows: DataFrame) -> tuple[float, float]:
    """d1, d2 of rho = expit(d1 + N * d2), the best of several searches."""
    f = null_objective(histogram_of(rows))
    found = [bb.simplex_2d(lambda d: f(lambda n, d=d: linear_rho(d[0], d[1], n)), s) for s in STARTS]
    point, _ = min((x for x in found if np.isfinite(x[1])), key=lambda x: x[1])
    return float(point[0]), float(point[1])


def fit_donor_dispersion(rows: DataFrame) -> DataFrame:
    """(sample, rho): a dispersion for each donor, from its histogram."""
    hist = rows.groupBy("sample", "ref", "N").agg(F.count("*").alias("c"))
    hist = hist.repartition("sample").sortWithinPartitions("sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["sample"]):
            k, n, c = (table[x].to_numpy() for x in ("ref", "N", "c"))
            owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(k))))
            rho = bb.golden_section(lambda r: np.add.reduceat(-c * bb.log_pmf(k, n, 0.5, r[owner]), starts), *DONOR_BOUNDS, len(starts))
            yield pa.RecordBatch.from_arrays([table["sample"].take(pa.array(starts)).combine_chunks(), pa.array(rho)], ["sample", "rho"])

    return hist.mapInArrow(run, "sample string, rho double")


@dataclass
class Terms:
    """Histogram cells of many regions: the row of each region's first cell is in starts."""

    k: np.ndarray
    n: np.ndarray
    c: np.ndarray
    rho: np.ndarray
    gt: np.ndarray  # 0, 1, or -1 where unknown
    starts: np.ndarray
    first_k: np.ndarray
    first_n: np.ndarray
    first_rho: np.ndarray
    first_gt: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.k))))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)

    def null_ll(self) -> np.ndarray:
        return self.sums(self.c * bb.log_pmf(self.k, self.n, 0.5, self.rho))


def alternative(t: Terms, phased: bool, shared: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """Each region's negative log-likelihood at its mean.

    One variant: that mean. Several with known phase: the mean or its
    complement by phase, with the first variant at the mean. Several without:
    the first one at the mean, the others mixed evenly over both phases; or, if
    `shared`, all at the mean.
    """
    owner = t.owner
    size = t.sums(t.c)
    known = t.sums((t.gt < 0) * t.c) == 0
    use_phase = (size > 1) & known if phased else np.zeros(len(size), bool)
    mixed = (size > 1) & ~use_phase & (not shared)
    flip = np.where(use_phase[owner], (t.gt != t.first_gt[owner]), False)

    def f(mu: np.ndarray) -> np.ndarray:
        m = np.where(flip, 1 - mu[owner], mu[owner])
        plain = bb.log_pmf(t.k, t.n, m, t.rho)
        if not mixed.any():
            return -t.sums(t.c * plain)
        other = bb.log_pmf(t.k, t.n, 1 - m, t.rho)
        both = np.log(0.5) + np.logaddexp(plain, other)
        total = t.sums(t.c * np.where(mixed[owner], both, plain))
        a = bb.log_pmf(t.first_k, t.first_n, mu, t.first_rho)
        b = bb.log_pmf(t.first_k, t.first_n, 1 - mu, t.first_rho)
        return -(total + np.where(mixed, a - (np.log(0.5) + np.logaddexp(a, b)), 0.0))

    return f


def region_histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, ref, N, gt, rho) with their count and first variant, whole regions side by side."""
    cells = rows.groupBy(*keys, "ref", "N", "gt", "rho").agg(F.count("*").alias("c"), F.min(F.struct("chrom", "pos", "ref", "N", "gt")).alias("head"))
    return cells.repartition(*keys).sortWithinPartitions(*keys)


def terms(table: pa.Table, starts: np.ndarray) -> Terms:
    k, n, c, rho = (table[x].to_numpy() for x in ("ref", "N", "c", "rho"))
    gt = table["gt"].fill_null(-1).to_numpy().astype(np.int64)
    heads = table["head"].to_pylist()
    order = [(h["chrom"] or "", h["pos"] or 0, h["ref"], h["N"], -1 if h["gt"] is None else h["gt"]) for h in heads]
    ends = np.append(starts[1:], len(k))
    first = np.array([min(range(a, b), key=order.__getitem__) for a, b in zip(starts, ends, strict=True)], np.int64)
    return Terms(k, n, c, rho, gt, starts, k[first], n[first], rho[first], gt[first])


def fit_regions(rows: DataFrame, phased: bool, shared: bool = False, keys: tuple[str, ...] = ("region",), exact_single: bool = False) -> DataFrame:
    """snp_count, ref_sum, n_sum, null_ll, alt_ll, mu, lrt and pval of each region of `rows` (chrom, pos, ref, N, gt, rho and keys).

    exact_single: a region of one variant has its closed-form mean.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            t = terms(table, starts)
            f = alternative(t, phased, shared)
            low, high = DONOR_BOUNDS if shared else (0.0, 1.0)
            mu = bb.golden_section(f, low, high, len(starts))
            size = t.sums(t.c)
            if exact_single:
                inner = (size == 1) & (t.first_k > 0) & (t.first_k < t.first_n)
                mu = np.where(inner, t.first_k / t.first_n, mu)
            null, alt = t.null_ll(), -f(mu)
            lrt = np.maximum(-2 * (null - alt), 0.0)
            cols = [table[x].take(pa.array(starts)).combine_chunks() for x in keys]
            cols += [pa.array(x.astype(np.int64)) for x in (size, t.sums(t.c * t.k), t.sums(t.c * t.n))]
            cols += [pa.array(x) for x in (null, alt, mu, lrt, bb.chi2_sf(lrt))]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "snp_count", "ref_sum", "n_sum", "null_ll", "alt_ll", "mu", "lrt", "pval"])

    kinds = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    return region_histogram(rows, keys).mapInArrow(run, f"{kinds}, snp_count long, ref_sum long, n_sum long, null_ll double, alt_ll double, mu double, lrt double, pval double")


def find_imbalance(
    counts: DataFrame,
    min_count: int = 10,
    pseudocount: int = 1,
    model: str = "single",
    phased: bool = False,
    region: str | None = "auto",
    compat_region_totals: bool = False,
) -> DataFrame:
    """region, ref_count, alt_count, N, snp_count, null_ll, alt_ll, mu, lrt, pval, fdr_pval of each region.

    region: a column, None for each variant by itself, "auto" for the first
    column that isn't metadata. Totals are those of the raw counts; with
    compat_region_totals the pseudocount is taken off once for each region only.
    """
    if model not in MODELS:
        raise ValueError(f"model must be one of {', '.join(MODELS)}")
    region = region_column(counts.columns) if region == "auto" else region
    sample = next((c for c in ("sample", "donor_id") if c in counts.columns), None)
    if model == "per_donor" and sample is None:
        raise ValueError("the per_donor model needs a column sample or donor_id")
    donor = model == "per_donor"
    rows = prepared(counts, region, min_count, pseudocount, phased, not donor, sample)
    usable = phased and phase_is_usable(rows)
    if rows.isEmpty():
        rho: Column = F.lit(0.5)
    elif model == "single":
        rho = F.lit(fit_dispersion(rows))
    elif model == "linear":
        d1, d2 = fit_linear_dispersion(rows)
        x = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.lit(d1) + F.col("N") * F.lit(d2)))
        rho = 1 / (1 + F.exp(-x))
    else:
        rows = rows.join(fit_donor_dispersion(rows), "sample")
        rho = F.greatest(F.lit(bb.RHO_MIN), F.least(F.lit(1 - bb.RHO_MIN), F.col("rho")))
    rows = rows.withColumn("rho", rho.cast("double"))
    fitted = fit_regions(rows, usable, shared=donor)
    off = F.lit(pseudocount) if compat_region_totals else pseudocount * F.col("snp_count")
    sums = {"ref_count": F.col("ref_sum") - off, "alt_count": F.col("n_sum") - F.col("ref_sum") - off}
    out = fitted.withColumns(sums).withColumn("N", F.col("ref_count") + F.col("alt_count"))
    out = bh_adjust(out)
    return out.select("region", "ref_count", "alt_count", "N", "snp_count", "null_ll", "alt_ll", "mu", "lrt", "pval", "fdr_pval")
