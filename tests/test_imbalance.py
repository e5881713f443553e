import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phasewise.functions import betabinom as bb
from phasewise.operators.fdr import bh_adjust
from phasewise.operators.imbalance import alternative, find_imbalance, fit_regions, region_column, Terms

COLUMNS = "chrom string, pos long, ref string, alt string, GT string, ref_count long, alt_count long, other_count long"
#: Published results: pos, ref, alt, null_ll, alt_ll, mu, lrt, pval, fdr.
GOLDEN = [
    (5000, 6, 0, -2.237279989, -1.621176524, 0.778719285, 1.232206930, 0.266978272, 0.542195753),
    (10800, 6, 0, -2.237279989, -1.621176524, 0.778719285, 1.232206930, 0.266978272, 0.542195753),
    (750, 4, 0, -1.930237339, -1.513836833, 0.744685457, 0.832801014, 0.361463835, 0.542195753),
    (1200, 5, 0, -2.092189495, -1.572070401, 0.763883798, 1.040238187, 0.307766082, 0.542195753),
    (12800, 2, 0, -1.537237125, -1.350716189, 0.680773101, 0.373041872, 0.541350839, 0.649621006),
    (2800, 1, 0, -1.292522367, -1.222038368, 0.619601598, 0.140967999, 0.707320580, 0.707320580),
]


def exact_log_pmf(k, n, mu, rho):
    a, b = mu * (1 - rho) / rho, (1 - mu) * (1 - rho) / rho
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + beta(k + a, n - k + b) - beta(a, b)


@given(st.floats(1e-6, 1e6))
def test_lgamma(x):
    assert float(bb.lgamma(np.array([x]))[0]) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


@given(st.integers(0, 60), st.integers(0, 60), st.floats(0.01, 0.99), st.floats(0.001, 0.999))
def test_log_pmf(k, more, mu, rho):
    assert float(bb.log_pmf(k, k + more, mu, rho)) == pytest.approx(exact_log_pmf(k, k + more, mu, rho), rel=1e-8, abs=1e-8)


@given(st.integers(0, 40), st.integers(0, 40))
def test_binomial(k, more):
    n = k + more
    p = [math.comb(n, j) / 2**n for j in range(n + 1)]
    want = min(1.0, sum(x for x in p if x <= p[k] * (1 + 1e-7)))
    assert float(bb.binomial_two_sided(np.array([k]), np.array([n]))[0]) == pytest.approx(want, rel=1e-9)


def test_golden_table(spark):
    rows = [("c", p, "A", "G", "0|1", a, b, 0) for p, a, b, *_ in GOLDEN] + [("c", 1, "A", "G", "0|1", 0, 0, 0)]
    out = find_imbalance(spark.createDataFrame(rows, COLUMNS), 1, 1, region=None).collect()
    assert len(out) == len(GOLDEN)
    by = {r["region"]: r for r in out}
    for pos, ref, alt, *want in GOLDEN:
        r = by[f"c_{pos}"]
        assert (r["ref_count"], r["alt_count"], r["N"], r["snp_count"]) == (ref, alt, ref + alt, 1)
        assert [r[c] for c in ("null_ll", "alt_ll", "mu", "lrt", "pval", "fdr_pval")] == pytest.approx(want, abs=1e-8)


def _region(spark, rows, **options):
    df = spark.createDataFrame([("c", p, "A", "G", g, a, b, 0, "R") for p, g, a, b in rows], COLUMNS + ", region string")
    return find_imbalance(df, 0, 0, **options).collect()


def test_phased_region_anchors_the_first_variant(spark):
    (r,) = _region(spark, [(101, "0|1", 10, 8), (201, "1|0", 7, 9)], phased=True)
    assert r["snp_count"] == 2 and r["mu"] > 0.5
    (q,) = _region(spark, [(101, "0|1", 10, 8), (201, "0|1", 7, 9)], phased=True)
    assert q["mu"] > 0.5  # one phase only: taken as unphased, first variant anchored


def test_unphased_matches_direct_mixture():
    k, n, rho = np.array([10, 7, 3]), np.array([18, 16, 9]), 0.2
    t = Terms(k, n, np.ones(3), np.full(3, rho), np.full(3, -1), np.array([0]), k[:1], n[:1], np.array([rho]), np.array([-1]))
    for mu in (0.1, 0.4, 0.77):
        want = exact_log_pmf(10, 18, mu, rho)
        for a, b in ((7, 16), (3, 9)):
            want += math.log(0.5 * math.exp(exact_log_pmf(a, b, mu, rho)) + 0.5 * math.exp(exact_log_pmf(a, b, 1 - mu, rho)))
        assert float(alternative(t, False)(np.array([mu]))[0]) == pytest.approx(-want, rel=1e-9)


def test_later_rows_order_does_not_matter(spark):
    rows = [(1, "0|1", 10, 8), (2, "1|0", 7, 9), (3, "0|1", 2, 12)]
    outs = [_region(spark, [rows[0], *p])[0]["alt_ll"] for p in itertools.permutations(rows[1:])]
    assert outs[0] == pytest.approx(outs[1], rel=1e-12)


def test_swapping_alleles_mirrors_the_mean(spark):
    a, b = (find_imbalance(spark.createDataFrame([("c", i, "A", "G", "0|1", *x, 0) for i, x in enumerate(v)], COLUMNS), 0, 1, region=None).orderBy("region").collect() for v in ([(9, 3), (4, 4)], [(3, 9), (4, 4)]))
    assert a[0]["mu"] == pytest.approx(1 - b[0]["mu"], abs=1e-5)


@pytest.mark.parametrize("model", ["linear", "per_donor"])
def test_other_models(spark, model):
    df = spark.createDataFrame([("c", i, "A", "G", "0|1", 5 + i % 7, 6, 0, f"R{i % 3}", f"d{i % 2}") for i in range(40)], COLUMNS + ", region string, sample string")
    out = find_imbalance(df, 1, 1, model=model, region="region").collect()
    assert len(out) == 3 and all(0 <= r["pval"] <= r["fdr_pval"] <= 1 and r["lrt"] >= 0 for r in out)
    assert sum(r["ref_count"] for r in out) == sum(5 + i % 7 for i in range(40))


def test_bad_model_and_columns(spark):
    df = spark.createDataFrame([("c", 1, "A", "G", "0|1", 1, 1, 0)], COLUMNS)
    with pytest.raises(ValueError):
        find_imbalance(df, model="cubic")
    with pytest.raises(ValueError):
        find_imbalance(df, model="per_donor")
    assert region_column(["chrom", "pos", "ref", "peak", "ref_count"]) == "peak"
    assert region_column(["chrom", "pos", "start", "stop", "ref", "alt", "total_count", "vcf_sample", "donor_id", "region"]) == "region"
    assert find_imbalance(df, min_count=100).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1e-12, 0.01, 0.011, 0.2, 0.25, 0.5, 0.77, 1.0]), min_size=1, max_size=25))
def test_step_up(spark, p):
    df = spark.createDataFrame(list(enumerate(p)), "i int, pval double")
    got = [r["fdr_pval"] for r in bh_adjust(df).orderBy("i").collect()]
    order, m, low, want = sorted(range(len(p)), key=lambda i: p[i]), len(p), 1.0, [0.0] * len(p)
    for rank in range(m, 0, -1):
        low = min(low, p[order[rank - 1]] * m / rank)
        want[order[rank - 1]] = low
    assert got == pytest.approx(want, abs=1e-12)


def test_step_up_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "i int, pval double")
    assert {r["i"]: r["fdr_pval"] for r in bh_adjust(df).collect()} == {1: None, 2: 0.5}
    assert bh_adjust(df.limit(0)).count() == 0


def test_large_region_is_one_histogram(spark):
    rows = spark.range(5000).select(F.lit("R").alias("region"), F.lit("c").alias("chrom"), F.col("id").alias("pos"), (F.col("id") % 5).alias("ref"), F.lit(6).cast("long").alias("N"), F.lit(None).cast("byte").alias("gt"), F.lit(0.1).alias("rho"))
    assert fit_regions(rows, False).first()["snp_count"] == 5000
