"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from phasewise.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def stepped_up(p):
    """Benjamini and Hochberg's adjustment."""
    order = sorted(range(len(p)), key=p.__getitem__, reverse=True)
    out, low = [0.0] * len(p), 1.0
    for i, k in enumerate(order):
        low = min(low, p[k] * len(p) / (len(p) - i))
        out[k] = low
    return out


@pytest.mark.parametrize("name", sorted(x for x in QUERIES if x.startswith("find_imbalance")))
def test_imbalance_columns_follow_from_each_other(spark, con, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and len({(r["region"], r["group"] if "group" in r else None) for r in rows}) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r["group"] if "group" in r else None, []).append(r)
        lrt = max(0.0, 2 * (r["alt_ll"] - r["null_ll"]))
        assert 0 <= r["mu"] <= 1 and r["pval"] == pytest.approx(math.erfc(math.sqrt(lrt / 2)), abs=1e-9)
        if "N" in r:
            assert r["N"] == r["ref_count"] + r["alt_count"] and r["lrt"] == pytest.approx(lrt, abs=1e-9)
    for g in groups.values():
        for r, q in zip(g, stepped_up([r["pval"] for r in g]), strict=True):
            assert r["fdr_pval"] == pytest.approx(q, abs=1e-9)


@pytest.mark.parametrize("name", sorted(x for x in set(QUERIES) - set(ORACLE_SQL) if not x.startswith("find_imbalance")))
def test_query_runs(spark, name):
    # The smallest tables have too few reads for two groups of cells.
    df = QUERIES[name](spark, SF.replace("0.001", "0.01") if name == "compare_imbalance" else SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_the_first_of_equal_overlaps_stays(spark):
    from phasewise.operators import pairs

    reads = [("r", 67, "chr1", p, 60 + i, "9M", "A" * 9, "F" * 9, i) for i, p in enumerate((8, 5, 5, 7))]
    df = spark.createDataFrame(reads, "qname string, flag int, chrom string, pos0 long, mapq int, cigar string, seq string, qual string, file_order long").repartition(4)
    v = spark.createDataFrame([("chr1", 10, 11, "A", "G", "0|1")], "chrom string, pos0 long, end long, ref string, alt string, GT string")
    for _ in range(3):
        (row,) = pairs.read_variants(df, v).collect()
        assert (row["start"], row["stop"], row["mapq"], row["GT"], row["mate"]) == (5, 14, 61, "0|1", 1)
    assert "file_order" not in pairs.read_variants(df, v).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_haplotype_layers_takes_every_variant(spark, monkeypatch):
    from phasewise.plans.registry import expression

    seen, layers = [], expression.haplotype_layers
    monkeypatch.setattr(expression, "haplotype_layers", lambda c, p: seen.append((c.count(), p.count())) or layers(c, p))
    QUERIES["haplotype_layers"](spark, SF)
    assert seen[0][0] == seen[0][1] > 0
