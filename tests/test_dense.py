"""Many variants a read: results against brute force, and rows that don't grow with the overlaps."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from phasewise.operators import counting, expression, pairs, rewrite
from phasewise.plans.registry import ORACLE_SQL, QUERIES
from tests.test_reads import READS, VARIANTS, read, variant


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f2_fragments_are_swept(spark):
    rng = random.Random(2)
    rows = [(rng.choice("cd"), s := rng.randrange(150), s + rng.randrange(0, 60), rng.choice(["x", "y", "z", None])) for _ in range(120)]
    f = spark.createDataFrame(rows, "chrom string, start long, end long, barcode string").repartition(3)
    v = spark.createDataFrame([variant(rng.randrange(200), chrom=rng.choice("cde")) for _ in range(90)], VARIANTS)
    for least, cells in ((1, 1), (5, 2), (900, 1), (10**6, 1)):
        want = expression.fragment_pseudobulk(expression.fragment_counts(f, v, least), cells)
        got = expression.fragment_coverage(f, v, least, cells, width=16)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_f3_equal_overlaps_go_before_the_join(spark):
    rng = random.Random(3)
    reads = [read(f"q{rng.randrange(12)}", i, rng.randrange(200), f"{rng.randrange(1, 90)}M", flag=rng.choice([67, 131])) for i in range(60)]
    sites = {(p, n) for p, n in ((rng.randrange(250), rng.choice([1, 1, 4])) for _ in range(80))}
    v = [variant(p, "A" * n) for p, n in sorted(sites)]
    best = {}
    for r in reads:
        a = rewrite.Alignment.of(r[3], r[5])
        for x in v:
            if a.pos0 < x[3] and x[1] < a.end:
                key = (r[0], 1 if r[1] & 64 else 2, x[1], x[3])
                best[key] = min(best.get(key, (10**9,)), (r[3], r[12], a.end))
    out = pairs.read_variants(spark.createDataFrame(reads, READS).repartition(4), spark.createDataFrame(v + v[:9], VARIANTS))
    got = sorted(((r["read"], r["mate"], r["v_pos0"], r["v_end"]), r["start"], r["stop"]) for r in out.collect())
    assert got == sorted((k, b[0], b[2]) for k, b in best.items())
    assert not plan(out).startswith("Aggregate") and "Aggregate [read" not in plan(out)


def test_f4_f5_lines_of_one_number(spark, tmp_path, name):
    con = duckdb.connect()
    # Line 1 of part 100000 + p and line 2 of part p have one number. Where both are listed, both have one barcode.
    con.execute(f"""copy (select o::bigint as l_orderkey, (case n when 1 then 100000 + o % 40 else o % 40 end)::bigint as l_partkey,
      (case when n = 1 or o % 3 = 0 then o % 50 else 45 end)::bigint as l_suppkey, n::int as l_linenumber, 30.0::double as l_quantity, 1.0::double as l_extendedprice,
      'A' as l_returnflag from range(300) a(o), range(1, 3) b(n)) to '{tmp_path}/lineitem.parquet'""")
    con.execute(f"copy (select p::bigint as p_partkey from range(0, 110000) t(p)) to '{tmp_path}/part.parquet'")
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want) and want


def test_f6_a_read_comes_once_a_word(spark):
    from phasewise.operators.interval_join import word_hits

    rng = random.Random(6)
    make = lambda n, most: [(rng.choice("ab"), s := rng.randrange(-70, 400), s + rng.randrange(1, most), i) for i in range(n)]
    left, right = make(80, 150), make(60, 90)
    a, b = spark.createDataFrame(left, "c string, s long, e long, i int"), spark.createDataFrame(right * 20, "d string, t long, u long, j int")
    hits = word_hits(a, b, ("c", "s", "e"), ("d", "t", "u"), odd=F.col("j") % 2 == 1).collect()
    met = {(x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]}
    assert {r["i"] for r in hits} == {i for i, _ in met}
    assert {r["i"] for r in hits if r["odd"]} == {i for i, j in met if j % 2}
    assert len(hits) <= sum(((x[2] - 1) >> 6) - (x[1] >> 6) + 1 for x in left)


def test_f7_masks_of_names(spark):
    v = spark.createDataFrame([("c", p, p + 1) for p in range(0, 90, 3)] * 4, "v_chrom string, v_pos0 long, v_end long")
    reads = [read("a", 0, 1, "2M"), read("b", 1, 2, "3M"), read("b", 2, 60, "4M"), read("d", 3, 61, "9M"), read("e", 4, 6, "1M", flag=4)]
    got = pairs.overlap_masks(spark.createDataFrame(reads, READS), v, F.col("v_pos0") % 2 == 0)
    assert {r["qname"]: r["mask"] for r in got.collect()} == {"b": 3, "d": 3}


def test_f8_pairs_need_no_list_of_names(spark):
    rows = [read("q", 0, 100, flag=99), read("q", 1, 130, flag=147, seq="C" * 10), read("r", 2, 300, flag=99), read("r", 3, 330, flag=147), read("s", 4, 100)]
    out = rewrite.make_copies(spark.createDataFrame(rows, READS), spark.createDataFrame([variant(104)], VARIANTS))
    assert [r["qname"] for r in out.collect()] == ["q"] and "LeftSemi" not in plan(out)


def test_f9_one_row_for_a_read_in_a_bin(spark):
    v = spark.createDataFrame([variant(p) for p in range(0, 200)], VARIANTS)
    reads = spark.createDataFrame([read(f"q{i}", i, i * 7, "9M") for i in range(20)] + [read("x", 50, 3, "2S2M60N2M", seq="TTGAAA")], READS)
    rows = counting.covered(reads, counting.indexed(v), first=True)
    assert rows.count() <= 2 * 21
    low = {r["qname"]: r["p"] for r in rows.groupBy("qname").agg(F.min("v_pos0").alias("p")).collect()}
    assert low == {f"q{i}": i * 7 for i in range(20)} | {"x": 3}
    assert sum(r["ref_count"] + r["alt_count"] for r in counting.count_bulk(reads, v).collect()) == 21
