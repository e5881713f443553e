"""Intervals, counting, pairs and swapped reads against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from phasewise.functions import columns as C
from phasewise.operators import counting, pairs, rewrite
from phasewise.operators.interval_join import interval_join

READS = "qname string, flag int, chrom string, pos0 long, mapq int, cigar string, mate_chrom string, mate_pos0 long, seq string, qual string, tags map<string,string>, cb string, file_order long"
VARIANTS = "chrom string, pos0 long, pos long, end long, ref string, alt string, GT string"


def read(qname, order, pos0, cigar="10M", seq=None, flag=67, chrom="c", cb=None, qual=None):
    size = sum(n for op, n in rewrite.Alignment.of(0, cigar).ops if op in "MIS=X")
    seq = seq or "A" * size
    return (qname, flag, chrom, pos0, 60, cigar, chrom, 0, seq, qual or "F" * size, {}, cb, order)


def variant(pos0, ref="A", alt="G", gt="0|1", chrom="c"):
    return (chrom, pos0, pos0 + 1, pos0 + len(ref), ref, alt, gt)


@pytest.mark.parametrize("width", [3, 16, 1 << 14])
def test_interval_join(spark, width):
    rng = random.Random(width)
    make = lambda n: [(rng.choice("ab"), s := rng.randrange(60), s + rng.randrange(1, 20), i) for i in range(n)]
    left, right = make(60), make(40)
    a, b = spark.createDataFrame(left, "c string, s long, e long, i int"), spark.createDataFrame(right, "d string, t long, u long, j int")
    got = sorted((r["i"], r["j"]) for r in interval_join(a, b, ("c", "s", "e"), ("d", "t", "u"), width).collect())
    want = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert got == want
    hit = {i for i, _ in want}
    for how, ids in (("left_semi", hit), ("left_anti", {x[3] for x in left} - hit)):
        assert {r["i"] for r in interval_join(a, b, ("c", "s", "e"), ("d", "t", "u"), width, how).collect()} == ids


def test_query_positions(spark):
    rng = random.Random(1)
    rows = [("".join(f"{rng.randrange(1, 6)}{op}" for op in rng.choices("MIDNS=XH", k=rng.randrange(1, 6))), rng.randrange(30)) for _ in range(200)]
    df = spark.createDataFrame(rows, "cigar string, t long").select("*", C.query_position(F.col("cigar"), F.lit(5).cast("long"), F.col("t")).alias("q"), C.reference_length(F.col("cigar")).alias("n"))
    for r in df.collect():
        a = rewrite.Alignment.of(5, r["cigar"])
        assert r["q"] == a.base(r["t"]) and r["n"] == a.end - 5


def test_position_maps():
    a = rewrite.Alignment.of(100, "5M2D5M")
    assert [a.base(x) for x in (99, 100, 104, 105, 107, 111, 112)] == [None, 0, 4, None, 5, 9, None]
    assert (a.boundary(105), a.boundary(106), a.boundary(112)) == (5, 5, 10)
    assert (a.flank(105, True), a.flank(106, False)) == (4, 5)
    assert rewrite.Alignment.of(100, "5M10N5M").boundary(107) is None
    assert rewrite.Alignment.of(100, "3S5M2I5M").base(105) == 10


def brute_counts(reads, variants, sites):
    counts, seen = {v: [0, 0, 0] for v in sites}, set()
    for r in sorted(reads, key=lambda x: x[12]):
        if r[1] & 4 or (r[2], r[0]) in seen:
            continue
        a = rewrite.Alignment.of(r[3], r[5])
        hits = [v for v in sites if v[0] == r[2] and a.base(v[1]) is not None]
        if not hits:
            continue
        v = min(hits, key=lambda x: x[1])
        base = r[8][a.base(v[1])]
        if base not in "ACGTN":
            continue
        counts[v][0 if base == v[2] else 1 if base == v[3] else 2] += 1
        seen.add((r[2], r[0]))
    return {(v[0], v[1]): tuple(c) for v, c in counts.items()}


def test_bulk_counts(spark):
    rng = random.Random(7)
    reads = []
    for i in range(150):
        cigar = rng.choice(["10M", "4M2D6M", "3S7M", "5M3I2M", "4M5N6M"])
        size = sum(n for op, n in rewrite.Alignment.of(0, cigar).ops if op in "MIS")
        reads.append(read(f"q{rng.randrange(70)}", i, rng.randrange(80), cigar, "".join(rng.choices("ACGTNR", k=size)), rng.choice([67, 131, 4, 256, 1024]), rng.choice("cd")))
    variants = [variant(p, chrom=ch) for ch in "cd" for p in rng.sample(range(90), 12)]
    df = spark.createDataFrame(reads, READS).repartition(5)
    got = counting.count_bulk(df, spark.createDataFrame(variants, VARIANTS)).collect()
    want = brute_counts(reads, variants, [(v[0], v[1], v[4], v[5]) for v in variants])
    assert {(r["chrom"], r["pos0"]): (r["ref_count"], r["alt_count"], r["other_count"]) for r in got} == want


def test_indel_alleles_and_quality(spark):
    reads = [read("q1", 0, 10, seq="AACTTAAAAA"), read("q2", 1, 10, seq="AACAAAAAAA"), read("q3", 2, 10, seq="AAGAAAAAAA", qual="FF!FFFFFFF")]
    v = [variant(12, "C", "CTT")]
    df, dv = spark.createDataFrame(reads, READS), spark.createDataFrame(v, VARIANTS)
    r = counting.count_bulk(df, dv).first()
    assert (r["ref_count"], r["alt_count"], r["other_count"]) == (1, 1, 1)
    assert counting.count_bulk(df, dv, min_qual=10).first()["other_count"] == 0


def test_unreadable_base_leaves_the_name_free(spark):
    reads = [read("q", 0, 10, seq="R" * 10), read("q", 1, 10, seq="G" * 10)]
    r = counting.count_bulk(spark.createDataFrame(reads, READS), spark.createDataFrame([variant(12)], VARIANTS)).first()
    assert (r["ref_count"], r["alt_count"], r["other_count"]) == (0, 1, 0)


def test_cell_counts(spark):
    rng = random.Random(3)
    reads = [read(f"q{rng.randrange(40)}", i, rng.randrange(60), rng.choice(["10M", "4M2D6M"]), "".join(rng.choices("ACGTR", k=10)), cb=rng.choice(["x", "y", "z", None])) for i in range(100)]
    snps = [("c", p, "A", "G", i) for i, p in enumerate(rng.sample(range(70), 10))]
    want, seen = {}, set()
    for _, p, ref, alt, i in snps:
        for r in reads:
            q = rewrite.Alignment.of(r[3], r[5]).base(p)
            if r[0] in seen or r[11] not in ("x", "y") or q is None:
                continue
            seen.add(r[0])
            cell = want.setdefault((i, "xy".index(r[11])), [0, 0, 0])
            cell[0 if r[8][q] == ref else 1 if r[8][q] == alt else 2] += 1
    got = counting.count_cells(spark.createDataFrame(reads, READS), spark.createDataFrame(snps, "chrom string, pos0 long, ref string, alt string, snp_idx long"), spark.createDataFrame([("x", 0), ("y", 1)], "barcode string, bc_idx long"))
    assert {(r["snp_idx"], r["bc_idx"]): [r["ref"], r["alt"], r["other"]] for r in got.collect()} == want


def test_pairs_and_orphans(spark):
    rows = [read("a", 0, 5, flag=131), read("a", 1, 9, flag=67), read("a", 2, 30, flag=67), read("b", 3, 5, flag=67), read("d", 4, 5, flag=67 | 256), read("d", 5, 5, flag=131)]
    df = spark.createDataFrame(rows, READS)
    (p,) = pairs.mate_pairs(df).collect()
    assert (p["qname"], p["r1"]["pos0"], p["r2"]["pos0"]) == ("a", 9, 5)
    assert {r["qname"] for r in pairs.orphans(df).collect()} == {"b", "d"}


def mate(seq, cigar=None, pos0=100, edits=()):
    return rewrite.Mate(pos0, cigar or f"{len(seq)}M", seq, [30] * len(seq), edits)


def test_snv_copies():
    e = [rewrite.Edit(102, 103, "A", "G", 1), rewrite.Edit(105, 106, "T", "A", 1)]
    outcome, out = rewrite.pair_copies("q", mate("AAAAAAAA", edits=e), mate("CCCC", pos0=200))
    assert outcome == "remap" and [c["seq1"] for c in out] == ["AAAAATAA", "AAGAAAAA"]
    assert [c["name"] for c in out] == ["q_SWAP_100_200_1_2", "q_SWAP_100_200_2_2"]
    assert rewrite.pair_copies("q", mate("AAAA", edits=[rewrite.Edit(101, 102, "A", "A", 1)]), mate("C"))[0] == "keep"
    assert rewrite.pair_copies("q", mate("AAAA", "2M2D2M", edits=[rewrite.Edit(102, 103, "A", "G", 1)]), mate("C"))[0] == "unmappable"


def test_indel_copies_keep_lengths():
    e = [rewrite.Edit(102, 103, "A", "ATT", 1)]
    outcome, out = rewrite.pair_copies("q", mate("AAAAAAAA", edits=e), mate("CCCC", pos0=200), indels=True)
    assert outcome == "remap" and len(out) == 3 and {len(c["seq1"]) for c in out} == {8}
    assert [c["seq1"] for c in out] == ["AAATTAAA", "AATTAAAA", "ATTAAAAA"]
    assert out[0]["name"].split("_SWAP_")[1].split("_") == ["100", "200", "1", "3", "0", "3", "2", "0"]
    _, out = rewrite.pair_copies("q", mate("AAAAAAAA", edits=[rewrite.Edit(102, 105, "AAA", "A", 3)]), mate("CCCC"), indels=True)
    assert out[0]["seq1"] == "AAAAAANN" and out[0]["qual1"].endswith("!!")
    assert rewrite.pair_copies("q", mate("AAAAAAAA", edits=e), mate("C"), indels=True, max_indel=1)[0] == "keep"


def test_qualities_of_insertions():
    seq, qual = rewrite.put_in("AACC", [10, 20, 31, 40], [(2, 3)], ["GGG"])
    assert seq == "AAGGGC" and qual == [10, 20, 31, 23, 23, 40]
    assert rewrite.put_in("A", [9], [(0, 1)], ["TT"])[1] == [9, 30]


def test_sample_haplotypes():
    a = rewrite.Alignment.of(100, "6M")
    v = [(101, 102, [("A", "G"), ("A", "G"), (".", "G")]), (103, 104, [("T", "A"), ("T", "T"), ("T", "T")])]
    assert [s for s, _ in rewrite.sample_haplotypes(a, "AAAAAA", [30] * 6, v)] == ["AAATAA", "AGAAAA", "AGATAA"]


def test_copies_in_spark(spark):
    rows = [read("q", 0, 100, flag=99), read("q", 1, 130, flag=147, seq="C" * 10), read("r", 2, 300, flag=99), read("r", 3, 330, flag=147)]
    df = spark.createDataFrame(rows, READS)
    out = rewrite.make_copies(df, spark.createDataFrame([variant(104), variant(104)], VARIANTS)).collect()
    assert [(r["qname"], r["seq1"], r["reverse1"], r["reverse2"], r["overlap_mask"]) for r in out] == [("q", "AAAAGAAAAA", False, True, 1)]


def test_remap_filter(spark):
    def copy(name, i, n, at, order, moved=0):
        tag = f"{name}_SWAP_{at}_{at + 50}_{i}_{n}"
        a, b = at + moved, at + 50
        return [(tag, 67, "c", a, b, order), (tag, 131, "c", b, a, order + 1)]

    rows = copy("k", 1, 2, 10, 0) + copy("k", 2, 2, 10, 2) + copy("m", 1, 1, 20, 4, moved=3) + copy("x", 1, 2, 30, 6)
    df = spark.createDataFrame(rows, "qname string, flag int, chrom string, pos0 long, mate_pos0 long, file_order long")
    assert {r["orig"]: r["verdict"] for r in pairs.remap_verdicts(df).collect()} == {"k": "kept", "m": "moved", "x": "missing"}
    assert {r["orig"]: r["verdict"] for r in pairs.remap_verdicts(df, slop=3).collect()}["m"] == "kept"
    side = spark.createDataFrame([("m_SWAP_20_70_1_1/1", 1, 23, 70)], "qname string, mate int, pos1 long, pos2 long")
    assert {r["orig"]: r["verdict"] for r in pairs.remap_verdicts(df, sidecar=side).collect()}["m"] == "kept"
    original = spark.createDataFrame([read(n, i, 10) for i, n in enumerate("kmxz")], READS)
    assert [r["qname"] for r in pairs.filter_remapped(original, df).collect()] == ["k"]


def test_copies_of_samples(spark):
    rows = [read("q", 0, 100, flag=99), read("q", 1, 130, flag=147, seq="C" * 10)]
    v = spark.createDataFrame([("c", 104, 105, 105, "A", "G", "0|1", "1|1"), ("c", 106, 107, 107, "A", "T", "0|1", "./.")], "chrom string, pos0 long, pos long, end long, ref string, alt string, GT_a string, GT_b string")
    out = rewrite.make_sample_copies(spark.createDataFrame(rows, READS), v, ["a", "b"]).collect()
    assert [(r["seq1"], r["seq2"]) for r in out] == [("AAAAGATAAA", "C" * 10)] and out[0]["name"] == "q_SWAP_100_130_1_1"
