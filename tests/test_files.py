"""Readers, writers, bundles, whole queries, streaming."""

import gzip
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from phasewise.operators import cells, counting, expression
from phasewise.plans import workflows as w
from phasewise.sinks import bundle, files
from phasewise.sources import alignments as A
from phasewise.sources import tables as T
from phasewise.sources import variants as V
from phasewise.streaming import incremental

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tsample1\tsample2
chr1\t100\trs1\tA\tG\t30\tPASS\tDP=50\tGT\t0/1\t0/0
chr1\t200\trs2\tC\tT\t30\tPASS\t.\tGT:DP\t1/1:9\t0/1:9
chr1\t300\trs3\tG\tA\t30\tPASS\t.\tGT\t0/0\t1/1
chr1\t400\trs4\tT\tC\t30\tPASS\t.\tGT\t0|1\t0/1
chr2\t100\trs5\tA\tT\t30\tPASS\t.\tGT\t0/1\t0/0
chr2\t200\trs6\tG\tC\t30\tPASS\t.\tGT\t./.\t0/1
chr2\t300\trs7\tG\tC,GTT\t30\tPASS\t.\tDP:GT\t3:1|2\t3:0/1
"""


@pytest.fixture
def vcf(tmp_path):
    plain, packed = tmp_path / "a.vcf", tmp_path / "a.vcf.gz"
    plain.write_text(VCF)
    lines = VCF.encode().splitlines(keepends=True)
    packed.write_bytes(gzip.compress(b"".join(lines[:4])) + gzip.compress(b"".join(lines[4:])))
    return plain, packed


def sites(df):
    return sorted((r["chrom"], r["pos"]) for r in df.select("chrom", "pos").collect())


def test_vcf(spark, vcf):
    for path in map(str, vcf):
        assert sites(V.read_variants(spark, path, "sample1")) == [("chr1", 100), ("chr1", 400), ("chr2", 100)]
        assert sites(V.read_variants(spark, path, ["sample2"])) == [("chr1", 200), ("chr1", 400), ("chr2", 200)]
        assert len(sites(V.read_variants(spark, path, "sample1,sample2"))) == 5
        assert sites(V.read_variants(spark, path, "sample1,sample2", include_gt=False)) == [("chr1", 100), ("chr1", 400), ("chr2", 100)]
        assert len(sites(V.read_variants(spark, path))) == 6
    multi = V.read_variants(spark, str(vcf[0]), "sample1", biallelic_only=False, include_indels=True).where("pos = 300 and chrom = 'chr2'")
    assert sorted((r["alt"], r["GT"], r["end"]) for r in multi.collect()) == [("C", "1|2", 300), ("GTT", "1|2", 300)]
    with pytest.raises(ValueError):
        V.read_variants(spark, str(vcf[0]), "nobody")
    with pytest.raises(ValueError):
        V.read_variants(spark, "x.bcf")
    with pytest.raises(FileNotFoundError):
        V.read_variants(spark, "/nowhere/x.vcf")
    records = V.read_records(spark, str(vcf[0]))
    r = V.genotype_at(records, "chr1", 400, "sample1").first()
    assert (r["gt"], r["code"], r["alleles"], r["phased"]) == ("0|1", 1, ["T", "C"], True)
    assert not V.mostly_phased(records, "sample1")
    assert sites(V.query_region(records, "chr1", 200, 300)) == [("chr1", 200), ("chr1", 300)]
    assert ("chr1", 300) in sites(V.allele_count_filter(records, ["sample1", "sample2"]))
    assert V.variants_to_bed(V.read_variants(spark, str(vcf[0]), "sample1")).columns == ["chrom", "pos0", "end", "ref", "alt", "GT"]


def test_pgen(spark, tmp_path):
    (tmp_path / "p.pvar").write_text("#CHROM\tPOS\tID\tREF\tALT\n1\t100\ta\tA\tG\n2\t50\tb\tC\tT\n")
    (tmp_path / "p.psam").write_text("#IID\tSEX\ns1\t1\ns2\t2\ns3\t1\ns4\t2\ns5\t1\n")
    calls = [[0, 1, 2, 3, 1], [1, 1, 0, 0, 2]]
    rows = b"".join(bytes(sum(c << (2 * k) for k, c in enumerate(row[i : i + 4])) for i in (0, 4)) for row in calls)
    (tmp_path / "p.pgen").write_bytes(b"\x6c\x1b\x02" + struct.pack("<II", 2, 5) + b"\x40" + rows)
    df = V.read_variants(spark, str(tmp_path / "p.pgen"), ["s2"])
    assert sorted((r["chrom"], r["pos"], r["GT"]) for r in df.collect()) == [("chr1", 100, "0/1"), ("chr2", 50, "0/1")]
    assert sites(V.read_variants(spark, str(tmp_path / "p.pgen"), ["s1"])) == [("chr2", 50)]


def bam_bytes(rows, names=("c",)):
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(names))
    for n in names:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000)
    for qname, flag, pos, cigar, seq, qual, cb in rows:
        ops = [(int(n), A.OPS.index(op)) for n, op in A_OPS(cigar)]
        packed = bytearray()
        for i in range(0, len(seq), 2):
            packed.append(A.BASES.index(seq[i]) << 4 | (A.BASES.index(seq[i + 1]) if i + 1 < len(seq) else 0))
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(qname) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + qname.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | op) for n, op in ops) + bytes(packed) + bytes(ord(c) - 33 for c in qual)
        body += (b"CBZ" + cb.encode() + b"\0" if cb else b"") + b"NMi" + struct.pack("<i", 2) + b"xaBs" + struct.pack("<Ihh", 2, -1, 3)
        out += struct.pack("<i", len(body)) + body
    return out


def A_OPS(cigar):
    import re

    return re.findall(r"(\d+)([MIDNSHP=X])", cigar)


def test_bam_and_sam(spark, tmp_path):
    raw = bam_bytes([("q1", 67, 10, "4M1I2M", "ACGTACG", "ABCDEFG", "AA-1"), ("q2", 4, -1, "", "ACN", "###", None)])
    blocks = b""
    for part in (raw[:50], raw[50:], b""):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        blocks += z.compress(part) + z.flush()
    (tmp_path / "a.bam").write_bytes(blocks)
    bam = A.read_alignments(spark, str(tmp_path / "a.bam")).orderBy("file_order").collect()
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nq1\t67\tc\t11\t60\t4M1I2M\t*\t0\t0\tACGTACG\tABCDEFG\tCB:Z:AA-1\tNM:i:2\txa:B:s,-1,3\nq2\t4\tc\t0\t60\t*\t*\t0\t0\tACN\t###\n")
    sam = A.read_alignments(spark, str(tmp_path / "a.sam")).orderBy("file_order").collect()
    keys = ("qname", "flag", "chrom", "pos0", "mapq", "cigar", "seq", "qual", "cb")
    assert [[r[k] for k in keys] for r in bam] == [[r[k] for k in keys] for r in sam]
    assert bam[0]["tags"] == {"CB": "AA-1", "NM": "2", "xa": "-1,3"}
    with pytest.raises(ValueError):
        list(A.decode_bam(open(tmp_path / "a.sam", "rb")))


def test_regions_and_genes(spark, tmp_path):
    (tmp_path / "r.bed").write_text("c\t0\t50\tone\nc\t40\t90\n")
    assert [r["region"] for r in T.read_regions(spark, str(tmp_path / "r.bed")).collect()] == ["one", "c_40_90"]
    gtf = '#!x\nc\tt\tgene\t11\t50\t.\t+\t.\tgene_id "G1"; gene_name "N1";\nc\tt\texon\t11\t20\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; exon_id "E1";\n'
    (tmp_path / "g.gtf").write_text(gtf)
    g = T.read_genes(spark, str(tmp_path / "g.gtf"))
    assert (g.feature, g.attribute, g.parent) == ("gene", "gene_id", "groupby_gene_id")
    assert tuple(g.table.first()) == ("c", 10, 50, "G1", "G1")
    g = T.read_genes(spark, str(tmp_path / "g.gtf"), feature="exon")
    assert tuple(g.table.first()) == ("c", 10, 20, "E1", "T1")
    with pytest.raises(ValueError):
        T.is_gene_file("x.txt")


def test_small_tables(spark, tmp_path):
    (tmp_path / "b.txt").write_text("AA\nCC\n\nGG\n")
    assert [tuple(r) for r in T.read_barcodes(spark, str(tmp_path / "b.txt")).collect()] == [("AA", 0), ("CC", 1), ("GG", 2)]
    (tmp_path / "m.tsv").write_text("donor_id\tvcf_sample\tbam\nd2\ts2\tb.bam\nd1\ts1\ta.bam\n")
    assert [r["donor_id"] for r in T.read_manifest(spark, str(tmp_path / "m.tsv")).collect()] == ["d1", "d2"]
    (tmp_path / "bad.tsv").write_text("donor_id\tvcf_sample\tbam\nd1\ts1\ta.bam\nd1\ts2\tb.bam\n")
    with pytest.raises(ValueError):
        T.read_manifest(spark, str(tmp_path / "bad.tsv"))
    (tmp_path / "c.tsv").write_text("chrom\tpos\tref_count\talt_count\nc\t5\t1\t2\n\nc\t6\t\t1\n")
    df = T.read_counts(spark, str(tmp_path / "c.tsv"))
    assert df.where("pos = 5").first()["alt_count"] == 2
    with pytest.raises(Exception, match="ref_count"):
        df.collect()
    (tmp_path / "s.csv").write_text("sample,bam\na,x\na,y\n")
    with pytest.raises(ValueError):
        T.read_sample_sheet(spark, str(tmp_path / "s.csv"), ("sample", "bam"))


def test_intersections_and_state(spark, tmp_path):
    (tmp_path / "i.bed").write_text("c\t5\t15\tq/1\t60\t+\tc\t7\t8\tA\tG\t0|1\n" * 2)
    assert [(r["read"], r["mate"], r["GT"]) for r in T.read_intersections(spark, str(tmp_path / "i.bed")).collect()] == [("q", 1, "0|1")]
    files.write_state(spark, {"a": [1]}, str(tmp_path / "s"))
    assert files.read_state(spark, str(tmp_path / "s")) == {"a": [1]}


def sam_line(q, flag, pos1, seq, cb="x"):
    return f"{q}\t{flag}\tchr1\t{pos1}\t60\t{len(seq)}M\t=\t{pos1}\t0\t{seq}\t{'F' * len(seq)}\tCB:Z:{cb}\n"


def test_count_and_imbalance_end_to_end(spark, tmp_path, vcf):
    sam = tmp_path / "a.sam"
    sam.write_text("".join(sam_line(f"q{i}", 67, 95, "AAAAA" + "AG"[i % 3 == 0] + "AAAA") for i in range(12)))
    (tmp_path / "r.bed").write_text("chr1\t50\t150\tpeak\nchr1\t90\t120\tinner\n")
    out = w.count_variants(spark, str(sam), str(vcf[0]), "sample1", str(tmp_path / "r.bed"))
    rows = {r["region"]: (r["ref_count"], r["alt_count"], r["other_count"]) for r in out.collect()}
    assert rows == {"peak": (8, 4, 0), "inner": (8, 4, 0)}
    files.write_tsv(out, str(tmp_path / "counts"), single=True)
    (table,) = (tmp_path / "counts").glob("part-*")
    res = w.find_imbalance(spark, str(table), min_count=1, groupby="region").collect()
    assert {r["region"] for r in res} == {"peak", "inner"} and res[0]["ref_count"] == 8
    (tmp_path / "bc.txt").write_text("x\n")
    data = w.count_cells(spark, str(sam), str(vcf[0]), str(tmp_path / "bc.txt"), "sample1", str(tmp_path / "r.bed"))
    assert [(r["ref"], r["alt"]) for r in data["coo"].collect()] == [(8, 4)]
    files.write_cells(str(tmp_path / "cells"), data["coo"], data["snps"], data["cells"], data["features"])
    assert files.read_cells(spark, str(tmp_path / "cells"))["stats"].first()["reads"] == 12
    groups = spark.createDataFrame([("x", "T")], "barcode string, group string")
    assert w.find_imbalance_cells(data, groups, min_count=1).count() == 2
    with pytest.raises(ValueError):
        w.labelled_cells(data["cells"], groups, ["B"])


def test_command_line(spark, tmp_path, vcf):
    from phasewise import cli

    sam, out = tmp_path / "a.sam", tmp_path / "out"
    sam.write_text("".join(sam_line(f"q{i}", 67, 95, "AAAAA" + "AG"[i % 3 == 0] + "AAAA") for i in range(12)))
    (tmp_path / "r.bed").write_text("chr1\t50\t150\tpeak\n")
    (tmp_path / "bc.txt").write_text("x\n")
    (tmp_path / "map.tsv").write_text("x\tT/1\n")
    cli.main(["count-variants", str(sam), str(vcf[1]), "--samples", "sample1", "--regions", str(tmp_path / "r.bed"), "--out", f"{out}/counts"])
    cli.main(["find-imbalance", f"{out}/counts", "--min-count", "1", "--out", f"{out}/imbalance"])
    assert "peak\t8\t4\t12\t1" in "".join(p.read_text() for p in (out / "imbalance").glob("part-*"))
    cli.main(["count-variants-sc", str(sam), str(vcf[0]), str(tmp_path / "bc.txt"), "--samples", "sample1", "--regions", str(tmp_path / "r.bed"), "--out", f"{out}/cells"])
    cli.main(["find-imbalance-sc", f"{out}/cells", str(tmp_path / "map.tsv"), "--min-count", "1", "--out", f"{out}/groups"])
    assert [p.name for p in (out / "groups").glob("group_=*")] == ["group_=T-1"]


def test_cells_without_regions(spark, tmp_path, vcf):
    from phasewise import cli

    sam, out = tmp_path / "a.sam", tmp_path / "out"
    sam.write_text("".join(sam_line(f"q{i}", 67, 95, "AAAAA" + "AG"[i % 3 == 0] + "AAAA") for i in range(12)))
    (tmp_path / "r.bed").write_text("chr1\t50\t150\tpeak\n")
    (tmp_path / "bc.txt").write_text("x\n")
    (tmp_path / "map.tsv").write_text("x\tT\n")
    count = ["count-variants-sc", str(sam), str(vcf[0]), str(tmp_path / "bc.txt"), "--samples", "sample1", "--out", f"{out}/cells"]
    test = ["find-imbalance-sc", f"{out}/cells", str(tmp_path / "map.tsv"), "--min-count", "1", "--out", f"{out}/groups"]
    for regions, want in ((["--regions", str(tmp_path / "r.bed")], "peak"), ([], "chr1_")):
        cli.main(count + regions)
        cli.main(test)
        # The regions of an earlier run are gone.
        lines = [x for p in (out / "groups").rglob("part-*.csv") for x in p.read_text().splitlines()[1:]]
        assert lines and all(x.split("\t")[1].startswith(want) for x in lines)
    store = files.read_cells(spark, f"{out}/cells")
    assert set(store) == {"coo", "snps", "cells", "features", "stats"} and "ref_count" in store["snps"].columns


def test_mates_are_in_step_in_every_file(spark, tmp_path):
    n = 3000
    rows = [(f"n{i}", "A" * (i % 7 + 1), "F" * (i % 7 + 1), False, "C" * 400, "F" * 400, i % 2 == 0) for i in range(n)]
    copies = spark.createDataFrame(rows, "name string, seq1 string, qual1 string, reverse1 boolean, seq2 string, qual2 string, reverse2 boolean").repartition(9)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        files.write_fastq(copies, str(tmp_path / "fq"), compression="none")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    names = [[[x[1:-2] for x in p.read_text().splitlines()[::4]] for p in sorted((tmp_path / "fq" / f"r{i}").glob("part-*"))] for i in (1, 2)]
    assert len(names[0]) == 13 and names[0] == names[1] and sum(map(len, names[0])) == n


def test_make_reads_and_fastq(spark, tmp_path):
    (tmp_path / "p.vcf").write_text(VCF.splitlines()[0] + "\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\nchr1\t100\t.\tA\tG\t.\t.\t.\tGT\t0|1\n")
    (tmp_path / "a.sam").write_text(sam_line("q", 99, 96, "AAAAAAAC") + sam_line("q", 147, 97, "AAAAAACC") + sam_line("z", 99, 500, "AAAA") + sam_line("z", 147, 520, "AAAA"))
    d = w.make_reads(spark, str(tmp_path / "a.sam"), str(tmp_path / "p.vcf"), "s")
    assert {r["qname"] for r in d["to_remap"].collect()} == {"q"} and {r["qname"] for r in d["keep"].collect()} == {"z"}
    files.write_fastq(d["copies"], str(tmp_path / "fq"), compression="none")
    r1, r2 = ("".join(p.read_text() for p in sorted((tmp_path / "fq" / f"r{i}").glob("part-*"))) for i in (1, 2))
    assert r1 == "@q_SWAP_95_96_1_1/1\nAAAAGAAC\n+\nFFFFFFFF\n"
    assert r2.splitlines()[1] == "GGTTCTTT"
    files.write_positions(d["copies"], str(tmp_path / "pos"))
    assert {tuple(r) for r in T.read_positions(spark, str(tmp_path / "pos")).collect()} == {("q_SWAP_95_96_1_1/1", 1, 95, 96), ("q_SWAP_95_96_1_1/2", 2, 95, 96)}


def test_bundle(spark, tmp_path):
    part = spark.createDataFrame([("c", 5, "A", "G", "p1", 1, 2, 0), ("c", 5, "A", "G", "p2", 1, 2, 0)], "chrom string, pos long, ref string, alt string, region string, ref_count long, alt_count long, other_count long")
    counts = bundle.cohort_counts({"d1": part, "d2": part}, region=True)
    donors = spark.createDataFrame([("d1", "s1", "a"), ("d2", "s2", "b")], "donor_id string, vcf_sample string, bam string")
    path = str(tmp_path / "b")
    m = bundle.write_bundle(counts, donors, path)
    assert (m["rows"], m["donors"]) == (4, 2) and bundle.verify_bundle(spark, path) == m
    with pytest.raises(FileExistsError):
        bundle.write_bundle(counts, donors, path)
    manifest = tmp_path / "b" / "count_manifest.json"
    manifest.write_text(json.dumps(m | {"rows": 5}))
    (tmp_path / "b" / ".count_manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(bundle.BundleError):
        bundle.verify_bundle(spark, path)
    bad = bundle.cohort_counts({"d1": part.union(part.withColumn("ref_count", F.col("ref_count") + 1).withColumn("region", F.lit("p3")))}, region=True)
    with pytest.raises(bundle.BundleError):
        bundle.write_bundle(bad, donors, str(tmp_path / "c"))
    assert not (tmp_path / "c").exists() and not list(tmp_path.glob("c.staging*"))


def test_cells(spark):
    coo = spark.createDataFrame([(s, c, 3 + s % 2 * (c % 2) * 9, 3, 0) for s in range(8) for c in range(10)], "snp_idx long, bc_idx long, ref long, alt long, other long")
    cell = spark.createDataFrame([(c, f"g{c % 2}") for c in range(10)], "bc_idx long, group string")
    snps, features = spark.range(8).select(F.col("id").alias("snp_idx")), spark.range(8).select((F.col("id") % 2).cast("string").alias("region"), F.col("id").alias("snp_idx"))
    r = {(x["group"], x["region"]): x for x in cells.find_imbalance_groups(coo, snps, features, cell).collect()}
    assert len(r) == 4 and r["g1", "1"]["pval"] < r["g0", "1"]["pval"]
    cmp = {x["region"]: x for x in cells.compare_groups(coo, snps, features, cell).collect()}
    assert cmp["1"]["pval"] < cmp["0"]["pval"] and cmp["0"]["num_snps"] == 4
    assert cells.compare_groups(coo, snps, features, cell, shared_snps=False).count() == 2
    one = cells.find_imbalance_groups(coo.where("snp_idx = 1"), snps, features, cell).where("group = 'g1'").first()
    assert one["mu"] == pytest.approx(61 / 77)


def test_expression(spark):
    c = spark.createDataFrame([("c", 1, "g", 18, 2), ("c", 2, "g", 10, 10), ("c", 3, "h", 0, 0)], "chrom string, pos long, gene_id string, ref_count long, alt_count long")
    m = {r["pos"]: r for r in expression.mono_allelic(c).collect()}
    assert set(m) == {1, 2} and m[1]["mae_status"] == "MAE_REF" and m[1]["significant"] and m[2]["pvalue"] == 1.0
    g = {r["gene_id"]: r for r in expression.gene_counts(c).collect()}
    assert (g["g"]["total_count"], g["h"]["alt_ratio"]) == (40, 0.0)


def test_stream_equals_batch(spark, tmp_path):
    from tests.test_reads import READS, VARIANTS, read, variant

    reads = [read(f"q{i % 7}", i, 10 * (i % 9), seq="AG"[i % 2] * 10) for i in range(40)]
    df = spark.createDataFrame(reads, READS).coalesce(1)
    for i in range(4):
        df.where(f"file_order div 10 = {i}").write.mode("append").parquet(str(tmp_path / "in"))
    v = spark.createDataFrame([variant(p) for p in (5, 33, 34, 71)], VARIANTS)
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.count_stream(stream, v, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination(60)
    got = incremental.counts(spark, str(tmp_path / "state")).agg(F.sum("ref_count"), F.sum("alt_count")).first()
    want = counting.count_bulk(df, v).agg(F.sum("ref_count"), F.sum("alt_count")).first()
    assert sum(got) == sum(want)


def test_windowed_counts_on_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2020-01-01 00:01:00' as ts, 'a' as event_type, 1.0D as value").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = incremental.windowed_counts(s).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").first()["n"] == 1
