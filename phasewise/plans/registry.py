"""Queries over the driver's tables, one for each family of operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions import columns as C
from phasewise.operators import cells as cell_ops
from phasewise.operators import counting, expression, imbalance, pairs, rewrite
from phasewise.operators.fdr import bh_adjust
from phasewise.operators.interval_join import clipped, first_gene, interval_join
from phasewise.plans import adapters as A
from phasewise.sources import variants as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "find_imbalance_region"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Variants ------------------------------------------------------------------------


@query(f"""
SELECT c_custkey AS k, gt, CAST(CASE gt WHEN './.' THEN -1 WHEN '1/1' THEN 2 ELSE 1 END AS TINYINT) AS code, gt IN ('0|1', '1|0', '0/1') AS het,
  contains(gt, '|') AS phased, CAST(CASE gt WHEN '0|1' THEN 0 WHEN '1|0' THEN 1 ELSE -1 END AS TINYINT) AS phase,
  CASE gt WHEN '0|1' THEN 'AG' WHEN '0/1' THEN 'AG' WHEN '1|0' THEN 'GA' WHEN '1/1' THEN 'GG' END AS alleles
FROM (SELECT c_custkey, {A.GT_CASE.format(k="c_custkey")} AS gt FROM customer)""")
def genotype_classes(spark, sf_dir):
    """Genotype parsing: class, heterozygosity, phase and bases."""
    k = F.col("c_custkey")
    gt = F.element_at(F.array(*map(F.lit, ("0|1", "1|0", "0/1", "1/1", "./."))), (k % 5 + 1).cast("int"))
    d = A.table(spark, sf_dir, "customer").select(k.alias("k"), gt.alias("gt"))
    g = F.col("gt")
    bases = F.array_join(C.alleles(g, F.lit("A"), F.array(F.lit("G"))), "")
    return d.select("k", "gt", C.genotype_code(g).alias("code"), C.is_het(g, F.lit(1)).alias("het"), C.is_phased(g).alias("phased"), F.coalesce(C.phase(g), F.lit(-1).cast("byte")).alias("phase"), bases.alias("alleles"))


def _records(spark, sf_dir):
    k = F.col("p_partkey")
    ref = F.when(k % 7 == 0, "AT").otherwise("A")
    alts = F.when(k % 3 == 0, F.array(F.lit("G"), F.lit("T"))).when(k % 5 == 0, F.array(F.lit("ACC"))).otherwise(F.array(F.lit("C")))
    pos0 = (k * 10).cast("long")
    d = A.table(spark, sf_dir, "part").select(F.lit("chr1").alias("chrom"), pos0.alias("pos0"), (pos0 + 1).alias("pos"), (pos0 + F.length(ref)).alias("end"), k.cast("string").alias("id"), ref.alias("ref"), alts.alias("alts"))
    gt = F.element_at(F.array(*map(F.lit, ("0|1", "1|0", "0/2", "1/1", "./.", "1|2"))), (F.col("id").cast("long") % 6 + 1).cast("int"))
    return d.withColumn("GT", F.create_map(F.lit("s1"), gt))


_RECORDS_SQL = """
WITH r AS (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'AT' ELSE 'A' END AS ref,
    CASE WHEN p_partkey % 3 = 0 THEN ['G', 'T'] WHEN p_partkey % 5 = 0 THEN ['ACC'] ELSE ['C'] END AS alts,
    CASE p_partkey % 6 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' WHEN 2 THEN '0/2' WHEN 3 THEN '1/1' WHEN 4 THEN './.' ELSE '1|2' END AS gt
  FROM part
), x AS (SELECT *, unnest(alts) AS alt, unnest(generate_series(1, len(alts))) AS i FROM r)
"""


@query(_RECORDS_SQL + """
SELECT CAST(k * 10 AS BIGINT) AS pos0, CAST(k * 10 + length(ref) AS BIGINT) AS "end", ref, alt, gt AS "GT" FROM x
WHERE gt <> './.' AND gt <> '1/1' AND contains(gt, CAST(i AS VARCHAR)) AND (length(ref) = 1 AND length(alt) = 1 OR abs(length(ref) - length(alt)) <= 2)""")
def multiallelic_het_variants(spark, sf_dir):
    """A row for each ALT that the sample is heterozygous for, indels too."""
    v = V.records_to_variants(_records(spark, sf_dir), ["s1"], biallelic_only=False, include_indels=True, max_indel_len=2)
    return v.select("pos0", "end", "ref", "alt", "GT")


@query(_RECORDS_SQL + """
SELECT CAST(k * 10 AS BIGINT) AS pos0, ref, alt FROM x WHERE len(alts) = 1 AND length(ref) = 1 AND length(alt) = 1""")
def biallelic_snvs(spark, sf_dir):
    """Biallelic single-base variants without a sample."""
    return V.records_to_variants(_records(spark, sf_dir)).select("pos0", "ref", "alt")


@query("""
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'chr' || CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 3 = 1 THEN 'chrX' ELSE 'GL' || CAST(s_suppkey AS VARCHAR) END AS chrom,
  'c_' || CAST(s_suppkey AS VARCHAR) AS v, 'c_1_' || CAST(s_suppkey AS VARCHAR) AS i, 'c:' || CAST(s_suppkey AS VARCHAR) || ':A>G' AS s FROM supplier""")
def names_and_labels(spark, sf_dir):
    """Chromosome names with their prefix; labels of variants and intervals."""
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "X").otherwise(F.concat(F.lit("GL"), k))
    c = F.lit("c")
    return A.table(spark, sf_dir, "supplier").select(k.alias("k"), C.with_chr(raw).alias("chrom"), C.variant_label(c, k).alias("v"), C.interval_label(c, F.lit(1), k).alias("i"), C.snp_id(c, k, F.lit("A"), F.lit("G")).alias("s"))


@query("""
SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN v + w <= 40 THEN 'upstream' WHEN v >= 40 + CAST(l_quantity AS INT) THEN 'downstream' WHEN v < 40 THEN 'spans_start' ELSE 'within' END AS place
FROM (SELECT *, l_partkey % 97 AS v, 1 + l_suppkey % 9 AS w FROM lineitem)""")
def variant_places(spark, sf_dir):
    """Where variants lie relative to a read."""
    v, w = F.col("l_partkey") % 97, 1 + F.col("l_suppkey") % 9
    d = A.table(spark, sf_dir, "lineitem")
    return d.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), C.location(F.lit(40), F.lit(40) + F.col("l_quantity").cast("int"), v, v + w).alias("place"))


# Interval joins --------------------------------------------------------------------


@query(f"""
WITH {A.READS_SQL}, {A.REGIONS_SQL}
SELECT r.qname, r.chrom, r.pos0, g.region, CAST(greatest(r.pos0, g."start") AS BIGINT) AS from_pos, CAST(least(r.pos0 + r.len, g."end") AS BIGINT) AS to_pos
FROM reads r JOIN regions g ON r.chrom = g.chrom AND r.pos0 < g."end" AND g."start" < r.pos0 + r.len""")
def interval_overlaps(spark, sf_dir):
    """Reads and regions that share a base, cut to what they share."""
    r = A.reads(spark, sf_dir).withColumn("stop", F.col("pos0") + C.reference_length(F.col("cigar"))).select("qname", "chrom", "pos0", F.col("pos0").alias("from_pos"), F.col("stop").alias("to_pos"))
    g = A.regions(spark, sf_dir).select(F.col("chrom").alias("g"), "start", "end", "region")
    hits = interval_join(r, g, ("chrom", "from_pos", "to_pos"), ("g", "start", "end"), 1024)
    return clipped(hits, ("from_pos", "to_pos"), ("start", "end")).select("qname", "chrom", "pos0", "region", "from_pos", "to_pos")


@query(f"""
WITH {A.READS_SQL}, {A.POINTS_SQL}, n AS (
  SELECT DISTINCT qname FROM reads r JOIN points p ON r.chrom = p.chrom AND p.pos0 >= r.pos0 AND p.pos0 < r.pos0 + r.len WHERE r.flag <> 4
)
SELECT CASE WHEN qname IN (SELECT qname FROM n) THEN 'remap' ELSE 'keep' END AS part, chrom, count(*) AS n FROM reads GROUP BY ALL""")
def split_by_variants(spark, sf_dir):
    """All records of names that overlap a variant, and the others."""
    remap, keep = pairs.split_by_overlap(A.reads(spark, sf_dir), A.points(spark, sf_dir))
    both = remap.select(F.lit("remap").alias("part"), "chrom").union(keep.select(F.lit("keep").alias("part"), "chrom"))
    return both.groupBy("part", "chrom").agg(F.count("*").alias("n"))


@query(f"""
WITH {A.READS_SQL}, {A.POINTS_SQL}
SELECT DISTINCT r.qname AS read, r.chrom, r.pos0 AS start, CASE WHEN flag = 67 THEN 1 ELSE 2 END AS mate, p.pos0 AS v_pos0, p.ref, p.alt
FROM reads r JOIN points p ON r.chrom = p.chrom AND p.pos0 >= r.pos0 AND p.pos0 < r.pos0 + r.len WHERE flag <> 4
QUALIFY row_number() OVER (PARTITION BY r.qname, mate, r.chrom, p.pos0, p.ref, p.alt ORDER BY r.pos0) = 1""")
def read_variant_pairs(spark, sf_dir):
    """Reads and the variants they overlap, each once for a mate; the first start of equal ones."""
    hits = pairs.read_variants(A.reads(spark, sf_dir), A.points(spark, sf_dir))
    return hits.select("read", "chrom", "start", "mate", "v_pos0", "ref", "alt")


@query(f"""
WITH {A.POINTS_SQL}, {A.REGIONS_SQL}
SELECT chrom, pos, ref, alt, gene_id FROM (
  SELECT p.chrom, p.pos, p.ref, p.alt, g.region AS gene_id, row_number() OVER (PARTITION BY p.chrom, p.pos ORDER BY g.ord) AS n,
    min(g.ord) OVER (PARTITION BY p.chrom, p.pos) AS low, g.ord FROM points p JOIN regions g ON p.chrom = g.chrom AND p.pos BETWEEN g."start" AND g."end"
) WHERE ord = low""")
def first_gene_of_variant(spark, sf_dir):
    """The first gene in file order whose closed range holds a variant."""
    g = A.regions(spark, sf_dir).select(F.col("chrom").alias("seqname"), "start", "end", F.col("region").alias("gene_id"), F.col("ord").alias("gene_order"))
    return first_gene(A.points(spark, sf_dir).select("chrom", "pos", "ref", "alt"), g)


@query(f"""
WITH {A.POINTS_SQL}, {A.REGIONS_SQL}
SELECT p.chrom, p.pos0, p.ref, p.alt FROM points p WHERE EXISTS (SELECT 1 FROM regions g WHERE p.chrom = g.chrom AND p.pos0 >= g."start" AND p.pos0 < g."end")""")
def snps_in_peaks(spark, sf_dir):
    return expression.snps_in_peaks(A.points(spark, sf_dir), A.regions(spark, sf_dir)).select("chrom", "pos0", "ref", "alt")


# Counting -------------------------------------------------------------------------


_HITS_SQL = f"""
WITH {A.READS_SQL}, {A.POINTS_SQL}, v AS (
  SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY chrom, pos0 ORDER BY ref, alt) = 1
), hits AS (
  SELECT r.chrom, r.qname, r.file_order, r.copy, r.base, p.pos0, p.ref, p.alt FROM reads r JOIN v p ON r.chrom = p.chrom AND p.pos0 >= r.pos0 AND p.pos0 < r.pos0 + r.len WHERE flag <> 4
), best AS (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY chrom, qname, file_order, copy ORDER BY pos0) = 1
), once AS (
  SELECT *, CASE WHEN base = ref THEN 'ref' WHEN base = alt THEN 'alt' ELSE 'other' END AS cls FROM best QUALIFY row_number() OVER (PARTITION BY chrom, qname ORDER BY file_order, copy) = 1
)"""


@query(_HITS_SQL + """
SELECT p.chrom, p.pos0, p.ref, p.alt, CAST(count(*) FILTER (cls = 'ref') AS BIGINT) AS ref_count, CAST(count(*) FILTER (cls = 'alt') AS BIGINT) AS alt_count, CAST(count(*) FILTER (cls = 'other') AS BIGINT) AS other_count
FROM (SELECT DISTINCT chrom, pos0, ref, alt FROM points) p LEFT JOIN once o ON p.chrom = o.chrom AND p.pos0 = o.pos0 GROUP BY ALL""")
def count_bulk(spark, sf_dir):
    """Alleles at every variant; a read name counts once on a chromosome."""
    v = A.points(spark, sf_dir).distinct()
    return counting.count_bulk(A.reads(spark, sf_dir), v).select("chrom", "pos0", "ref", "alt", "ref_count", "alt_count", "other_count")


@query(f"""
WITH {A.READS_SQL}, {A.POINTS_SQL}, v AS (
  SELECT chrom, pos0, min(ref || alt) AS ra FROM points GROUP BY ALL
), w AS (SELECT chrom, pos0, substr(ra, 1, 1) AS ref, substr(ra, 2, 1) AS alt, CAST(row_number() OVER (ORDER BY chrom, pos0) - 1 AS BIGINT) AS snp_idx FROM v),
 c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 50 AS bc, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_extendedprice) AS copy FROM lineitem),
 once AS (
  SELECT p.snp_idx, CAST(bc AS BIGINT) AS bc_idx, CASE WHEN base = ref THEN 'ref' WHEN base = alt THEN 'alt' ELSE 'other' END AS cls
  FROM reads r JOIN c ON r.file_order = c.l_orderkey * 1000000 + c.l_linenumber * 100000 + c.l_partkey AND r.copy = c.copy
  JOIN w p ON r.chrom = p.chrom AND p.pos0 >= r.pos0 AND p.pos0 < r.pos0 + r.len WHERE flag <> 4 AND bc < 40
  QUALIFY row_number() OVER (PARTITION BY r.chrom, r.qname ORDER BY snp_idx, r.file_order, r.copy) = 1
)
SELECT snp_idx, bc_idx, CAST(count(*) FILTER (cls = 'ref') AS BIGINT) AS ref, CAST(count(*) FILTER (cls = 'alt') AS BIGINT) AS alt, CAST(count(*) FILTER (cls = 'other') AS BIGINT) AS other FROM once GROUP BY ALL""")
def count_cells(spark, sf_dir):
    """Alleles at every variant in every listed cell."""
    v = A.points(spark, sf_dir).groupBy("chrom", "pos0").agg(F.min(F.concat("ref", "alt")).alias("ra"))
    v = v.select("chrom", "pos0", F.substring("ra", 1, 1).alias("ref"), F.substring("ra", 2, 1).alias("alt"))
    v = cell_ops.dense_index(v, ["chrom", "pos0"], "snp_idx")
    barcodes = spark.range(40).select(F.col("id").cast("string").alias("barcode"), F.col("id").alias("bc_idx"))
    return counting.count_cells(A.cell_reads(spark, sf_dir), v, barcodes)


@query(f"""
WITH {A.READS_SQL}, {A.POINTS_SQL}
SELECT r.qname, CAST(max(CASE WHEN p.pos % 3 > 0 THEN 1 ELSE 0 END) + 2 * max(CASE WHEN p.pos % 3 = 0 THEN 1 ELSE 0 END) AS TINYINT) AS mask
FROM reads r JOIN points p ON r.chrom = p.chrom AND p.pos0 >= r.pos0 AND p.pos0 < r.pos0 + r.len WHERE flag <> 4 GROUP BY r.qname""")
def overlap_masks(spark, sf_dir):
    """Which kinds of variants each name overlaps; every third place stands for an indel."""
    v = A.points(spark, sf_dir).select(F.col("chrom").alias("v_chrom"), F.col("pos0").alias("v_pos0"), F.col("end").alias("v_end"))
    return pairs.overlap_masks(A.reads(spark, sf_dir), v, (F.col("v_pos0") + 1) % 3 == 0)


@query(f"""
WITH {A.READS_SQL}, {A.POINTS_SQL}, c AS (SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS fo, l_suppkey % 50 AS bc, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_extendedprice) AS copy FROM lineitem),
h AS (SELECT r.chrom, r.qname, bc FROM reads r JOIN c ON r.file_order = c.fo AND r.copy = c.copy JOIN (SELECT DISTINCT chrom, pos0 FROM points) p ON r.chrom = p.chrom AND p.pos0 >= r.pos0 AND p.pos0 < r.pos0 + r.len WHERE flag <> 4)
SELECT chrom, CAST(0 AS BIGINT) AS no_barcode, CAST(count(*) FILTER (bc >= 40) AS BIGINT) AS unlisted_barcode, CAST(0 AS BIGINT) AS no_base,
  CAST(count(DISTINCT qname) FILTER (bc < 40) AS BIGINT) AS counted, CAST(count(*) FILTER (bc < 40) - count(DISTINCT qname) FILTER (bc < 40) AS BIGINT) AS seen_before FROM h GROUP BY chrom""")
def cell_read_reasons(spark, sf_dir):
    """Why reads over variants count in cells or don't."""
    v = A.points(spark, sf_dir).select("chrom", "pos0").distinct().withColumn("snp_idx", F.col("pos0"))
    barcodes = spark.range(40).select(F.col("id").cast("string").alias("barcode"), F.col("id").alias("bc_idx"))
    return counting.cell_read_stats(A.cell_reads(spark, sf_dir), v, barcodes)


@query(f"""
WITH {A.READS_SQL}, r AS (SELECT * FROM reads WHERE flag <> 4), n AS (
  SELECT *, row_number() OVER (PARTITION BY chrom, qname ORDER BY file_order, copy) AS i FROM r
), m AS (SELECT *, count(*) OVER (PARTITION BY chrom, qname) AS c, row_number() OVER (PARTITION BY chrom, qname ORDER BY CASE WHEN flag = 67 THEN 0 ELSE 1 END, file_order, copy) AS j FROM n WHERE i <= 2)
SELECT a.chrom, a.qname, a.pos0 AS pos1, b.pos0 AS pos2 FROM m a JOIN m b ON a.chrom = b.chrom AND a.qname = b.qname AND a.j = 1 AND b.j = 2""")
def mate_pairs(spark, sf_dir):
    """The first two eligible records of each name, first mate first."""
    p = pairs.mate_pairs(A.reads(spark, sf_dir))
    return p.select("chrom", "qname", F.col("r1.pos0").alias("pos1"), F.col("r2.pos0").alias("pos2"))


@query("""
SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INT) AS len, CAST(CASE WHEN l_partkey % 40 < 5 THEN 3 + l_partkey % 40 WHEN l_partkey % 40 < 7 THEN -1
  WHEN l_partkey % 40 < 7 + CAST(l_quantity AS INT) THEN 1 + l_partkey % 40 ELSE -1 END AS BIGINT) AS q, CAST(5 + 2 + CAST(l_quantity AS INT) AS BIGINT) AS span
FROM lineitem""")
def cigar_positions(spark, sf_dir):
    """Read positions of reference positions through clips and deletions."""
    length = F.col("l_quantity").cast("int")
    cigar = F.concat(F.lit("3S5M2D"), length, F.lit("M"))
    d = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), length.alias("len"), cigar.alias("cigar"), (F.col("l_partkey") % 40 + 1000).cast("long").alias("t"))
    return d.select("k", "n", "len", F.coalesce(C.query_position(F.col("cigar"), F.lit(1000).cast("long"), F.col("t")), F.lit(-1).cast("long")).alias("q"), C.reference_length(F.col("cigar")).alias("span"))


@query("""
SELECT l_orderkey AS k, count(*) AS n, string_agg(reverse(translate(s, 'ACGT', 'TGCA')), ',' ORDER BY reverse(translate(s, 'ACGT', 'TGCA'))) AS rc
FROM (SELECT l_orderkey, repeat('AC', CAST(l_quantity AS INT) % 5) || 'GN' || l_returnflag AS s0, replace(replace(repeat('AC', CAST(l_quantity AS INT) % 5) || 'GN' || l_returnflag, 'R', 'N'), 'X', 'N') AS s FROM lineitem) GROUP BY ALL""")
def reverse_complements(spark, sf_dir):
    s = F.concat(F.expr("repeat('AC', cast(l_quantity as int) % 5)"), F.lit("GN"), "l_returnflag")
    d = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), C.reverse_complement(s).alias("r"))
    return d.groupBy("k").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("r")), ",").alias("rc"))


# Swapped reads --------------------------------------------------------------------------


def _remapped(spark, sf_dir):
    """Copies of orders as remapped pairs: of every order two copies, some moved, some lost."""
    o = A.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    c = o.select(k.alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("i")).where("not (k % 5 = 1 and i = 2)")
    k, i = F.col("k"), F.col("i")
    name = C.encode_name(k.cast("string"), k % 1000, k % 1000 + 150, i, F.lit(2))
    moved = F.when((k % 7 == 2) & (i == 1), 5).otherwise(0)
    both = c.select(name.alias("qname"), "k", F.explode(F.array(F.lit(67), F.lit(131))).alias("flag"), (k % 1000 + moved).cast("long").alias("a"), (k % 1000 + 150 + moved).cast("long").alias("b"))
    first = F.col("flag") == 67
    return both.select("qname", "flag", F.lit("chr1").alias("chrom"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("pos0"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("mate_pos0"), (F.col("k") * 10 + F.col("flag")).alias("file_order"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS orig, CASE WHEN o_orderkey % 7 = 2 THEN 'moved' WHEN o_orderkey % 5 = 1 THEN 'missing' ELSE 'kept' END AS verdict FROM orders""")
def remap_verdicts(spark, sf_dir):
    """What became of reads whose copies were aligned again."""
    return pairs.remap_verdicts(_remapped(spark, sf_dir))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS orig, CAST(o_orderkey % 1000 AS BIGINT) AS pos1, CAST(o_orderkey % 777 AS BIGINT) AS pos2, CAST(o_orderkey % 4 + 1 AS BIGINT) AS nth, CAST(4 AS BIGINT) AS total, CAST(o_orderkey % 9 AS BIGINT) AS slop FROM orders""")
def read_names(spark, sf_dir):
    """Names of copies, made and taken apart again."""
    k = F.col("o_orderkey")
    name = C.encode_name(k.cast("string"), k % 1000, k % 777, k % 4 + 1, F.lit(4), F.lit(0), F.lit(1), -(k % 9), F.lit(0))
    d = A.table(spark, sf_dir, "orders").select(C.decode_name(F.concat(name, F.lit("/1"))).alias("d"))
    return d.select("d.orig", "d.pos1", "d.pos2", "d.nth", "d.total", C.slop_of(0, F.col("d.delta1"), F.col("d.delta2")).alias("slop"))


@query()
def swapped_copies(spark, sf_dir):
    """Allele-swapped copies of read pairs."""
    k = F.col("chrom")
    reads = A.reads(spark, sf_dir)
    v = A.points(spark, sf_dir).dropDuplicates(["chrom", "pos0"]).withColumn("GT", F.when(F.length(k) == 4, "0|1").otherwise("1|0"))
    return rewrite.make_copies(reads, v).select("qname", "chrom", "outcome", "name", "seq1", "seq2", "overlap_mask")


# Statistics ---------------------------------------------------------------------------------


@query()
def find_imbalance_region(spark, sf_dir):
    """Imbalance by region, one dispersion."""
    return imbalance.find_imbalance(A.counts(spark, sf_dir))


@query()
def find_imbalance_phased(spark, sf_dir):
    return imbalance.find_imbalance(A.counts(spark, sf_dir), phased=True)


@query()
def find_imbalance_variant(spark, sf_dir):
    return imbalance.find_imbalance(A.counts(spark, sf_dir), region=None)


@query()
def find_imbalance_linear(spark, sf_dir):
    return imbalance.find_imbalance(A.counts(spark, sf_dir), model="linear")


@query()
def find_imbalance_per_donor(spark, sf_dir):
    c = A.counts(spark, sf_dir).withColumn("donor_id", F.concat(F.lit("d"), F.col("pos") % 5))
    return imbalance.find_imbalance(c, model="per_donor", region="region")


_PMF = "(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0) + lgamma({k} + {a}) + lgamma({n} - {k} + {b}) - lgamma({n} + {a} + {b}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}))"


@query(f"""
WITH {A.COUNTS_SQL}, x AS (SELECT region, ref_count + 1 AS k, ref_count + alt_count + 2 AS n, ref_count, alt_count FROM counts WHERE ref_count + alt_count >= 10)
SELECT region, CAST(sum(ref_count) AS BIGINT) AS ref_count, CAST(sum(alt_count) AS BIGINT) AS alt_count, count(*) AS snp_count, round(sum({_PMF.format(k="k", n="n", a="4.5", b="4.5")}), 6) AS null_ll FROM x GROUP BY region""")
def null_likelihoods(spark, sf_dir):
    """Sums and null log-likelihoods of regions at a given dispersion."""
    rows = imbalance.prepared(A.counts(spark, sf_dir), "region", 10, 1, False, True, None).withColumn("rho", F.lit(0.1))
    sums = rows.groupBy("region").agg((F.sum("ref") - F.count("*")).alias("ref_count"), (F.sum("alt") - F.count("*")).alias("alt_count"))
    return sums.join(imbalance.fit_regions(rows, False), "region").select("region", "ref_count", "alt_count", "snp_count", F.round("null_ll", 6).alias("null_ll"))


def _golden_sql() -> str:
    nll = lambda m: "-" + _PMF.format(k="k", n="n", a=f"({m} * 9.0)", b=f"((1 - {m}) * 9.0)")
    g = "0.6180339887498949"
    return f"""
WITH RECURSIVE {A.COUNTS_SQL}, x AS (SELECT DISTINCT ref_count + 1 AS k, ref_count + alt_count + 2 AS n FROM counts WHERE ref_count + alt_count >= 10),
s AS (
  SELECT k, n, 0 AS i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS h, (1 - {g})::DOUBLE AS c, {g}::DOUBLE AS d, {nll(f"(1 - {g})")} AS fc, {nll(g)} AS fd FROM x
  UNION ALL
  SELECT k, n, i + 1, a, h, c, d, CASE WHEN l THEN {nll("c")} ELSE fc0 END, CASE WHEN l THEN fd0 ELSE {nll("d")} END FROM (
    SELECT k, n, i, fc < fd AS l, CASE WHEN fc < fd THEN a ELSE c END AS a, h * {g} AS h,
      CASE WHEN fc < fd THEN a + (1 - {g}) * h * {g} ELSE d END AS c, CASE WHEN fc < fd THEN c ELSE c + {g} * h * {g} END AS d, fd AS fc0, fc AS fd0
    FROM s WHERE h > 1e-6)
)
SELECT CAST(k AS BIGINT) AS ref, CAST(n AS BIGINT) AS n, round(CASE WHEN fc < fd THEN c ELSE d END, 4) AS mu, round(-least(fc, fd), 6) AS alt_ll FROM s WHERE h <= 1e-6"""


@query(_golden_sql())
def mean_estimates(spark, sf_dir):
    """Maximum-likelihood means of single variants at a given dispersion."""
    c = A.counts(spark, sf_dir).where("ref_count + alt_count >= 10").select((F.col("ref_count") + 1).alias("ref"), (F.col("ref_count") + F.col("alt_count") + 2).alias("N")).distinct()
    rows = c.select(F.concat_ws("_", "ref", "N").alias("region"), F.lit("c").alias("chrom"), F.lit(0).cast("long").alias("pos"), "ref", "N", F.lit(None).cast("byte").alias("gt"), F.lit(0.1).alias("rho"))
    fit = imbalance.fit_regions(rows, False)
    parts = F.split("region", "_")
    return fit.select(parts[0].cast("long").alias("ref"), parts[1].cast("long").alias("n"), F.round("mu", 4).alias("mu"), F.round("alt_ll", 6).alias("alt_ll"))


def _search_sql(name: str, by: str, start: str, data: str, nll: Callable[[str], str]) -> str:
    """Golden sections of many functions in step. start: (by, a, h) of each; data: the rows whose nll is summed, with the columns `by`."""
    g = "0.6180339887498949"
    keys = [x.strip() for x in by.split(",")]
    own = ", ".join(f"t.{x}" for x in keys)
    return f"""
{name}_0 AS (SELECT {by}, a, h, a + (1 - {g}) * h AS c, a + {g} * h AS d FROM ({start})),
{name} AS (
  SELECT {own}, 0 AS i, t.a, t.h, t.c, t.d, sum({nll("t.c")}) AS fc, sum({nll("t.d")}) AS fd FROM {name}_0 t JOIN {data} x USING ({by}) GROUP BY {own}, t.a, t.h, t.c, t.d
  UNION ALL
  SELECT {own}, t.i + 1, t.a, t.h, CASE WHEN t.l THEN t.p ELSE t.d END, CASE WHEN t.l THEN t.c ELSE t.p END,
    CASE WHEN t.l THEN sum({nll("t.p")}) ELSE t.fd END, CASE WHEN t.l THEN t.fc ELSE sum({nll("t.p")}) END
  FROM (
    SELECT {by}, i, fc < fd AS l, CASE WHEN fc < fd THEN a ELSE c END AS a, h * {g} AS h, c, d, fc, fd,
      CASE WHEN fc < fd THEN a + (1 - {g}) * h * {g} ELSE c + {g} * h * {g} END AS p
    FROM {name} WHERE h > 1e-6) t JOIN {data} x USING ({by})
  GROUP BY {own}, t.i, t.l, t.a, t.h, t.c, t.d, t.fc, t.fd, t.p
),
{name}_best AS (SELECT {by}, CASE WHEN fc < fd THEN c ELSE d END AS best, -least(fc, fd) AS ll FROM {name} WHERE h <= 1e-6)"""


_HALF = "(0.5 * (1 - {r}) / {r})"
_ROWS_SQL = """rows AS (SELECT chrom, pos, region, "GT", ref_count + 1 AS k, ref_count + alt_count + 2 AS n FROM counts WHERE ref_count + alt_count >= 10)"""


def _null_sql(r: str) -> str:
    return "-x.w * " + _PMF.format(k="x.k", n="x.n", a=_HALF.format(r=r), b=_HALF.format(r=r))


def _dispersion_sql() -> str:
    hist = """hist AS (SELECT 'all' AS sample, k, n, count(*) AS w FROM rows GROUP BY ALL UNION ALL SELECT 'd' || CAST(pos % 5 AS VARCHAR), k, n, count(*) FROM rows GROUP BY ALL)"""
    start = "SELECT DISTINCT sample, CASE sample WHEN 'all' THEN 0.001 ELSE 1e-6 END::DOUBLE AS a, CASE sample WHEN 'all' THEN 0.998 ELSE 1 - 2e-6 END::DOUBLE AS h FROM hist"
    return f"WITH RECURSIVE {A.COUNTS_SQL}, {_ROWS_SQL}, {hist}, {_search_sql('fit', 'sample', start, 'hist', _null_sql)} SELECT sample, round(best, 4) AS rho FROM fit_best"


@query(_dispersion_sql())
def dispersion_estimates(spark, sf_dir):
    """Dispersions under the null: of all variants, and of each donor's."""
    c = A.counts(spark, sf_dir).withColumn("donor_id", F.concat(F.lit("d"), F.col("pos") % 5))
    one = imbalance.fit_dispersion(imbalance.prepared(c, "region", 10, 1, False, True, None))
    each = imbalance.fit_donor_dispersion(imbalance.prepared(c, "region", 10, 1, False, False, "donor_id"))
    rho = spark.createDataFrame([("all", one)], "sample string, rho double").union(each)
    return rho.select("sample", F.round("rho", 4).alias("rho"))


def _mean_pmf(m: str) -> str:
    s = "((1 - rho) / rho)"
    return _PMF.format(k="x.k", n="x.n", a=f"({m} * {s})", b=f"((1 - {m}) * {s})")


def _mean_nll(m: str) -> str:
    """way: at the mean, at its complement, or evenly mixed."""
    up, down = _mean_pmf(m), _mean_pmf(f"(1 - {m})")
    mixed = f"(ln(0.5) + greatest({up}, {down}) + ln(1 + exp(-abs({up} - {down}))))"
    return f"-CASE WHEN x.way = 'same' THEN {up} WHEN x.way = 'flipped' THEN {down} ELSE {mixed} END"


def _ratio_sql() -> str:
    hist = "hist AS (SELECT 'all' AS sample, k, n, count(*) AS w FROM rows GROUP BY ALL)"
    rho = _search_sql("fit", "sample", "SELECT 'all' AS sample, 0.001::DOUBLE AS a, 0.998::DOUBLE AS h", "hist", _null_sql)
    terms = """firsts AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY chrom, pos) AS nth, first_value("GT") OVER (PARTITION BY region ORDER BY chrom, pos) AS head FROM rows),
cells AS (
  SELECT phased, region, k, n, (SELECT best FROM fit_best) AS rho, CASE WHEN nth = 1 OR (phased AND "GT" = head) THEN 'same' WHEN phased THEN 'flipped' ELSE 'mixed' END AS way
  FROM firsts, (VALUES (true), (false)) p(phased)
)"""
    means = _search_sql("means", "phased, region", "SELECT DISTINCT phased, region, 0.0::DOUBLE AS a, 1.0::DOUBLE AS h FROM cells", "cells", _mean_nll)
    return f"""WITH RECURSIVE {A.COUNTS_SQL}, {_ROWS_SQL}, {hist}, {rho}, {terms}, {means},
nulls AS (SELECT phased, region, count(*) AS snp_count, sum({_mean_pmf("0.5")}) AS null_ll FROM cells x GROUP BY ALL)
SELECT phased, region, snp_count, round(abs(best - 0.5), 2) AS deviation, round(null_ll, 3) AS null_ll, round(ll, 3) AS alt_ll, round(greatest(2 * (ll - null_ll), 0.0) + 0.0, 3) AS lrt
FROM means_best JOIN nulls USING (phased, region)"""


@query(_ratio_sql())
def likelihood_ratios(spark, sf_dir):
    """Likelihood-ratio tests of regions at the fitted dispersion, with phases and without.

    The mean's distance from one half is compared: without phases the
    likelihood hardly tells a mean from its complement.
    """
    out = []
    for phased in (True, False):
        found = imbalance.find_imbalance(A.counts(spark, sf_dir), phased=phased)
        rounded = [F.round(c, 3).alias(c) for c in ("null_ll", "alt_ll", "lrt")]
        out.append(found.select(F.lit(phased).alias("phased"), "region", "snp_count", F.round(F.abs(F.col("mu") - 0.5), 2).alias("deviation"), *rounded))
    return out[0].union(out[1])


@query("""
WITH p AS (SELECT o_orderkey AS k, o_orderpriority AS g, (o_orderkey * 31 % 9973 + 1) / 10000.0::DOUBLE AS pval FROM orders),
r AS (SELECT *, count(*) OVER (PARTITION BY g) AS m, rank() OVER (PARTITION BY g ORDER BY pval DESC) AS down FROM p),
q AS (SELECT *, pval * m / (m - down + 1) AS q FROM r)
SELECT k, g, pval, round(least(1.0, min(q) OVER (PARTITION BY g ORDER BY pval DESC)), 10) AS fdr_pval FROM q""")
def step_up_adjustment(spark, sf_dir):
    """Benjamini-Hochberg within groups."""
    d = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("g"), ((F.col("o_orderkey") * 31 % 9973 + 1) / 10000.0).alias("pval"))
    return bh_adjust(d, by=("g",)).select("k", "g", "pval", F.round("fdr_pval", 10).alias("fdr_pval"))


# Cells ---------------------------------------------------------------------------------------


@query(f"""WITH {A.CELLS_SQL} SELECT "group", snp_idx, CAST(sum(ref) AS BIGINT) AS ref, CAST(sum(alt) AS BIGINT) AS alt FROM coo JOIN cells USING (bc_idx) GROUP BY ALL""")
def pseudobulk(spark, sf_dir):
    return cell_ops.group_sums(A.coo(spark, sf_dir), A.cells(spark, sf_dir))


@query(f"""WITH {A.CELLS_SQL} SELECT snp_idx, {", ".join(f"CAST(coalesce(sum({c}) FILTER (\"group\" = '{g}'), 0) AS BIGINT) AS {g}_{c}" for g in ("g0", "g1") for c in ("ref", "alt", "other"))}
FROM coo JOIN cells USING (bc_idx) WHERE "group" IN ('g0', 'g1') GROUP BY snp_idx""")
def group_columns(spark, sf_dir):
    """Sums of two groups of cells side by side."""
    cells = A.cells(spark, sf_dir).where(F.col("group").isin("g0", "g1"))
    return expression.pivot_groups(A.coo(spark, sf_dir), cells, ["g0", "g1"])


@query(f"""WITH {A.CELLS_SQL} SELECT bc_idx, count(*) AS n_snps, CAST(sum(ref + alt + other) AS BIGINT) AS total, CAST(sum(ref) AS BIGINT) AS ref_total, CAST(sum(alt) AS BIGINT) AS alt_total FROM coo GROUP BY bc_idx""")
def cell_totals(spark, sf_dir):
    return expression.cell_qc(A.coo(spark, sf_dir))


@query(f"""
WITH {A.CELLS_SQL}, t AS (SELECT snp_idx, CAST(sum(ref) AS BIGINT) AS ref_count, CAST(sum(alt) AS BIGINT) AS alt_count FROM coo GROUP BY ALL),
z AS (SELECT *, abs((ref_count + alt_count - avg(ref_count + alt_count) OVER ()) / stddev_pop(ref_count + alt_count) OVER ()) AS z FROM t),
bad AS (SELECT DISTINCT snp_idx % 12 AS f FROM z WHERE z > 2.0)
SELECT snp_idx, ref_count, alt_count FROM t WHERE snp_idx % 12 NOT IN (SELECT f FROM bad)""")
def outlier_regions(spark, sf_dir):
    """Variants outside regions that hold an outlier."""
    totals = counting.sparse_totals(A.coo(spark, sf_dir), "snp_idx").select("snp_idx", "ref_count", "alt_count")
    return cell_ops.drop_outliers(totals, A.features(spark), 2.0)[0]


@query(f"""
WITH {A.CELLS_SQL}, g AS (SELECT "group", snp_idx FROM coo JOIN cells USING (bc_idx) GROUP BY ALL HAVING sum(ref + alt) > 10)
SELECT a."group" AS group1, b."group" AS group2, 'F' || CAST(a.snp_idx % 12 AS VARCHAR) AS region, count(*) AS num_snps FROM g a JOIN g b ON a.snp_idx = b.snp_idx AND a."group" < b."group" GROUP BY ALL""")
def shared_snps(spark, sf_dir):
    """Regions and variants that pairs of groups are compared on."""
    out = cell_ops.compare_groups(A.coo(spark, sf_dir), A.snps(spark), A.features(spark), A.cells(spark, sf_dir), 10, 0)
    return out.select("group1", "group2", "region", "num_snps")


@query()
def find_imbalance_cells(spark, sf_dir):
    return cell_ops.find_imbalance_groups(A.coo(spark, sf_dir), A.snps(spark), A.features(spark), A.cells(spark, sf_dir), gt="gt")


@query()
def compare_imbalance(spark, sf_dir):
    return cell_ops.compare_groups(A.coo(spark, sf_dir), A.snps(spark), A.features(spark), A.cells(spark, sf_dir))


_CELL_FIT_SQL = f"""totals AS (
  SELECT i AS snp_idx, CAST(coalesce(sum(ref), 0) + 1 AS BIGINT) AS k, CAST(coalesce(sum(ref + alt), 0) + 2 AS BIGINT) AS n FROM range(97) r(i) LEFT JOIN coo ON snp_idx = i GROUP BY i
),
hist AS (SELECT 'all' AS sample, k, n, count(*) AS w FROM totals GROUP BY k, n),
{_search_sql("fit", "sample", "SELECT 'all' AS sample, 1e-6::DOUBLE AS a, (1 - 2e-6)::DOUBLE AS h", "hist", _null_sql)},
sums AS (
  SELECT "group", snp_idx, 'F' || CAST(snp_idx % 12 AS VARCHAR) AS region, snp_idx % 2 AS gt, CAST(sum(ref) + 1 AS BIGINT) AS k, CAST(sum(ref + alt) + 2 AS BIGINT) AS n
  FROM coo JOIN cells USING (bc_idx) GROUP BY "group", snp_idx HAVING sum(ref + alt) > 0
)"""


def _group_ratio_sql() -> str:
    by = '"group", region'
    means = _search_sql("means", by, f"SELECT DISTINCT {by}, 0.0::DOUBLE AS a, 1.0::DOUBLE AS h FROM terms", "terms", _mean_nll)
    return f"""WITH RECURSIVE {A.CELLS_SQL}, {_CELL_FIT_SQL},
heads AS (SELECT *, first_value(gt) OVER (PARTITION BY {by} ORDER BY snp_idx) AS head, count(*) OVER (PARTITION BY {by}) AS m, sum(n) OVER (PARTITION BY {by}) AS total FROM sums),
terms AS (SELECT {by}, k, n, (SELECT best FROM fit_best) AS rho, CASE WHEN gt = head THEN 'same' ELSE 'flipped' END AS way FROM heads WHERE total >= 2 * m + 10),
{means},
known AS (SELECT {by}, count(*) AS num_snps, sum({_mean_pmf("0.5")}) AS null_ll, sum({_mean_pmf("(x.k::DOUBLE / x.n)")}) AS one_ll FROM terms x GROUP BY {by})
SELECT {by}, num_snps, round(null_ll, 3) AS null_ll, round(CASE num_snps WHEN 1 THEN one_ll ELSE ll END, 3) AS alt_ll
FROM means_best JOIN known USING ({by})"""


@query(_group_ratio_sql())
def group_likelihoods(spark, sf_dir):
    """Likelihoods of regions in groups of cells, at the dispersion of all variants."""
    out = find_imbalance_cells(spark, sf_dir)
    return out.select("group", "region", "num_snps", F.round("null_ll", 3).alias("null_ll"), F.round("alt_ll", 3).alias("alt_ll"))


def _pair_ratio_sql() -> str:
    by = "group1, group2, region"
    keys = f"{by}, side"
    means = _search_sql("means", keys, f"SELECT DISTINCT {keys}, 0.0::DOUBLE AS a, 1.0::DOUBLE AS h FROM terms", "terms", _mean_nll)
    return f"""WITH RECURSIVE {A.CELLS_SQL}, {_CELL_FIT_SQL},
many AS (SELECT * FROM sums WHERE n > 12),
shared AS (
  SELECT a."group" AS group1, b."group" AS group2, a.region, a.k AS k1, a.n AS n1, b.k AS k2, b.n AS n2, row_number() OVER (PARTITION BY a."group", b."group", a.region ORDER BY a.snp_idx) AS nth
  FROM many a JOIN many b ON a.snp_idx = b.snp_idx AND a."group" < b."group"
),
sides AS (SELECT {by}, nth, 1 AS own, k1 AS k, n1 AS n FROM shared UNION ALL SELECT {by}, nth, 2, k2, n2 FROM shared),
terms AS (SELECT {keys}, k, n, (SELECT best FROM fit_best) AS rho, CASE nth WHEN 1 THEN 'same' ELSE 'mixed' END AS way FROM sides JOIN (VALUES (1, 1), (2, 2), (1, 3), (2, 3)) s(own, side) USING (own)),
{means},
sizes AS (SELECT {by}, count(*) AS num_snps FROM shared GROUP BY {by})
SELECT {by}, any_value(num_snps) AS num_snps, round(sum(ll) FILTER (side = 3), 3) AS null_ll, round(sum(ll) FILTER (side < 3), 3) AS alt_ll FROM means_best JOIN sizes USING ({by}) GROUP BY {by}"""


@query(_pair_ratio_sql())
def pair_likelihoods(spark, sf_dir):
    """Likelihoods of regions under one mean of two groups of cells, and under one for each."""
    return compare_imbalance(spark, sf_dir).select("group1", "group2", "region", "num_snps", F.round("null_ll", 3).alias("null_ll"), F.round("alt_ll", 3).alias("alt_ll"))


# Expression, fragments, export ----------------------------------------------------------------


@query(f"""
WITH {A.COUNTS_SQL}, g AS (SELECT region AS gene_id, CAST(sum(ref_count) AS BIGINT) AS ref_count, CAST(sum(alt_count) AS BIGINT) AS alt_count FROM counts GROUP BY region)
SELECT *, CAST(ref_count + alt_count AS BIGINT) AS total_count, round(coalesce(alt_count / nullif(ref_count + alt_count, 0), 0.0), 10) AS alt_ratio FROM g""")
def gene_counts(spark, sf_dir):
    g = expression.gene_counts(A.counts(spark, sf_dir).withColumnRenamed("region", "gene_id"))
    return g.withColumn("alt_ratio", F.round("alt_ratio", 10))


@query(f"""
WITH {A.COUNTS_SQL} SELECT region AS "geneID", {", ".join(f"CAST(coalesce(sum(ref_count + alt_count) FILTER (pos % 4 = {i}), 0) AS BIGINT) AS s{i}" for i in range(4))} FROM counts GROUP BY region""")
def gene_matrix(spark, sf_dir):
    c = A.counts(spark, sf_dir).select(F.col("region").alias("gene_id"), F.concat(F.lit("s"), F.col("pos") % 4).alias("sample_id"), (F.col("ref_count") + F.col("alt_count")).alias("total_count"))
    return expression.gene_matrix(c, samples=[f"s{i}" for i in range(4)])


@query(f"""
WITH {A.COUNTS_SQL}, t AS (SELECT chrom, pos, ref_count, alt_count, ref_count + alt_count AS n, least(ref_count, alt_count) AS low FROM counts WHERE ref_count + alt_count >= 10),
p AS (SELECT *, CASE WHEN 2 * low = n THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(generate_series(0, low), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) - n * ln(2.0))))) END AS pvalue FROM t)
SELECT chrom, pos, round(pvalue + 1e-12, 8) AS pvalue, CASE WHEN alt_count / n >= 0.8 THEN 'MAE_ALT' WHEN ref_count / n >= 0.8 THEN 'MAE_REF' ELSE 'BIALLELIC' END AS mae_status FROM p""")
def mono_allelic_sites(spark, sf_dir):
    out = expression.mono_allelic(A.counts(spark, sf_dir))
    return out.select("chrom", "pos", F.round(F.col("pvalue") + 1e-12, 8).alias("pvalue"), "mae_status")


@query(f"""
WITH {A.COUNTS_SQL}, d AS (SELECT 'd' || CAST(pos % 3 AS VARCHAR) AS donor_id, 'chr1' AS chrom, pos % 500 AS pos, ref, alt, ref_count, alt_count, other_count FROM counts)
SELECT donor_id, chrom, pos, ref, alt FROM (SELECT DISTINCT donor_id, chrom, pos, ref, alt, ref_count, alt_count, other_count FROM d) GROUP BY ALL HAVING count(*) > 1""")
def conflicting_counts(spark, sf_dir):
    from phasewise.sinks.bundle import conflicting

    c = A.counts(spark, sf_dir).withColumns({"donor_id": F.concat(F.lit("d"), F.col("pos") % 3), "chrom": F.lit("chr1"), "pos": F.col("pos") % 500})
    return conflicting(c)


@query(f"""
WITH {A.POINTS_SQL}, f AS (SELECT 'chr' || CAST(event_id % 22 AS VARCHAR) AS chrom, (event_id * 53) % 50000 AS s, (event_id * 53) % 50000 + 100 + event_id % 200 AS e, user_id FROM events),
c AS (SELECT user_id, p.chrom, pos, ref, alt, count(*) AS n FROM f JOIN points p ON f.chrom = p.chrom AND p.pos0 >= s AND p.pos0 < e GROUP BY ALL),
k AS (SELECT * FROM c WHERE user_id IN (SELECT user_id FROM c GROUP BY user_id HAVING sum(n) >= 5))
SELECT chrom, pos, ref, alt, CAST(sum(n) AS BIGINT) AS ref_count, CAST(0 AS BIGINT) AS alt_count, count(*) AS n_cells FROM k GROUP BY ALL HAVING count(*) >= 2""")
def fragment_pseudobulk(spark, sf_dir):
    """Overlaps of fragments with variants, by cell and then over cells."""
    e = F.col("event_id")
    start = ((e * 53) % 50000).cast("long")
    f = A.table(spark, sf_dir, "events").select(F.concat(F.lit("chr"), e % 22).alias("chrom"), start.alias("start"), (start + 100 + e % 200).alias("end"), F.col("user_id").alias("barcode"))
    return expression.fragment_coverage(f, A.points(spark, sf_dir), 5, 2)


@query(f"""
WITH {A.COUNTS_SQL} SELECT chrom, pos, "GT", ref_count + alt_count AS total_count, round(ref_count / nullif(ref_count + alt_count, 0), 10) AS ref_ratio,
  CASE WHEN "GT" = '1|0' THEN alt_count ELSE ref_count END AS hap1_count, CASE WHEN "GT" = '1|0' THEN ref_count ELSE alt_count END AS hap2_count FROM counts""")
def export_table(spark, sf_dir):
    out = expression.export_table(A.counts(spark, sf_dir))
    return out.select("chrom", "pos", "GT", "total_count", F.round("ref_ratio", 10).alias("ref_ratio"), "hap1_count", "hap2_count")


@query(f"""
WITH {A.COUNTS_SQL} SELECT chrom || ':' || CAST(pos AS VARCHAR) || ':A>G' AS snp_id, CASE WHEN pos % 2 = 0 AND pos % 3 = 0 THEN alt_count ELSE ref_count END AS hap1,
  CASE WHEN pos % 2 = 0 AND pos % 3 = 0 THEN ref_count ELSE alt_count END AS hap2 FROM counts""")
def haplotype_layers(spark, sf_dir):
    c = A.counts(spark, sf_dir)
    # Every variant has a phase; that of odd positions is the default one.
    gt = F.when(F.col("pos") % 2 == 0, F.col("GT")).otherwise("0|1")
    phases = c.select(C.snp_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("snp_id"), gt.alias("gt"))
    return expression.haplotype_layers(c, phases).select("snp_id", "hap1", "hap2")


@query(f"""
WITH {A.COUNTS_SQL}, g AS (SELECT region AS gene_id, (pos // 200) % 4 AS s, sum(ref_count + alt_count) AS t FROM counts GROUP BY ALL)
SELECT gene_id FROM g GROUP BY gene_id HAVING count(*) FILTER (t >= 60) >= 2""")
def expressed_genes(spark, sf_dir):
    c = A.counts(spark, sf_dir).groupBy(F.col("region").alias("gene_id"), (F.floor(F.col("pos") / 200) % 4).alias("sample_id")).agg(F.sum(F.col("ref_count") + F.col("alt_count")).alias("total_count"))
    return expression.expressed_genes(c, 60)


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_events(spark, sf_dir):
    from phasewise.streaming.incremental import windowed_counts

    return windowed_counts(A.table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
