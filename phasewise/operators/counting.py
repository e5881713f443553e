"""Allele counts of variants from aligned reads.

Every read name counts once: a record goes to the variant it covers that comes
first in the input, and of a name's records the first in the file counts. In
single cells it is the name's first variant that counts, over all its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phasewise.functions import columns as C
from phasewise.operators.interval_join import interval_join, packed_points

UNMAPPED = 0x4


def indexed(variants: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row for each (chrom, pos), the first in input order, with its place enc_idx.

    Of several ALTs at a position the first one is counted for all of them.
    Without `order` the input order is that of position.
    """
    by = [F.col(c) for c in order or ["pos0", "ref", "alt"]]
    first = W.partitionBy("chrom", "pos0").orderBy(*by)
    once = variants.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return once.withColumn("enc_idx", F.struct(*by))


def _near(alignments: DataFrame, variants: DataFrame) -> DataFrame:
    """Reads by bins with the variants there in __near, by enc_idx; __end, and __block for reads of one block."""
    reads = alignments.withColumns({"__end": F.col("pos0") + C.reference_length(F.col("cigar")), "__block": C.one_block_length(F.col("cigar"))})
    points = variants.select("enc_idx", F.col("chrom").alias("v_chrom"), F.col("pos0").alias("v_pos0"), *[c for c in ("ref", "alt", "snp_idx") if c in variants.columns])
    return packed_points(reads, points, ("chrom", "pos0", "__end"), ("v_chrom", "v_pos0"), "enc_idx")


def _within(p: Column) -> Column:
    return (p["v_pos0"] >= F.col("pos0")) & (p["v_pos0"] < F.col("__end"))


def _at(p: Column) -> Column:
    return C.query_position(F.col("cigar"), F.col("pos0"), p["v_pos0"], F.col("__block"))


def covered(alignments: DataFrame, variants: DataFrame, flag_mask: int = UNMAPPED, first: bool = False, min_qual: int = 0) -> DataFrame:
    """Pairs of a read and a variant it has an aligned base at, of min_qual at least; qpos is the place of that base.

    Reads with any flag of flag_mask are left out. Nothing else is filtered.
    first: of a read's pairs in a bin only that with the least enc_idx, so that
    there are about as many rows as reads, however dense the variants.
    """
    reads = alignments.where((F.col("flag").bitwiseAND(F.lit(flag_mask)) == 0) & (F.col("pos0") >= 0))

    def good(p: Column) -> Column:
        has = F.coalesce(_at(p) < F.length("seq"), F.lit(False))
        return _within(p) & (has & (C.base_quality(F.col("qual"), _at(p).cast("int")) >= min_qual) if min_qual > 0 else has)

    hits = F.filter("__near", good)
    # A generator, unlike a filter, is evaluated once and isn't moved into the join.
    pairs = _near(reads, variants).withColumn("__p", F.explode(F.slice(hits, 1, 1) if first else hits))
    fields = ["v_chrom", "v_pos0", "ref", "alt", "enc_idx", *(["snp_idx"] if "snp_idx" in variants.columns else [])]
    out = pairs.withColumn("qpos", _at(F.col("__p")))
    return out.select(*alignments.columns, *[F.col("__p")[c].alias(c) for c in fields], "qpos")


def allele_class(seq: Column, qpos: Column, ref: Column, alt: Column, strict: bool = True) -> Column:
    """ref, alt or other. strict: a base that is none of A, C, G, T, N has no class.

    For longer alleles the read's bases from qpos on decide: equal to an allele,
    else beginning with it.
    """
    snv = C.is_snv(ref, alt)
    base = F.substr(seq, qpos.cast("int") + 1, F.lit(1))
    width = F.greatest(F.length(ref), F.length(alt))
    bases = F.regexp_replace(F.substr(seq, qpos.cast("int") + 1, width), "[^ACGT]", "N")
    single = F.when(base == ref, "ref").when(base == alt, "alt")
    single = single.when(base.isin(*"ACGTN"), "other") if strict else single.otherwise("other")
    if strict:
        single = F.when(base.isin(*"ACGTN"), single)
    longer = F.when(bases == ref, "ref").when(bases == alt, "alt").when(bases.startswith(ref), "ref").when(bases.startswith(alt), "alt").otherwise("other")
    return F.when(snv, single).otherwise(longer)


def count_sums(groups) -> DataFrame:
    """The three counts of rows with cls."""
    return groups.agg(*[F.count_if(F.col("cls") == k).alias(f"{k}_count") for k in ("ref", "alt", "other")])


def count_bulk(alignments: DataFrame, variants: DataFrame, min_qual: int = 0, flag_mask: int = UNMAPPED, order: list[str] | None = None) -> DataFrame:
    """`variants` with ref_count, alt_count and other_count, 0 where no read counts."""
    pairs = covered(alignments, indexed(variants, order), flag_mask, first=True)
    record = ["chrom", "qname", "file_order"]
    # The class is found before the shuffle, which then carries no sequences; what has none goes only after the choice.
    cls = allele_class(F.col("seq"), F.col("qpos"), F.col("ref"), F.col("alt"))
    if min_qual > 0:
        cls = F.when(C.base_quality(F.col("qual"), F.col("qpos").cast("int")) >= min_qual, cls)
    # A number for place and class, and by default for the order, keeps the choice in fixed-width buffers.
    place = F.col("v_pos0") * 4 + F.when(cls == "ref", 0).when(cls == "alt", 1).when(cls == "other", 2)
    rank = F.struct("enc_idx") if order else F.col("v_pos0")
    rated = pairs.select(*record, rank.alias("rank"), place.alias("at")).repartition("chrom", "qname")
    best = rated.groupBy(*record).agg(F.min_by("at", "rank").alias("at")).where("at is not null")
    first = best.groupBy("chrom", "qname").agg(F.min_by("at", "file_order").alias("at"))
    kind = F.element_at(F.array(*map(F.lit, ("ref", "alt", "other"))), (F.pmod("at", F.lit(4)) + 1).cast("int"))
    first = first.select("chrom", F.shiftright("at", 2).alias("pos0"), kind.alias("cls"))
    counts = count_sums(first.groupBy("chrom", "pos0"))
    out = variants.join(counts, ["chrom", "pos0"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("ref_count", "alt_count", "other_count")})


def count_cells(alignments: DataFrame, variants: DataFrame, barcodes: DataFrame, min_qual: int = 0, flag_mask: int = UNMAPPED) -> DataFrame:
    """Nonzero counts (snp_idx, bc_idx, ref, alt, other).

    variants: chrom, pos0, ref, alt, snp_idx; barcodes: barcode, bc_idx. Reads
    without a listed barcode don't count. A base that can't be read counts as other.
    """
    reads = alignments.join(barcodes, alignments["cb"] == barcodes["barcode"]).drop("barcode")
    points = variants.withColumn("enc_idx", F.col("snp_idx"))
    pairs = covered(reads, points, flag_mask, first=True, min_qual=min_qual)
    base = F.substr("seq", F.col("qpos").cast("int") + 1, F.lit(1))
    cls = F.when(base == F.col("ref"), "ref").when(base == F.col("alt"), "alt").otherwise("other")
    pairs = pairs.select("chrom", "qname", "file_order", "snp_idx", "bc_idx", cls.alias("cls"))
    first = pairs.groupBy("chrom", "qname").agg(F.min_by(F.struct("snp_idx", "bc_idx", "cls"), F.struct("snp_idx", "file_order", "bc_idx")).alias("b"))
    counts = count_sums(first.select("b.*").groupBy("snp_idx", "bc_idx"))
    return counts.select("snp_idx", "bc_idx", F.col("ref_count").alias("ref"), F.col("alt_count").alias("alt"), F.col("other_count").alias("other"))


def cell_read_stats(alignments: DataFrame, variants: DataFrame, barcodes: DataFrame) -> DataFrame:
    """For each chromosome, reads over variants by what became of them: no barcode, unlisted barcode, no base there, counted or seen before."""
    reads = alignments.join(barcodes, alignments["cb"] == barcodes["barcode"], "left")
    mapped = reads.where(F.col("flag").bitwiseAND(F.lit(UNMAPPED)) == 0)
    near = _near(mapped, variants.withColumn("enc_idx", F.col("snp_idx")))
    over, readable = F.size(F.filter("__near", _within)), F.size(F.filter("__near", lambda p: _within(p) & _at(p).isNotNull()))
    kind = F.when(F.col("cb").isNull(), "no_barcode").when(F.col("bc_idx").isNull(), "unlisted_barcode").otherwise("listed")
    rows = near.select("chrom", "qname", kind.alias("kind"), over.cast("long").alias("over"), readable.cast("long").alias("readable"))
    of = lambda k, n: F.when(F.col("kind") == k, n).otherwise(F.lit(0).cast("long"))
    sums = {"no_barcode": of("no_barcode", F.col("over")), "unlisted_barcode": of("unlisted_barcode", F.col("over")), "no_base": of("listed", F.col("over") - F.col("readable")), "usable": of("listed", F.col("readable"))}
    names = rows.groupBy("chrom", "qname").agg(F.sum("over").alias("over"), *[F.sum(v).alias(k) for k, v in sums.items()]).where("over > 0")
    spent = F.greatest(F.col("usable") - 1, F.lit(0).cast("long"))
    return names.groupBy("chrom").agg(*[F.sum(k).alias(k) for k in ("no_barcode", "unlisted_barcode", "no_base")], F.count_if(F.col("usable") > 0).alias("counted"), F.sum(spent).alias("seen_before"))


def region_features(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of variants with the region they overlap, many to many; equal rows once."""
    r = regions.select(F.col("chrom").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"), *[c for c in regions.columns if c not in ("chrom", "start", "end")])
    v = variants if "end" in variants.columns else variants.withColumn("end", F.col("pos0") + F.length("ref"))
    out = interval_join(v, r, ("chrom", "pos0", "end"), ("__c", "__s", "__e")).drop("__c", "__s", "__e")
    return (out if "end" in variants.columns else out.drop("end")).distinct()


def sparse_totals(coo: DataFrame, key: str) -> DataFrame:
    """Summed counts of each variant or cell of (snp_idx, bc_idx, ref, alt, other)."""
    return coo.groupBy(key).agg(F.sum("ref").alias("ref_count"), F.sum("alt").alias("alt_count"), F.sum("other").alias("other_count"), F.count("*").alias("n"))


def conflicts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Variants that several rows give different counts."""
    cells = F.struct("ref_count", "alt_count", "other_count")
    return rows.groupBy(*key).agg(F.min(cells).alias("low"), F.max(cells).alias("high")).where("low <> high").select(*key)
