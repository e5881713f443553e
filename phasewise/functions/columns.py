"""Column expressions: genotypes, labels, sequences, read names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between a read's name and the positions its copy carries; other tools' names are read by giving theirs.
TAG = "_SWAP_"


# Genotypes ----------------------------------------------------------------

def allele_indices(gt: Column) -> Column:
    """Allele indices of a genotype such as 0|1 or 1/2 as array<int>; null where a part is missing."""
    parts = F.split(F.element_at(F.split(gt, ":"), 1), r"[|/]")
    return F.when(F.exists(parts, lambda x: (x == ".") | (x == "")), F.lit(None)).otherwise(F.transform(parts, lambda x: x.cast("int")))


def is_phased(gt: Column) -> Column:
    return F.contains(gt, F.lit("|"))


def genotype_code(gt: Column) -> Column:
    """0 for homozygous reference, 1 heterozygous, 2 homozygous alternate, -1 missing."""
    a = allele_indices(gt)
    same = F.size(F.array_distinct(a)) == 1
    code = F.when(a.isNull(), -1).when(~same, 1).when(F.element_at(a, 1) == 0, 0).otherwise(2)
    return F.coalesce(code, F.lit(-1)).cast("byte")


def is_het(gt: Column, alt_index: Column) -> Column:
    """Whether the genotype has two alleles, and this ALT (1-based index) is one of them."""
    a = allele_indices(gt)
    return F.coalesce(F.array_contains(a, alt_index) & (F.size(F.array_distinct(a)) > 1), F.lit(False))


def alleles(gt: Column, ref: Column, alts: Column) -> Column:
    """Bases of the genotype's alleles; alts is the array of all ALTs."""
    every = F.concat(F.array(ref), alts)
    return F.transform(allele_indices(gt), lambda i: F.try_element_at(every, i + 1))


def phase(gt: Column) -> Column:
    """0 for 0|1, 1 for 1|0, else null."""
    return F.when(gt == "0|1", 0).when(gt == "1|0", 1).cast("byte")


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def type_allowed(ref: Column, alt: Column, include_indels: bool, max_indel_len: int) -> Column:
    """Single-base variants, and with include_indels those whose lengths differ by at most max_indel_len."""
    if not include_indels:
        return is_snv(ref, alt)
    return is_snv(ref, alt) | (F.abs(F.length(ref) - F.length(alt)) <= max_indel_len)


def with_chr(chrom: Column) -> Column:
    """Number and sex chromosome names with the prefix chr."""
    return F.when(F.lower(chrom).startswith("chr"), chrom).when(chrom.rlike(r"^(\d+|X|Y|M|MT)$"), F.concat(F.lit("chr"), chrom)).otherwise(chrom)


# Labels --------------------------------------------------------------------

def variant_label(chrom: Column, pos: Column) -> Column:
    return F.concat_ws("_", chrom, pos)


def interval_label(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("_", chrom, start, end)


def snp_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat(chrom, F.lit(":"), pos, F.lit(":"), ref, F.lit(">"), alt)


def attribute(column: Column, name: str) -> Column:
    """Value of a GTF or GFF3 attribute that is closed by a semicolon; null without one."""
    found = F.regexp_extract(column, rf"""{name}[=\s]"?'?(.*?)"?'?;""", 1)
    return F.when(column.rlike(rf"""{name}[=\s]"?'?(.*?)"?'?;"""), found)


def safe_ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    out = F.try_divide(a, b)
    return out if empty is None else F.coalesce(out, F.lit(empty))


# Sequences -------------------------------------------------------------------

def reverse_complement(seq: Column) -> Column:
    """Bases other than A, C, G, T become N; case is kept for those four."""
    known = F.regexp_replace(seq, "[^ACGTacgt]", "N")
    return F.reverse(F.translate(known, "ACGTacgt", "TGCAtgca"))


def phred33(scores: Column) -> Column:
    """Text of an array of quality scores."""
    return F.array_join(F.transform(scores, lambda q: F.char(q + 33)), "")


def base_quality(qual: Column, at: Column) -> Column:
    """Score at the 0-based place of a Phred+33 string."""
    return F.ascii(F.substring(qual, at + 1, F.lit(1))) - 33


# CIGAR -------------------------------------------------------------------------

def cigar_ops(cigar: Column) -> Column:
    """array<struct<op string, len int>>; none for '*'."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0))
    op = lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, r"\d+", 0).cast("int").alias("len"))
    return F.transform(found, op)


def _any(op: Column, kinds: str) -> Column:
    return reduce(lambda a, b: a | b, [op == k for k in kinds])


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that the alignment spans."""
    add = lambda acc, x: acc + F.when(_any(x["op"], "MDN=X"), x["len"].cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(_one_block(cigar), _block_length(cigar)).otherwise(F.aggregate(cigar_ops(cigar), F.lit(0).cast("long"), add))


def _one_block(cigar: Column) -> Column:
    """Most reads are one block of matches; their arithmetic needs no loop over operations."""
    return cigar.rlike("^[0-9]+[M=X]$")


def _block_length(cigar: Column) -> Column:
    return F.substr(cigar, F.lit(1), F.length(cigar) - 1).try_cast("long")


def one_block_length(cigar: Column) -> Column:
    """Length of an alignment that is one block of matches; null for others."""
    return F.when(_one_block(cigar), _block_length(cigar))


def query_position(cigar: Column, pos0: Column, target: Column, block: Column | None = None) -> Column:
    """0-based place in the read of the reference position `target`, if a base is aligned there; else null.

    block: one_block_length(), where it is at hand.
    """
    zero = F.struct(pos0.cast("long").alias("ref"), F.lit(0).cast("long").alias("query"), F.lit(None).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        op, n = x["op"], x["len"].cast("long")
        match, query, ref = _any(op, "M=X"), _any(op, "MIS=X"), _any(op, "MDN=X")
        inside = match & (target >= acc["ref"]) & (target < acc["ref"] + n)
        none = F.lit(0).cast("long")
        return F.struct(
            (acc["ref"] + F.when(ref, n).otherwise(none)).alias("ref"),
            (acc["query"] + F.when(query, n).otherwise(none)).alias("query"),
            F.coalesce(acc["at"], F.when(inside, acc["query"] + target - acc["ref"])).alias("at"),
        )

    simple, length = (_one_block(cigar), _block_length(cigar)) if block is None else (block.isNotNull(), block)
    inside = F.when((target >= pos0) & (target < pos0 + length), target - pos0)
    return F.when(simple, inside).otherwise(F.aggregate(cigar_ops(cigar), zero, step, lambda acc: acc["at"]))


def location(pos0: Column, ref_end: Column, v_start: Column, v_end: Column) -> Column:
    """Where a variant lies: upstream, downstream, spans_start or within."""
    return (
        F.when(v_end <= pos0, "upstream").when(v_start >= ref_end, "downstream").when((v_start < pos0) & (v_end > pos0), "spans_start").otherwise("within")
    )


# Names of swapped reads ---------------------------------------------------------

def encode_name(qname: Column, pos1: Column, pos2: Column, nth: Column, total: Column, *more: Column, tag: str = TAG) -> Column:
    """name, tag, both positions, number and count of copies; further parts (trim, trims, deltas) may follow."""
    return F.concat(qname, F.lit(tag), F.concat_ws("_", pos1, pos2, nth, total, *more))


def decode_name(name: Column, tag: str = TAG) -> Column:
    """struct<orig, pos1, pos2, nth, total, delta1, delta2> of a swapped read's name, null for others.

    Only the digits in front count for each part, so a mate suffix is ignored;
    deltas are absolute and 0 if absent.
    """
    at = F.instr(name, tag)
    parts = F.split(F.substr(name, at + F.lit(len(tag))), "_")
    number = lambda i: F.regexp_extract(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), r"^-?\d+", 0).try_cast("long")
    fields = [F.substr(name, F.lit(1), at - 1).alias("orig")]
    fields += [number(i).alias(n) for i, n in enumerate(("pos1", "pos2", "nth", "total"))]
    fields += [F.abs(F.coalesce(number(i), F.lit(0).cast("long"))).alias(n) for i, n in ((6, "delta1"), (7, "delta2"))]
    good = (at > 0) & number(0).isNotNull() & number(1).isNotNull() & number(3).isNotNull()
    return F.when(good, F.struct(*fields))


def slop_of(user: int, delta1: Column, delta2: Column) -> Column:
    """The user's tolerance if there is one, else the larger length change."""
    return F.lit(user).cast("long") if user > 0 else F.greatest(delta1, delta2)


def positions_match(pos: Column, mate: Column, expected1: Column, expected2: Column, slop: Column) -> Column:
    """Whether both mates lie at the expected places, in either order."""
    near = lambda a, b: F.abs(a - b) <= slop
    return (near(pos, expected1) & near(mate, expected2)) | (near(pos, expected2) & near(mate, expected1))


def overlap_mask(snv: Column, indel: Column) -> Column:
    """Aggregate: 1 if any single-base variant overlaps, plus 2 if any other does."""
    return (F.max(snv.cast("int")) + 2 * F.max(indel.cast("int"))).cast("byte")
