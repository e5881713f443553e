"""Canonical tables. Positions are 0-based, ends exclusive; pos is the 1-based position of a variant."""

from __future__ import annotations

VARIANTS = "chrom string, pos0 long, pos long, end long, id string, ref string, alt string, alt_index int, n_alts int"
ALIGNMENTS = (
    "qname string, flag int, chrom string, pos0 long, mapq int, cigar string, mate_chrom string, mate_pos0 long, "
    "seq string, qual string, tags map<string,string>, cb string, file_order long"
)
REGIONS = "chrom string, start long, end long, region string"
FRAGMENTS = "chrom string, start long, end long, barcode string, count long"
IMBALANCE = (
    "region string, ref_count long, alt_count long, N long, snp_count long, null_ll double, alt_ll double, mu double, lrt double, pval double"
)
COUNT_COLUMNS = ("ref_count", "alt_count", "other_count")
