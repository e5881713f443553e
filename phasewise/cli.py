"""Command line: python -m phasewise.cli GROUP COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from phasewise.plans import workflows as w
from phasewise.sinks import files
from phasewise.sources import tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phasewise")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, **options):
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        p.add_argument("--out", required=True)
        for key, default in options.items():
            kind = {"action": "store_true"} if default is False else {"type": type(default) if default is not None else str, "default": default}
            p.add_argument("--" + key.replace("_", "-"), **kind)
        return p

    variants = {"samples": None, "regions": None, "include_indels": False, "include_multiallelic": False, "max_indel_len": 10, "min_qual": 0}
    add("count-variants", "alignments", "variants", feature=None, attribute=None, parent=None, **variants)
    add("count-cohort", "manifest", "variants", regions=None)
    add("count-variants-sc", "alignments", "variants", "barcodes", **variants)
    test = {"min_count": 10, "pseudocount": 1, "phased": False}
    add("find-imbalance", "counts", model="single", region_col=None, groupby=None, per_variant=False, **test)
    cells = {"groups": None, "sample": None, "z_cutoff": 0.0, **test}
    add("find-imbalance-sc", "counts", "barcode_map", **cells)
    add("compare-imbalance", "counts", "barcode_map", **cells)
    add("make-reads", "alignments", "variants", "sample", include_indels=False, max_indel_len=10)
    add("filter-remapped", "to_remap", "remapped", keep=None, same_locus_slop=0, positions=None)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"phasewise {a.command}").getOrCreate()
    if a.command in ("count-variants", "count-variants-sc"):
        filters = {"include_indels": a.include_indels, "max_indel_len": a.max_indel_len, "biallelic_only": not a.include_multiallelic}
        if a.command == "count-variants":
            out = w.count_variants(spark, a.alignments, a.variants, a.samples, a.regions, feature=a.feature, attribute=a.attribute, parent=a.parent, min_qual=a.min_qual, **filters)
            files.write_tsv(out, a.out, ["chrom", "pos0"])
        else:
            d = w.count_cells(spark, a.alignments, a.variants, a.barcodes, a.samples, a.regions, a.min_qual, **filters)
            files.write_cells(a.out, d["coo"], d["snps"], d["cells"], d.get("features"))
    elif a.command == "count-cohort":
        w.count_cohort(spark, a.manifest, a.variants, a.out, a.regions)
    elif a.command == "find-imbalance":
        region = None if a.per_variant else a.region_col or a.groupby or "auto"
        files.write_imbalance(w.find_imbalance(spark, a.counts, min_count=a.min_count, pseudocount=a.pseudocount, model=a.model, phased=a.phased, region=region), a.out)
    elif a.command in ("find-imbalance-sc", "compare-imbalance"):
        data = files.read_cells(spark, a.counts)
        f = w.find_imbalance_cells if a.command == "find-imbalance-sc" else w.compare_imbalance
        wanted = a.groups.split(",") if a.groups else None
        out = f(data, tables.read_groups(spark, a.barcode_map), wanted, a.sample, a.phased, a.z_cutoff or None, min_count=a.min_count, pseudocount=a.pseudocount)
        files.write_by_group(out, a.out, ["group"] if a.command == "find-imbalance-sc" else ["group1", "group2"])
    elif a.command == "make-reads":
        d = w.make_reads(spark, a.alignments, a.variants, a.sample, a.include_indels, a.max_indel_len)
        files.write_fastq(d["copies"], f"{a.out}/fastq")
        files.write_positions(d["copies"], f"{a.out}/expected_positions")
        for name in ("to_remap", "keep"):
            files.write_alignments(d[name], f"{a.out}/{name}")
    else:
        out = w.filter_remapped(spark, a.to_remap, a.remapped, a.keep, a.same_locus_slop, a.positions)
        files.write_alignments(out, a.out)


if __name__ == "__main__":
    main()
