"""Cohort bundles: counts, donors and a manifest that locks both by their hashes.

A bundle is written to a staging folder beside its place; the manifest is
written last and the folder renamed, so a bundle that can be seen is whole.
Hashes are taken from the files' bytes as they lie in the store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.sinks.files import write_tsv

KEY = ["chrom", "pos", "ref", "alt"]
FORMAT = 1


class BundleError(ValueError):
    """The bundle isn't what its manifest says."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_hashes(spark: SparkSession, path: str) -> dict[str, dict]:
    """Size and SHA-256 of the data files in a folder, by name; as many rows as it has files."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("path").rlike("/part-[^/]*$"))
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return {r["name"]: {"size": r["size"], "sha256": r["sha256"]} for r in rows.collect()}


def cohort_counts(parts: dict[str, DataFrame], region: bool = False) -> DataFrame:
    """Rows of all donors with donor_id first, equal rows of a donor once; schemas must agree."""
    names = {d: p.columns for d, p in parts.items()}
    if len({tuple(n) for n in names.values()}) != 1:
        raise BundleError("the donors' tables differ in their columns")
    out = None
    for donor, part in sorted(parts.items()):
        one = part.select(F.lit(donor).alias("donor_id"), *part.columns)
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(["donor_id", *KEY, *(["region"] if region else [])])


def conflicting(counts: DataFrame) -> DataFrame:
    """(donor_id, variant) whose rows, one for each region, disagree in their counts."""
    cells = F.struct("ref_count", "alt_count", "other_count")
    return counts.groupBy("donor_id", *KEY).agg(F.min(cells).alias("a"), F.max(cells).alias("b")).where("a <> b").drop("a", "b")


def write_bundle(counts: DataFrame, donors: DataFrame, path: str, settings: dict | None = None) -> dict:
    """Write the bundle at `path`, which must not exist; returns its manifest."""
    spark = counts.sparkSession
    at, fs = _fs(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    if not conflicting(counts).isEmpty():
        raise BundleError("a donor's variant has different counts in different rows")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}"
    order = ["donor_id", *KEY, *(["region"] if "region" in counts.columns else [])]
    try:
        write_tsv(counts, f"{staging}/counts.tsv.gz", order, compression="gzip")
        write_tsv(donors, f"{staging}/donors.tsv", ["donor_id"], single=True)
        totals = counts.agg(F.count("*").alias("rows"), F.count_distinct("donor_id").alias("donors")).first()
        manifest = {
            "format": FORMAT, "rows": totals["rows"], "donors": totals["donors"], "columns": counts.columns, "settings": settings or {},
            "files": {n: file_hashes(spark, f"{staging}/{n}") for n in ("counts.tsv.gz", "donors.tsv")},
        }
        out = fs.create(_fs(spark, f"{staging}/count_manifest.json")[0], False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True, indent=1).encode()))
        out.hsync()
        out.close()
        if not fs.rename(_fs(spark, staging)[0], at):
            raise FileExistsError(path)
    except BaseException:
        fs.delete(_fs(spark, staging)[0], True)
        raise
    return manifest


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise BundleError("the manifest has a key twice")
    return out


def verify_bundle(spark: SparkSession, path: str) -> dict:
    """The manifest, if sizes, hashes, totals and donors agree with it; else BundleError."""
    at, fs = _fs(spark, f"{path}/count_manifest.json")
    if not fs.exists(at):
        raise BundleError("there is no manifest")
    if fs.getFileLinkStatus(_fs(spark, path)[0]).isSymlink():
        raise BundleError("the bundle is a symbolic link")
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/count_manifest.json").collect())
    manifest = json.loads(text, object_pairs_hook=_unique)
    if set(manifest) != {"format", "rows", "donors", "columns", "settings", "files"} or manifest["format"] != FORMAT:
        raise BundleError("the manifest's keys or format aren't known")
    for name, files in manifest["files"].items():
        if file_hashes(spark, f"{path}/{name}") != files:
            raise BundleError(f"{name} isn't what the manifest says")
    counts, donors = read_bundle(spark, path)
    totals = counts.agg(F.count("*").alias("rows"), F.count_distinct("donor_id").alias("donors")).first()
    if (totals["rows"], totals["donors"]) != (manifest["rows"], manifest["donors"]) or counts.columns != manifest["columns"]:
        raise BundleError("rows, donors or columns aren't as many as the manifest says")
    if not counts.select("donor_id").distinct().exceptAll(donors.select("donor_id")).isEmpty() or not donors.select("donor_id").exceptAll(counts.select("donor_id").distinct()).isEmpty():
        raise BundleError("donors and counts don't list the same donors")
    return manifest


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    read = lambda name: spark.read.csv(f"{path}/{name}", sep="\t", header=True)
    return read("counts.tsv.gz"), read("donors.tsv")
