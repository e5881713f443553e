"""Writers of tables, reads and export data."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasewise.functions import columns as C
from phasewise.operators.cells import variant_features


def write_tsv(df: DataFrame, path: str, sort: Sequence[str] = (), single: bool = False, compression: str = "none") -> None:
    """Tab-separated text with a header. single: one file, for results that fit one task."""
    out = df.orderBy(*sort) if sort else df
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").csv(path, sep="\t", header=True, compression=compression, emptyValue="", nullValue="")


def write_imbalance(df: DataFrame, path: str, single: bool = True) -> None:
    """Results by rising adjusted p-value."""
    write_tsv(df, path, ["fdr_pval", "region"], single)


def write_by_group(df: DataFrame, path: str, groups: Sequence[str]) -> None:
    """A folder for each value of `groups`; a slash in a name becomes a hyphen."""
    safe = {f"{g}_": F.regexp_replace(F.col(g).cast("string"), "/", "-") for g in groups}
    out = df.withColumns(safe).repartition(*safe).sortWithinPartitions(*safe, "pval")
    out.write.mode("overwrite").partitionBy(*safe).csv(path, sep="\t", header=True)


def _fastq(name: Column, seq: Column, qual: Column, reverse: Column) -> Column:
    s = F.when(reverse, C.reverse_complement(seq)).otherwise(seq)
    q = F.when(reverse, F.reverse(qual)).otherwise(qual)
    return F.concat_ws("\n", F.concat(F.lit("@"), name), s, F.lit("+"), q)


def write_fastq(copies: DataFrame, path: str, compression: str = "gzip") -> None:
    """r1 and r2 below `path`: equally many files, those of one number with the mates in the same order.

    Copies are dealt by the hash of their name to a fixed number of tasks and
    sorted there, so neither adaptive execution nor a sample of the data has a
    say in where a mate goes. Reads of the reverse strand are turned.
    """
    n = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [f"{c}{i}" for i in (1, 2) for c in ("seq", "qual", "reverse")]
    named = copies.where("name is not null").select("name", *sides).repartition(n, "name").sortWithinPartitions("name", *sides)
    for i in (1, 2):
        name = F.concat("name", F.lit(f"/{i}"))
        out = named.select(_fastq(name, F.col(f"seq{i}"), F.col(f"qual{i}"), F.col(f"reverse{i}")).alias("value"))
        out.write.mode("overwrite").option("compression", compression).text(f"{path}/r{i}")


def write_positions(copies: DataFrame, path: str) -> None:
    """Expected positions of each copy and mate: name, mate, both positions, mask."""
    named = copies.where("name is not null")
    sides = [named.select(F.concat("name", F.lit(f"/{i}")).alias("qname"), F.lit(i).alias("mate"), "exp_pos1", "exp_pos2", "overlap_mask") for i in (1, 2)]
    sides[0].union(sides[1]).write.mode("overwrite").csv(path, sep="\t")


def write_names(reads: DataFrame, path: str, column: str = "qname") -> None:
    reads.select(F.col(column).alias("value")).distinct().write.mode("overwrite").text(path)


def write_alignments(reads: DataFrame, path: str) -> None:
    """Parquet by chromosome, sorted by position, so that ranges are pruned."""
    reads.repartitionByRange("chrom", "pos0").sortWithinPartitions("chrom", "pos0", "file_order").write.mode("overwrite").partitionBy("chrom").parquet(path)


def write_cells(path: str, coo: DataFrame, snps: DataFrame, cells: DataFrame, features: DataFrame | None = None) -> None:
    """Sparse counts with their variants, cells, regions and totals, as Parquet folders; read_cells() gives them back.

    Without regions each variant is one of its own, so every store has features.
    """
    coo.write.mode("overwrite").parquet(f"{path}/coo")
    totals = coo.groupBy("snp_idx").agg(F.sum("ref").alias("ref_count"), F.sum("alt").alias("alt_count"))
    var = snps.join(totals, "snp_idx", "left").fillna(0, ["ref_count", "alt_count"])
    var.write.mode("overwrite").parquet(f"{path}/var")
    cells.write.mode("overwrite").parquet(f"{path}/obs")
    if features is None:
        features = variant_features(snps)
    features.write.mode("overwrite").parquet(f"{path}/feature")
    stats = coo.agg(F.count("*").alias("entries"), F.count_distinct("bc_idx").alias("cells"), F.count_distinct("snp_idx").alias("snps"), F.sum(F.col("ref") + F.col("alt") + F.col("other")).alias("reads"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_cells(spark, path: str) -> dict[str, DataFrame]:
    """coo, snps, cells, features and stats of write_cells(), as find_imbalance_cells() and compare_imbalance() take them."""
    names = {"coo": "coo", "snps": "var", "cells": "obs", "features": "feature", "stats": "stats"}
    return {k: spark.read.parquet(f"{path}/{folder}") for k, folder in names.items()}


def write_export(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Parquet (snappy); zarr and h5ad need their libraries, and a table of bounded size, on the driver."""
    if format == "parquet":
        df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    elif format == "zarr":
        import zarr

        group = zarr.open_group(path, mode="w")
        for name, values in df.toPandas().items():
            group[name] = values.to_numpy()
    elif format == "h5ad":
        import anndata

        table = df.toPandas()
        anndata.AnnData(X=table[["ref_count", "alt_count"]].to_numpy(), obs=table.astype({"chrom": str})).write_h5ad(path)
    else:
        raise ValueError("format must be parquet, zarr or h5ad")


def write_state(spark, state: dict, path: str) -> None:
    """A small mapping, such as where a mapping run's files lie, as JSON."""
    text = json.dumps(state, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_state(spark, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
