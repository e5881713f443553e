"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from phasewise.plans import registry

HEADLINE = (
    "find_imbalance_region", "find_imbalance_phased", "find_imbalance_variant", "find_imbalance_linear", "find_imbalance_per_donor",
    "count_bulk", "count_cells", "interval_overlaps", "split_by_variants", "read_variant_pairs", "mate_pairs", "remap_verdicts", "swapped_copies",
    "step_up_adjustment", "find_imbalance_cells", "compare_imbalance", "mono_allelic_sites", "gene_matrix", "fragment_pseudobulk", "multiallelic_het_variants",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
