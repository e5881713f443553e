"""Counts that grow as files arrive.

The batch queries are the reference; here, new records stream in, are reduced
to one state per read name, and merged. State is keyed by name because a name
counts once over all its records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.operators import counting


def candidates(alignments: DataFrame, variants: DataFrame) -> DataFrame:
    """(chrom, qname, file_order, pos0, cls): the variant and class each record would count for; narrow, so it also runs on a stream."""
    pairs = counting.covered(alignments, counting.indexed(variants))
    cls = counting.allele_class(F.col("seq"), F.col("qpos"), F.col("ref"), F.col("alt"))
    best = pairs.groupBy("chrom", "qname", "file_order").agg(F.min_by(F.struct("v_pos0", cls.alias("cls")), F.col("enc_idx")).alias("b"))
    return best.select("chrom", "qname", "file_order", F.col("b.v_pos0").alias("pos0"), F.col("b.cls").alias("cls")).where("cls is not null")


def count_stream(stream: DataFrame, variants: DataFrame, state_path: str, checkpoint: str):
    """Start a query that adds each micro-batch of alignments to a table of candidates under state_path.

    The batch number names its folder, so a batch that runs again replaces
    itself. counts() reads the table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        candidates(batch, variants).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark, state_path: str) -> DataFrame:
    """chrom, pos0 and counts of all batches so far; of a name the record first in order counts."""
    rows = spark.read.parquet(state_path)
    first = rows.groupBy("chrom", "qname").agg(F.min_by(F.struct("pos0", "cls"), F.struct("batch", "file_order")).alias("b"))
    return counting.count_sums(first.select("chrom", "b.*").groupBy("chrom", "pos0"))


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Event counts and sums by window and type of (ts, event_type, value), with a watermark."""
    groups = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return groups.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
