"""Benjamini-Hochberg adjustment without a single sorted partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of p-values that are ranked apart.
RANGES = 256


def bh_adjust(df: DataFrame, p: str = "pval", out: str = "fdr_pval", by: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the step-up adjusted p-values of each group of `by`.

    Equal p-values share a rank, so they are counted first. The distinct ones
    are ranked within ranges of log p; counts before and minima behind a range
    come from a table of one row for each range. Null p-values stay null.
    """
    by = list(by)
    some = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("__p")).agg(F.count("*").alias("__c"))
    # Even down to a quarter, then by half powers of two.
    part = F.when(F.col("__p") >= 0.25, F.floor(F.col("__p") * 128)).otherwise(F.greatest(F.lit(-RANGES), F.floor(F.log2(F.greatest("__p", F.lit(1e-300))) * 2)))
    some = some.withColumn("__part", part.cast("int"))
    parts = some.groupBy(*by, "__part").agg(F.sum("__c").alias("__n"))
    every = W.partitionBy(*by)
    up = every.orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.withColumns({"__m": F.sum("__n").over(every), "__before": F.sum("__n").over(up) - F.col("__n")})
    inside = W.partitionBy(*by, "__part")
    keys = [*by, "__part"]
    ranked = some.alias("a").join(parts.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    ranked = ranked.select("a.*", "b.__m", "b.__before")
    rank = F.col("__before") + F.sum("__c").over(inside.orderBy("__p").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = ranked.withColumn("__q", F.col("__p") * F.col("__m") / rank)
    low = ranked.groupBy(*keys).agg(F.min("__q").alias("__q"))
    behind = F.min("__q").over(every.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1))
    low = low.withColumn("__behind", behind).drop("__q")
    back = F.min("__q").over(inside.orderBy(F.desc("__p")).rowsBetween(W.unboundedPreceding, W.currentRow))
    adjusted = ranked.withColumn("__own", back).alias("a").join(low.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    adjusted = adjusted.select(*[F.col(f"a.{k}").alias(f"__k{i}") for i, k in enumerate(by)], "a.__p", F.least("a.__own", "b.__behind", F.lit(1.0)).alias(out))
    on = [df[p] == adjusted["__p"], *[df[k].eqNullSafe(adjusted[f"__k{i}"]) for i, k in enumerate(by)]]
    return df.join(adjusted, on, "left").drop("__p", *[f"__k{i}" for i in range(len(by))])
