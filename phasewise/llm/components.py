"""Connected components: within an array, and of a distributed edge table.

The distributed form alternates large-star and small-star steps (Kiveris et
al., "Connected Components in MapReduce and Beyond"). Neighbour minima come
from a partial aggregate and return by a join, so a hub with very many
neighbours is never gathered in one place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]; a label is the smallest index of its component."""
    a, b = labels[a], labels[b]
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
        a, b = labels[a], labels[b]
        differ = a != b
        a, b = a[differ], b[differ]
    return labels


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a long, b long); root is the component's smallest node.

    Self-links, repeated links and nulls are ignored; no links give no rows.
    """
    have = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    size, count = None, have.count()
    while True:
        both = have.select("u", "v").union(have.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # A link becomes two at most.
        new = scratch.keep(scratch.narrow(small, 2 * count), "stars")
        now = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        scratch.forget(have)
        have = new
        if tuple(now) == size:
            break
        size, count = tuple(now), now[0]
    roots = have.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = roots.union(have.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return scratch.narrow(roots, 2 * size[0])
