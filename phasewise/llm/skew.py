"""Joins and choices in which one key may have a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows, scratch

#: A key is hot with more than this share of the rows, so there are fewer hot keys than its inverse.
HOT = 1e-3


def joined(many: DataFrame, one: DataFrame, key: str, weight: str) -> DataFrame:
    """`many` with the columns of `one`, which has a row for each key, with the number of rows of `many` in `weight`.

    Rows of hot keys stay where they are: their side of the join, fewer than
    1 / HOT rows, is broadcast. Both tables are read twice, so they should be
    kept ones.
    """
    total = one.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > HOT * total
    few, rest = one.where(hot).drop(weight), one.where(~hot).drop(weight)
    cold = many.join(F.broadcast(few.select(key)), key, "left_anti")
    return many.join(F.broadcast(few), key).union(cold.join(rest, key))


def first_of_groups(described: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each group of `described` (rows.ROW and __node), a kept table: the smallest doc_id, nulls last.

    `roots` has (node, root) of nodes that share a group with others. Of rows
    with this doc_id the text with the smallest SHA-256 stays, nulls last, and
    of rows with this text too the one whose other columns have the smallest
    hash. A group is brought down to its first row by partial aggregates before
    any row is shuffled.
    """
    row = F.col(rows.ROW)
    sha = F.coalesce(F.sha2(row["text"].cast("string"), 256), F.lit("~"))
    key = {"__none": row["doc_id"].isNull(), "__id": F.coalesce(row["doc_id"].cast("long"), F.lit(0)), "__sha": sha}
    keyed = described.withColumns(key)
    texts = keyed.groupBy("__node", *key).agg(F.count("*").alias("__n"))
    best = texts.groupBy("__node").agg(F.min(F.struct(*key, "__n")).alias("best"))
    rooted = best.join(roots.withColumnRenamed("node", "__node"), "__node", "left")
    first = rooted.groupBy(F.coalesce("root", "__node")).agg(F.min("best").alias("best")).select("best.*")
    first = scratch.keep(scratch.narrow(first, described.count()), "first-rows")
    kept = keyed.join(first, [*key])
    hashed = [row[c] for c in columns if c not in ("doc_id", "text") and "map<" not in described.schema[rows.ROW].dataType[c].dataType.simpleString()]
    again = kept.where("__n > 1").groupBy(*key).agg(F.min_by(rows.ROW, F.xxhash64(*hashed) if hashed else F.lit(0)).alias(rows.ROW))
    return rows.own(kept.where("__n = 1").select(rows.ROW).union(again.select(rows.ROW)), columns)
