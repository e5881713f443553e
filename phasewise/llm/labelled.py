"""The bounded sample of labelled texts that the classifiers are fitted on, and small fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Labelled rows that a model is fitted on at most: those with the smallest hash of doc_id.
MOST_ROWS = 20_000


def held_out(modulus: int, remainder: int) -> Column:
    """Whether the doc_id's CRC-32 (of its decimal text) has this remainder; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, learnt: Column, most: int = MOST_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents where `learnt` holds.

    Null labels, ids and texts are left out; of several labels of a document
    the largest holds. The labels side is at most `most` rows of two numbers,
    which is why it is broadcast.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).where(learnt)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scratch.keep(texts.join(F.broadcast(chosen), "doc_id"), "labelled")


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last one is the constant and has no penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w
