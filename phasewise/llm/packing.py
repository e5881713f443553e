"""Best-fit packing of token sequences into bins of several permitted lengths.

Documents are dealt by hash into shards of about `SHARD` pieces, each packed by
best-fit decreasing: a piece goes to the open bin that it leaves the least room
in. Where none has room a bin is opened, and the permitted lengths are weighed
together: each is filled in thought with the largest pieces still to come and
shrunk to what it then holds, and the one that costs least for each token in it
is opened. In the end every bin shrinks to the least permitted length that holds
its contents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .vocabularies import FOLDER, VOCABULARY, vocabulary

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: cost(c) = OVERHEAD + c + c * c / QUADRATIC, in tokens: a bin's fixed cost and that of attention.
OVERHEAD, QUADRATIC = 256.0, 16384.0
#: Pieces in a shard, about.
SHARD = 8192

PACKED = "doc_id long, piece int, start long, n_tokens int, bin_id long, capacity int, bin_offset int"


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / QUADRATIC


class ToCome:
    """How many pieces of each length are still to be packed."""

    def __init__(self, lengths: Sequence[int]):
        self.count = Counter(map(int, lengths))
        self.marks = sum(1 << n for n in self.count)  # bit n is set where a piece of n tokens is to come

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.marks ^= 1 << n

    def fill(self, room: int) -> int:
        """Tokens of the pieces that fill `room`, the largest that fits first."""
        marks, left = self.marks, room
        while fitting := marks & ((2 << left) - 1):
            n = fitting.bit_length() - 1
            left -= n * min(self.count[n], left // n)
            marks &= (1 << n) - 1
        return room - left


def size_to_open(n: int, sizes: Sequence[int], to_come: ToCome) -> int:
    """The permitted length (of the rising `sizes`) that costs least a token, for a bin that begins with a piece of n tokens."""
    best = None
    for c in sizes[bisect_left(sizes, n) :]:
        full = n + to_come.fill(c - n)
        price = cost(sizes[bisect_left(sizes, full)]) / full
        if best is None or price < best[0]:
            best = price, c
    return best[1]


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin and final capacity of it, for each of `lengths` (longest first, none over the largest)."""
    sizes = sorted(capacities)
    to_come = ToCome(lengths)
    room: dict[int, list[int]] = {}
    marks = 0  # bit r is set where some open bin has r tokens of room
    used: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(map(int, lengths)):
        to_come.take(n)
        fitting = marks >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                marks ^= 1 << r
        else:
            r = size_to_open(n, sizes, to_come)
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if r > n:
            room.setdefault(r - n, []).append(b)
            marks |= 1 << (r - n)
    final = np.array(sizes)[np.searchsorted(sizes, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, final[bins] if used else final


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, key, n): tokens of each whole text and one end mark; key is a hash of the text. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(vocabulary_path).encode
        for batch in batches:
            n = [len(encode(t.as_py() or "")) + 1 for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(n, pa.int64())], ["doc_id", "key", "n"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, key long, n long")


def packed(counts: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """PACKED: where every piece of `counts` (doc_id, key, n) lies.

    A document over the largest capacity is cut into pieces of that size and a
    rest; start is the token its piece begins at. Every row is packed, repeated
    ones and those with a null doc_id too; no rows give no rows. bin_id is
    unique over all shards.
    """
    most = max(capacities)
    pieces = counts.select("doc_id", "key", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))).alias("piece", "start"), "n")
    pieces = pieces.select("doc_id", "key", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(most)).cast("int").alias("n_tokens"))
    shards = max(1, -(-pieces.count() // SHARD))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", "piece"), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece", "key"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, final = pack(group["n_tokens"].tolist(), capacities)
        shard = int(group["shard"].iloc[0])
        return group[["doc_id", "piece", "start", "n_tokens"]].assign(bin_id=(shard << 32) + bins, capacity=final, bin_offset=offsets)

    return pieces.groupBy("shard").applyInPandas(run, PACKED)


def pack_documents(docs: DataFrame, vocabulary_path: str = f"{FOLDER}/{VOCABULARY}", capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """`docs` (doc_id, text) tokenised whole, however long, and packed; see packed(). A null or empty text is one end mark."""
    return packed(scratch.keep(token_counts(docs, vocabulary_path), "token-counts"), capacities)


def op2_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies; see pack_documents()."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
