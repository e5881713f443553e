"""SimHash fingerprints and their near-duplicate groups by a binary-trie self-join.

Fingerprints are cut into blocks; by the ring form of the pigeonhole principle
(Qin and Xiao, "Pigeonring") two that differ in at most `bits` places have a
rotation of the blocks where every prefix of l blocks holds at most
l * bits / blocks of the differences. For each rotation the distinct
fingerprints are dealt out by their first block, which must be equal, and every
bucket is a binary trie (a sorted array; a node is a range) that is joined with
itself: pairs of nodes go down together, add up differing bits and end when the
budget of their depth is exceeded. Pairs inside one known component end as
well, and a task returns a spanning forest, so a ball of near copies costs
neither memory nor rows in the square of its size.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows, scratch, skew
from .components import connected, merge

SEED = 42
#: Fingerprints in one trie; a larger bucket is joined as pairs of chunks.
TRIE_ROWS = 1 << 16
#: Node pairs that are expanded at once.
FRONTIER = 1 << 16
#: The same where pairs are returned; merging costs time for each step, so it takes larger ones.
PAIRS_FRONTIER = 1 << 14


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits; 0 without words. A bit is set where over half the shingles' XXH64 have it."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    line = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(ws))
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.array([digest(line[s:e], SEED) for s, e in cuts], dtype="<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def blocks(bits: int) -> list[int]:
    """Widths of bits + 1 blocks."""
    m = bits + 1
    return [64 // m + (i < 64 % m) for i in range(m)]


def budgets(bits: int) -> np.ndarray:
    """Differing bits allowed after each depth, by rotation."""
    widths, out = blocks(bits), []
    m = len(widths)
    for r in range(m):
        ring = widths[r:] + widths[:r]
        out.append(np.repeat([(i + 1) * bits // m for i in range(m)], ring))
    return np.array(out, dtype=np.int8)


def rotate(values: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return values if not by else (values << np.uint64(by)) | (values >> np.uint64(64 - by))


def trie_forest(values: np.ndarray, rotation: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    """Component labels of the entries of many tries, joined as by trie_pairs()."""
    steps = trie_pairs(values, rotation, lo, mid, hi, bits)
    while True:
        try:
            next(steps)
        except StopIteration as end:
            return end.value


def trie_pairs(
    values: np.ndarray,
    rotation: np.ndarray,
    lo: np.ndarray,
    mid: np.ndarray,
    hi: np.ndarray,
    bits: int,
    labels: np.ndarray | None = None,
) -> Generator[tuple[np.ndarray, np.ndarray], np.ndarray | None, np.ndarray]:
    """All near pairs of entries whose `labels` differ, of many tries joined with themselves.

    Each trie is a range lo..hi of `values`, sorted. Where mid < hi the ranges
    lo..mid and mid..hi, each sorted, are two tries to be joined with each other.
    Without `labels`, near pairs are merged instead of returned, and the labels
    of their components are the generator's value. New labels may be sent in
    answer to pairs.
    """
    n, allowed = len(values), budgets(bits)
    merging = labels is None
    labels = np.arange(n) if merging else labels
    changes = None
    cumulated: dict[int, np.ndarray] = {}

    def ones(depth: int) -> np.ndarray:
        if depth not in cumulated:
            out = np.zeros(n + 1, np.int32)
            np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), out=out[1:], dtype=np.int32)
            cumulated[depth] = out
        return cumulated[depth]

    alone = mid >= hi
    first = np.where(alone, hi, mid)
    second = np.where(alone, lo, mid)
    stack = [(0, lo, first, second, hi, np.zeros(len(lo), np.int8), rotation)]
    while stack:
        depth, a0, a1, b0, b1, err, rot = stack.pop()
        if len(a0) > (FRONTIER if merging else PAIRS_FRONTIER):
            half = len(a0) // 2
            stack.append((depth, *(x[half:] for x in (a0, a1, b0, b1, err, rot))))
            stack.append((depth, *(x[:half] for x in (a0, a1, b0, b1, err, rot))))
            continue
        if changes is None:
            changes = np.zeros(n, np.int64)
            np.cumsum(labels[1:] != labels[:-1], out=changes[1:])
        known = (labels[a0] == labels[b0]) & (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0])
        a0, a1, b0, b1, err, rot = (x[~known] for x in (a0, a1, b0, b1, err, rot))
        if not len(a0):
            continue
        own = a0 == b0
        area = (a1 - a0) * (b1 - b0)
        small = (area <= 16) | (depth >= 64)
        if small.any():
            s0, size, width, t0 = a0[small], area[small], (b1 - b0)[small], b0[small]
            pair = np.repeat(np.arange(len(s0)), size)
            cell = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            i, j = s0[pair] + cell // width[pair], t0[pair] + cell % width[pair]
            near = np.bitwise_count(values[i] ^ values[j]) <= bits
            near &= labels[i] != labels[j]
            if not merging:
                near &= (s0 != t0)[pair] | (i < j)
                fresh = yield i[near], j[near]
                if fresh is not None:
                    labels, changes = fresh, None
            elif near.any():
                labels, changes = merge(labels, i[near], j[near]), None
            large = ~small
            a0, a1, b0, b1, err, rot, own = (x[large] for x in (a0, a1, b0, b1, err, rot, own))
            if not len(a0):
                continue
        count = ones(depth)
        am = a1 - (count[a1] - count[a0])
        bm = b1 - (count[b1] - count[b0])
        other = ~own
        children = [
            (a0, am, b0, bm, err),
            (am, a1, bm, b1, err),
            (a0, am, bm, b1, err + np.int8(1)),
            tuple(x[other] for x in (am, a1, b0, bm, err + np.int8(1))),
        ]
        limit = allowed[rot, depth]
        rots, limits = [rot, rot, rot, rot[other]], [limit, limit, limit, limit[other]]
        parts = [np.concatenate([c[k] for c in children]) for k in range(5)]
        rot, limit = np.concatenate(rots), np.concatenate(limits)
        p0, p1, q0, q1, err = parts
        good = (p1 > p0) & (q1 > q0) & (err <= limit) & ~((p0 == q0) & (p1 - p0 < 2))
        if good.any():
            stack.append((depth + 1, *(x[good] for x in (p0, p1, q0, q1, err, rot))))
    return labels


def _forest_of(table: pa.Table, bits: int) -> pa.RecordBatch:
    """Links (a, b) of the complete tries in `table`, sorted by trie."""
    value = table["value"].to_numpy().view(np.uint64)
    trie, side, rot = (table[x].to_numpy() for x in ("trie", "side", "rot"))
    order = np.lexsort((value, side, trie))
    value, trie, side, rot = value[order], trie[order], side[order], rot[order]
    lo = np.flatnonzero(np.concatenate(([True], trie[1:] != trie[:-1])))
    hi = np.append(lo[1:], len(trie))
    mid = hi - np.add.reduceat(side.astype(np.int64), lo)
    # A pair of chunks has both sides; what has one side only and is marked so has no partner here.
    labels = trie_forest(value, rot[lo].astype(np.int64), lo, mid, hi, bits)
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    offsets = np.concatenate(([0], np.cumsum(blocks(bits))))[:-1]
    a, b = value[linked], value[labels[linked]]
    for r, off in enumerate(offsets):
        at = rot[linked] == r
        a[at], b[at] = rotate(a[at], 64 - int(off)), rotate(b[at], 64 - int(off))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def turned(fps: DataFrame, bits: int, more: list[str], trie_rows: int = TRIE_ROWS) -> DataFrame:
    """(trie, rot, side, value and the columns `more`): `fps` (fp long) as entries of the tries that they meet in."""
    widths = blocks(bits)
    offsets = [sum(widths[:r]) for r in range(len(widths))]
    ways = []
    for r, (off, width) in enumerate(zip(offsets, widths, strict=True)):
        value = F.col("fp") if not off else F.expr(f"shiftleft(fp, {off}) | shiftrightunsigned(fp, {64 - off})")
        ways.append(F.struct(F.lit(r).cast("byte").alias("rot"), value.alias("value"), F.shiftrightunsigned(value, 64 - width).alias("head")))
    rows = fps.select(*more, F.explode(F.array(*ways)).alias("x")).select(*more, "x.*")
    hot = rows.groupBy("rot", "head").count().where(F.col("count") > trie_rows)
    hot = scratch.keep(hot.select("rot", "head", F.ceil(F.col("count") / trie_rows).cast("int").alias("c")), "hot-tries")
    if hot.isEmpty():
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0).cast("byte")})
    else:
        # Chunk x of c meets every chunk y: the pair (min, max) is a trie of its own.
        own = F.when(F.col("c").isNull(), 0).otherwise(F.pmod(F.xxhash64("value"), F.col("c")).cast("int"))
        rows = (
            rows.join(hot, ["rot", "head"], "left")
            .withColumn("x", own)
            .withColumn("y", F.explode(F.sequence(F.lit(0), F.coalesce("c", F.lit(1)) - 1)))
            .select(*more, "rot", "value", "head", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).cast("byte").alias("side"))
        )
    trie = F.xxhash64("rot", "head", "i", "j").alias("trie")
    return rows.select(trie, "rot", "side", "value", *more)


def links(fps: DataFrame, bits: int = 4, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints `fps` (fp long) that differ in at most `bits` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= 1 << 18:
                table = pa.Table.from_batches(waiting)
                trie = table["trie"].to_numpy()
                cut = int(np.searchsorted(trie, trie[-1]))
                if cut:
                    yield _forest_of(table.slice(0, cut), bits)
                waiting = table.slice(cut).combine_chunks().to_batches()
                n = len(trie) - cut
        if n:
            yield _forest_of(pa.Table.from_batches(waiting), bits)

    dealt = turned(fps, bits, [], trie_rows).repartition(scratch.partitions(fps.sparkSession), "trie")
    return dealt.sortWithinPartitions("trie").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs` (doc_id, text).

    Documents whose fingerprints differ in at most `bits` bits are linked;
    component_id is the smallest doc_id that can be reached. Null and empty
    texts have fingerprint 0 and are linked like any other. Repeated rows stay,
    a null doc_id is never a component_id unless its whole component has none.
    Very long texts are fingerprinted whole. No rows give no rows; further
    columns are ignored.
    """
    prints = scratch.keep(with_fingerprint(docs, shingle), "fingerprints")
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    roots = scratch.keep(connected(links(classes.select("fp"), bits)).withColumnRenamed("node", "fp"), "roots")
    linked = scratch.keep(roots.join(classes, "fp"), "linked")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    of_linked = skew.joined(linked.select("fp", "root", "n"), scratch.keep(lowest, "lowest"), "root", "members")
    alone = classes.join(roots, "fp", "left_anti").select("fp", "n", F.col("first").alias("component_id"))
    of_class = scratch.keep(alone.union(of_linked.select("fp", "n", "component_id")), "components")
    return skew.joined(prints, of_class, "fp", "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """One row of every near-duplicate group, with all columns of `docs`; see skew.first_of_groups()."""
    made = rows.added(docs, ["text"], "__node long", lambda text: [np.array([fingerprint(t.as_py(), shingle) for t in text], np.uint64).view(np.int64)])
    described = scratch.keep(made, "described")
    roots = connected(links(described.select(F.col("__node").alias("fp")).distinct(), bits))
    return skew.first_of_groups(described, roots, docs.columns)


def op4_simhash_trie(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see near_groups()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_groups(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


__all__ = ["fingerprint", "keep_one", "links", "near_groups", "op4_simhash_trie", "trie_forest", "trie_pairs"]
