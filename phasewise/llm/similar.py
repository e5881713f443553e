"""Near-duplicate groups of documents by the exact Jaccard similarity of word shingles.

SimHash fingerprints of five-word shingles that differ in at most `bits` places,
found by the trie join of `simhash`, are candidates. A sketch of minima, which
travels with the fingerprint, leaves out pairs far from the threshold in the
join's own task. Texts are compared shingle by shingle in the end, and only
pairs of `least` or more are linked.

A task of that join returns a spanning forest of its candidate pairs, so a ball
of near copies costs rows in its size, not in its square. All texts of a
component of candidates then meet, each once, and are compared with each other
where their fingerprints and sketches are near: first with those that look most
similar, then with all that are not yet connected. Here too only a spanning
forest is returned. A component of very many texts is cut into chunks, and every
pair of chunks meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks, rows, scratch, simhash, skew
from .components import connected, merge

SEED = 42
#: Minima in a sketch, a byte of each.
SKETCH = 64
#: Share of equal minima below which a pair is no candidate, less than the least similarity by three deviations.
SLACK = 0.15
#: Minima in a sketch that estimates a similarity closely, and four deviations of it.
LONG_SKETCH = 512
LONG_SLACK = 0.07
#: Most similar candidates that a text of a component is compared with first.
NAMED = 8
#: Texts and characters in a chunk of a component.
CHUNK, CHUNK_CHARS = 1 << 10, 1 << 23
#: Entries of tries that a task joins at once, about; a trie of more is joined alone.
ENTRIES = 1 << 16


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the lower-cased shingles; the whole text is one where it has fewer words."""
    ws = (text or "").lower().encode("utf-8", "surrogatepass").split()
    k = min(shingle, len(ws))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(ws[i : i + k]), SEED) for i in range(len(ws) - k + 1)] if ws else [], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


@cache
def _odd(size: int) -> np.ndarray:
    return np.random.default_rng(17).integers(0, 1 << 63, (2, size), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray, size: int = SKETCH) -> bytes:
    """The lowest byte of each of `size` minima; zeros without shingles."""
    low, step = np.full(size, np.iinfo(np.uint64).max, np.uint64), (1 << 18) // size
    for at in range(0, len(hashes), step):
        mixed = hashes[at : at + step, None] * _odd(size)[0] + _odd(size)[1]
        mixed ^= mixed >> np.uint64(32)
        np.minimum(low, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=0), out=low)
    return ((low ^ (low >> np.uint64(29))) & np.uint64(255)).astype(np.uint8).tobytes()


def _described(texts: pa.Array, shingle: int) -> list[pa.Array]:
    """Node (a hash of the words), fingerprint and sketch of each text."""
    out: list[tuple[int, int, bytes]] = []
    for t in texts:
        text = t.as_py()
        words = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())
        out.append((xxhash.xxh3_64_intdigest(words), simhash.fingerprint(text, shingle), sketch(shingles(text, shingle))))
    node, fp, minima = zip(*out, strict=True) if out else ((), (), ())
    signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
    return [*signed, pa.array(minima, pa.binary())]


def _forest(names: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) of what `labels` (places in `names`) connect."""
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    a, b = names[linked], names[labels[linked]]
    differ = a != b
    links = np.unique(np.stack((a[differ], b[differ])), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in links], ["a", "b"])


def candidates(nodes: DataFrame, bits: int, least_equal: int) -> DataFrame:
    """Spanning links (a, b) of the pairs of `nodes` (node, fp, sketch) with near fingerprints and `least_equal` equal minima or more."""
    step = (1 << 22) // SKETCH

    def forest(table: pa.Table) -> pa.RecordBatch:
        value = table["value"].to_numpy().view(np.uint64)
        trie, side, rot, node = (table[x].to_numpy() for x in ("trie", "side", "rot", "node"))
        order = np.lexsort((value, side, trie))
        value, trie, side, rot, node = (x[order] for x in (value, trie, side, rot, node))
        column = table["sketch"].combine_chunks()
        minima = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)[order]
        lo = blocks.borders(trie)
        lo, hi = lo[:-1], lo[1:]
        mid = hi - np.add.reduceat(side.astype(np.int64), lo)
        # One node has one label, in whatever tries it is.
        _, first, of = np.unique(node, return_index=True, return_inverse=True)
        labels = first[of]
        steps = simhash.trie_pairs(value, rot[lo].astype(np.int64), lo, mid, hi, bits, labels)
        fresh = None
        while True:
            try:
                i, j = steps.send(fresh)
            except StopIteration:
                return _forest(node, labels)
            fresh = None
            for at in range(0, len(i), step):
                p, q = i[at : at + step], j[at : at + step]
                near = (minima[p] == minima[q]).sum(axis=1, dtype=np.int32) >= least_equal
                if near.any():
                    fresh = labels = merge(labels, p[near], q[near])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.complete(batches, "trie", ENTRIES):
            yield forest(table)

    dealt = simhash.turned(nodes, bits, ["node", "sketch"], simhash.TRIE_ROWS)
    dealt = dealt.repartition(scratch.partitions(nodes.sparkSession), "trie").sortWithinPartitions("trie")
    return dealt.mapInArrow(run, "a long, b long")


def _similar(fp: np.ndarray, minima: np.ndarray, cut: list[np.ndarray], side: np.ndarray, least: float, bits: int, least_equal: int) -> np.ndarray:
    """Component labels of texts, `least` similar or more being linked; where both sides occur, pairs have one of each."""
    n = len(fp)
    size = np.array([len(x) for x in cut], np.int64)
    _, code = np.unique(np.concatenate(cut), return_inverse=True)
    own = np.split(code, np.cumsum(size)[:-1])
    marked = np.zeros(len(code), bool)
    labels = np.arange(n)
    two = side.min() != side.max()
    for most in (NAMED, n):
        for i in range(n):
            if two and side[i]:
                continue
            j = np.flatnonzero(side) if two else np.arange(i + 1, n)
            j = j[(labels[j] != labels[i]) & (np.bitwise_count(fp[j] ^ fp[i]) <= bits)]
            equal = (minima[j] == minima[i]).sum(axis=1, dtype=np.int32)
            j, equal = j[equal >= least_equal], equal[equal >= least_equal]
            if len(j) > most:
                j = j[np.argsort(-equal, kind="stable")[:most]]
            if not len(j):
                continue
            marked[own[i]] = True
            total = np.concatenate(([0], np.cumsum(marked[np.concatenate([own[k] for k in j])])))
            marked[own[i]] = False
            end = np.cumsum(size[j])
            both = total[end] - total[end - size[j]]
            good = both / np.maximum(1, size[i] + size[j] - both) >= least
            if good.any():
                labels = merge(labels, np.full(good.sum(), i), j[good])
    return labels


def verified(texts: DataFrame, least: float, shingle: int, bits: int, least_equal: int) -> DataFrame:
    """Spanning links (a, b) of `texts` (node, fp, sketch, root, text), a kept table, that are `least` similar or more and have one root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks.complete(batches, "met", CHUNK):
            at = blocks.borders(table["met"].to_numpy())
            for a, b in zip(at[:-1], at[1:], strict=True):
                rows = table.slice(a, b - a)
                fp, node, side = (rows[x].to_numpy() for x in ("fp", "node", "side"))
                minima = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
                cut = [shingles(t.as_py(), shingle) for t in rows["text"]]
                yield _forest(node, _similar(fp.view(np.uint64), minima, cut, side, least, bits, least_equal))

    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum(F.length("text")) / CHUNK_CHARS)).cast("int")
    large = scratch.keep(texts.groupBy("root").agg(chunks.alias("c")).where("c > 1"), "large-components")
    own = F.pmod(F.xxhash64("node"), F.coalesce("c", F.lit(1))).cast("int")
    met = texts.join(large, "root", "left").withColumn("x", own).withColumn("y", F.explode(F.sequence(F.lit(0), F.coalesce("c", F.lit(1)) - 1)))
    key = F.xxhash64("root", F.least("x", "y"), F.greatest("x", "y")).alias("met")
    dealt = met.select(key, (F.col("x") > F.col("y")).cast("byte").alias("side"), "node", "fp", "sketch", "text")
    dealt = dealt.repartition(scratch.partitions(texts.sparkSession), "met").sortWithinPartitions("met")
    return dealt.mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, least: float = 0.8, shingle: int = 5, bits: int = 16) -> DataFrame:
    """One row of every near-duplicate group, as skew.first_of_groups() chooses it.

    Texts whose sets of lower-cased shingles have a Jaccard similarity of
    `least` or more, and whose fingerprints differ in at most `bits` bits, are
    linked; groups are connected components. Null and empty texts are one
    group. All columns of `docs` are returned; no rows give no rows; very long
    texts are read whole.
    """
    described = rows.added(docs, ["text"], "__node long, __fp long, __sketch binary", lambda t: _described(t, shingle))
    described = scratch.keep(described, "described")
    own = F.col(rows.ROW)["text"]
    nodes = described.groupBy(F.col("__node").alias("node")).agg(F.min("__fp").alias("fp"), F.min("__sketch").alias("sketch"))
    nodes = scratch.keep(nodes, "nodes")
    first = W.partitionBy("node").orderBy("text")
    texts = described.select(F.col("__node").alias("node"), own.alias("text"))
    least_equal = int(np.ceil((least - SLACK) * SKETCH))
    near = scratch.keep(candidates(nodes, bits, least_equal), "candidates")
    roots = scratch.keep(connected(near), "components")
    some = texts.join(roots, "node", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    some = scratch.keep(some.join(roots, "node").join(nodes, "node"), "texts")
    scratch.release(docs.sparkSession)
    links = scratch.keep(verified(some, least, shingle, bits, least_equal), "similar")
    scratch.release(docs.sparkSession)
    return skew.first_of_groups(described.select(rows.ROW, "__node"), connected(links), docs.columns)
