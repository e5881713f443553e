"""Quality classifier on random-indexing word vectors.

A word's vector is the sum of the sparse random index vectors of its neighbours
in all documents, at a hashed place of a fixed table; the sums are whole numbers
that tasks add up on their own and Spark in the end. A document is the mean of
its words' vectors, the mean of the index vectors of its words' shapes, and a
few lengths and ratios. A two-layer network of numpy arrays, fitted on a bounded
sample of labelled documents, rates it, and one temperature, fitted on texts it
did not learn from, calibrates the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows, spans
from .labelled import MOST_ROWS, held_out, sample

#: Places of the word table and of shapes, and lengths of their vectors; these bound the model.
WORDS, SHAPES, WORD_DIMS, SHAPE_DIMS = 1 << 16, 1 << 10, 32, 48
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 128, 3e-3
#: Bytes of text that are turned into vectors at once.
CHUNK = 1 << 19
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = ord("A"), ord("a"), ord("9"), ord("a")


def index_vectors(places: int, dims: int, seed: int) -> np.ndarray:
    """Sparse random vectors of -1, 0 and 1, a quarter of them not 0."""
    x = np.random.default_rng(seed).integers(0, 8, (places, dims))
    return (x == 0).astype(np.int8) - (x == 1).astype(np.int8)


INDEX, SHAPE_INDEX = index_vectors(WORDS, WORD_DIMS, 1), index_vectors(SHAPES, SHAPE_DIMS, 2).astype(np.float32)
#: The index vector of a word as a left neighbour.
LEFT_INDEX = np.roll(INDEX, 1, axis=1)


def words_of(column: pa.Array) -> tuple[np.ndarray, ...]:
    """data, offsets, rows, places and hashes of all words of the column."""
    data, off = spans.buffers(column)
    starts, ends, rows = spans.words(data, off)
    h = spans.word_hashes(data, starts, ends)
    return data, off, starts, ends, rows, h


def shape_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Place of each word's shape: its character classes, runs of one class taken as one."""
    if not len(starts):
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    before = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(new, out=before[1:])
    s, e = before[starts], before[ends]
    h = spans.word_hashes(kind[new], s, e)
    return (h >> spans.U(40)).astype(np.int64) % SHAPES


def _distinct(code: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Different codes in each of n rows."""
    if not len(code):
        return np.zeros(n, np.int64)
    wide = int(code.max()) + 1
    return np.bincount(np.unique(rows * wide + code) // wide, minlength=n)


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of `values` by `rows`, which rise."""
    out = np.zeros((n, values.shape[1]), np.float64)
    if len(rows):
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        out[rows[first]] = np.add.reduceat(values, first, axis=0)
    return out


@dataclass
class Quality:
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = forward(self.layers, np.clip((x - self.mean) / self.scale, -8, 8))[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_vectors(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """One vector for each text; null and empty texts have 0."""
    parts = [np.zeros((0, WORD_DIMS + SHAPE_DIMS + 6))]
    for a, b in spans.chunks(column, CHUNK):
        data, off, starts, ends, rows, h = words_of(column.slice(a, b - a))
        n = b - a
        count = np.bincount(rows, minlength=n)
        some = np.maximum(count, 1)[:, None]
        total = np.zeros((n, WORD_DIMS))
        for at in range(0, len(h), 1 << 17):
            part = slice(at, at + (1 << 17))
            total += _sums(table[(h[part] >> spans.U(48)).astype(np.int64)], rows[part], n)
        shape = shape_places(data, starts, ends)
        seen, where = np.unique(shape, return_inverse=True)
        histogram = np.bincount(rows * len(seen) + where, minlength=n * len(seen)).reshape(n, len(seen)) if len(seen) else np.zeros((n, 0))
        code, _ = spans.codes(data, starts, ends)
        distinct = _distinct(code, rows, n)
        gram, whole = spans.gram_codes(code, rows, 3)
        g_rows = rows[: len(gram)][whole]
        grams = _distinct(gram[whole], g_rows, n) / np.maximum(np.bincount(g_rows, minlength=n), 1)
        chars = np.diff(off)
        lines = np.diff(np.concatenate(([0], np.cumsum(data == 10)))[off])
        extra = np.column_stack([np.log1p(count), distinct / some[:, 0], grams, chars / some[:, 0] / 8, np.log1p(lines), count == 0])
        parts.append(np.column_stack([total / some, histogram @ SHAPE_INDEX[seen] / some, extra]))
    return np.concatenate(parts)


def add_neighbours(sums: np.ndarray, column: pa.Array) -> None:
    """Add to each word's place the index vectors of the words beside it in `column`."""
    for a, b in spans.chunks(column, CHUNK):
        _, _, _, _, rows, h = words_of(column.slice(a, b - a))
        place = (h >> spans.U(48)).astype(np.int64)
        near = rows[1:] == rows[:-1]
        left, right = place[:-1][near], place[1:][near]
        for own, other, index in ((left, right, INDEX), (right, left, LEFT_INDEX)):
            for at in range(0, len(own), 1 << 18):
                order = np.argsort(own[at : at + (1 << 18)], kind="stable") + at
                places = own[order]
                first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
                sums[places[first]] += np.add.reduceat(index[other[order]], first, axis=0, dtype=np.int64)


def word_table(docs: DataFrame) -> np.ndarray:
    """Random-indexing vectors of the hashed words of all `docs` (text), none longer than 1.

    The driver gets WORDS rows of WORD_DIMS numbers at most, whatever the table holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((WORDS, WORD_DIMS), np.int64)
        for batch in batches:
            add_neighbours(sums, batch["text"])
        place = np.flatnonzero(sums.any(axis=1))
        for at in range(0, len(place), 1 << 13):
            part = place[at : at + (1 << 13)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(x) for x in sums[part].T.copy())], ["place", *names])

    names = [f"x{i}" for i in range(WORD_DIMS)]
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in ["place", *names]))
    found = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    table = np.zeros((WORDS, WORD_DIMS), np.float32)
    table[found["place"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in names])
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1.0)


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, (hidden @ w2 + b2)[:, 0]


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Two layers by Adam with weight decay."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    m, v = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    step, steps = 0, EPOCHS * -(-len(x) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            i = order[at : at + BATCH]
            hidden, z = forward(layers, x[i])
            slope = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[i])[:, None] / len(i)
            back = slope @ layers[2].T * (1 - hidden**2)
            grads = [x[i].T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            rate = RATE * (1 - step / steps)
            step += 1
            for k, g in enumerate(grads):
                g = g + 1e-4 * layers[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                layers[k] = layers[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def labelled_vectors(texts: DataFrame, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document vectors and labels of `texts` (doc_id, text, y), a bounded sample, in the order of doc_id and text."""
    at = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = document_vectors(batch["text"], at.value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sha"], batch["y"], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "sha", "y", "x"])

    narrow = texts.select("doc_id", F.sha2("text", 256).alias("sha"), F.col("y").cast("int"), "text")
    found = narrow.mapInArrow(run, "doc_id long, sha string, y int, x array<double>").orderBy("doc_id", "sha").toArrow()
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(len(found), -1) if len(found) else np.zeros((0, 1))
    return x, found["y"].to_numpy().astype(float)


def fit(texts: DataFrame, table: np.ndarray | None = None) -> Quality | None:
    """A model of the labelled `texts` (doc_id, text, y); None without both labels.

    `table` is the word_table() of the corpus, by default of the texts. The
    driver holds the vectors of the sample, not its texts.
    """
    table = word_table(texts) if table is None else table
    x, y = labelled_vectors(texts, table)
    if not 0 < y.sum() < len(y):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8)
    apart = np.arange(len(x)) % 5 == 4
    layers = train(x[~apart], y[~apart])
    z = forward(layers, x[apart])[1]
    grid = np.geomspace(0.25, 8.0, 101)
    loss = [np.sum(np.logaddexp(0, z / t) - y[apart] * z / t) + np.log(t) ** 2 for t in grid]
    return Quality(table, mean, scale, layers, float(grid[int(np.argmin(loss))]))


def rated(docs: DataFrame, model: Quality | None) -> DataFrame:
    """rows.ROW and quality (0 to 1); without a model all have 0.5."""
    at = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> list:
        m = at.value
        return [np.full(len(text), 0.5) if m is None else m.scores(document_vectors(text, m.table))]

    return rows.added(docs, ["text"], "quality double", run)


def scored(docs: DataFrame, model: Quality | None) -> DataFrame:
    """`docs` with quality, in place of a column of that name.

    Null and empty texts are rated like any other, by vectors of 0; very long
    ones are read whole; repeated rows are rated each; no rows give no rows.
    """
    return rows.spread(rated(docs, model), docs.columns, ["quality"])


def learnt(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Quality | None:
    """The model of `docs` and `labels`: word vectors of all documents, the network of `most` labelled rows at most."""
    return fit(sample(docs, labels, "quality", ~held_out(3, 1), most), word_table(docs))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, most: int = MOST_ROWS) -> DataFrame:
    """The rows of `docs` that score `least` or more, as they were."""
    return rows.own(rated(docs, learnt(docs, labels, most)).where(F.col("quality") >= least), docs.columns)


def op8_random_indexing(spark: SparkSession, sf_dir: str, most: int = MOST_ROWS) -> DataFrame:
    """Score and verdict of every document; see scored(). Without both labels all scores are 0.5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), most))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"))
