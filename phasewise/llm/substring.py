"""Removal of long passages that a document with a smaller doc_id also has.

The index is log-structured. Of the rolling hashes of every `gram` words in a
document, those that are the smallest of some window of `window` words are kept
("Winnowing", Schleimer et al.): two equal windows always keep the same one, so
a few per cent of the hashes find every shared window. A batch's kept hashes
become an immutable run sorted by hash. The new batch is merge-joined with the
runs; the words of the windows around hashes that several documents have are
compared by 128-bit BLAKE2b digests of their texts, so no rolling hash decides
what goes. Runs of one level are merged into one run of the next once there are
`fanout` of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows, scratch, spans

WINDOW = 50
GRAM = 12
#: Batches that a whole table is fed in, and runs of a level that are merged: two levels fill.
BATCHES, FANOUT = 4, 2
#: Windows in a batch of digests.
DIGESTS = 1 << 16


def _windows(word: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the window from each word on: its smallest gram hash, and whether it lies in one row."""
    if len(word) < window:
        return np.zeros(0, spans.U), np.zeros(0, bool)
    grams, _ = spans.gram_hashes(word, rows, gram)
    return spans.sliding_min(grams, window - gram + 1), rows[: len(rows) - window + 1] == rows[window - 1 :]


def anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(h, doc_id, key): the kept hashes of every document; key is text_key()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch["doc_id"].to_numpy(), batch["key"].to_numpy()
            for a, b in spans.chunks(batch["text"]):
                data, off = spans.buffers(batch["text"].slice(a, b - a))
                starts, ends, owner = spans.words(data, off)
                low, whole = _windows(spans.word_hashes(data, starts, ends), owner, window, gram)
                at = np.flatnonzero(whole)
                low, row = low[at], owner[at]
                new = np.ones(len(at), bool)
                new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
                low, row = low[new].view(np.int64), a + row[new]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (low, ids[row], keys[row])], ["h", "doc_id", "key"])

    return _keyed(docs).select("doc_id", "key", "text").mapInArrow(run, "h long, doc_id long, key long")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows that can take part: with a doc_id and a text."""
    return docs.where("doc_id is not null and text is not null").withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "key": text_key()}
    )


def text_key():
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64("text")


def _verified(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """(w1, w2, doc_id, key, start): windows of `candidates` (doc_id, key, text, found) whose kept hash is in found.

    w1 and w2 are the digest of the window's words joined by spaces, start is the word it starts at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, found = batch["doc_id"].to_numpy(), batch["key"].to_numpy(), batch["found"]
            for a, b in spans.chunks(batch["text"]):
                data, off = spans.buffers(batch["text"].slice(a, b - a))
                starts, ends, rows = spans.words(data, off)
                low, whole = _windows(spans.word_hashes(data, starts, ends), rows, window, gram)
                mine = found.slice(a, b - a)
                owner = np.repeat(np.arange(b - a), mine.value_lengths().fill_null(0).to_numpy())
                wanted = spans.mix(mine.flatten().to_numpy().view(spans.U)) + owner.astype(spans.U)
                here = np.isin(spans.mix(low) + rows[: len(low)].astype(spans.U), wanted) & whole
                line, begin, end = spans.joined(data, starts, ends)
                first = np.searchsorted(rows, np.arange(b - a))
                every = np.flatnonzero(here)
                for i in range(0, len(every), DIGESTS):
                    at = every[i : i + DIGESTS]
                    cuts = zip(begin[at].tolist(), end[at + window - 1].tolist(), strict=True)
                    w = b"".join(hashlib.blake2b(line[s:e], digest_size=16).digest() for s, e in cuts)
                    w = np.frombuffer(w, np.int64).reshape(-1, 2)
                    row = a + rows[at]
                    cols = [w[:, 0].copy(), w[:, 1].copy(), ids[row], keys[row], (at - first[rows[at]]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["w1", "w2", "doc_id", "key", "start"])

    narrow = candidates.select("doc_id", "key", "text", "found")
    return narrow.mapInArrow(run, "w1 long, w2 long, doc_id long, key long, start int")


class WindowIndex:
    """Runs of kept hashes under `path`, a folder that all executors share.

    `history` of add() must hold the texts of the documents added before; only
    those that share a hash with the batch are read from it again.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.path, self.window, self.gram, self.fanout = spark, path.rstrip("/"), window, gram, fanout

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        """Names of the committed runs, `level-number`, oldest first."""
        at, fs = self._fs()
        if not fs.exists(at):
            return []
        new = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        done = [x for x in names if x[0].isdigit() and fs.exists(new(f"{self.path}/{x}/_SUCCESS"))]
        return sorted(done, key=lambda x: int(x.split("-")[1]))

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        out = rows.repartition(scratch.partitions(self.spark), "h").sortWithinPartitions("h", "doc_id")
        out.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read([name])

    def read(self, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/{x}" for x in names]
        return self.spark.read.schema("h long, doc_id long, key long").parquet(*paths)

    def compact(self) -> None:
        """Merge the runs of each level that has `fanout` of them; the old ones go after the new one is complete."""
        level = 0
        while True:
            names = self.runs()
            full = [x for x in names if int(x.split("-")[0]) == level]
            if len(full) >= self.fanout:
                number = max(int(x.split("-")[1]) for x in names) + 1
                self._write(self.read(full).distinct(), f"{level + 1}-{number}")
                for x in full:
                    scratch.drop(self.spark, f"{self.path}/{x}")
            elif not any(int(x.split("-")[0]) > level for x in names):
                return
            level += 1

    def add(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Add the batch; (doc_id, key, starts) of its documents with windows that a smaller doc_id has too.

        starts holds the word indices where such windows begin, or only -1 for
        all windows. What earlier batches were told does not change.
        """
        before = self.runs()
        number = max((int(x.split("-")[1]) for x in before), default=-1) + 1
        own = self._write(anchors(batch, self.window, self.gram), f"0-{number}")
        keys = own.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        old = self.read(before) if before else None
        if old is None:
            shared = keys.where("low < high")
        else:
            past = old.groupBy("h").agg(F.min("doc_id").alias("past"))
            shared = keys.join(past.hint("merge"), "h", "left").where("low < high or past < high")
        shared = scratch.keep(scratch.narrow(shared.select("h"), own.count()), "shared")
        rows, texts = own, batch
        if old is not None:
            rows = own.union(old)
            texts = batch.select("doc_id", "text").union(history.select("doc_id", "text"))
        found = rows.join(shared.hint("merge"), "h", "left_semi").groupBy("doc_id", "key").agg(F.collect_set("h").alias("found"))
        texts = _keyed(texts).select("doc_id", "key", "text")
        # Of equal texts only the first one's windows count for others; all windows of a later one are in the first.
        whole = texts.select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("sha"))
        first = whole.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
        first = scratch.keep(first.select("sha", "low"), "first-copies")
        copies = whole.join(first, "sha").where("low < doc_id").select("doc_id", "key")
        copies = scratch.keep(copies, "copies")
        found = found.join(copies, ["doc_id", "key"], "left_anti")
        candidates = scratch.keep(texts.join(found, ["doc_id", "key"]), "candidates")
        scratch.release(self.spark)
        windows = scratch.keep(_verified(candidates, self.window, self.gram), "windows")
        scratch.forget(candidates)
        most = windows.count()
        low = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
        low = scratch.keep(scratch.narrow(low.drop("high"), most), "first-windows")
        scratch.release(self.spark)
        hits = windows.join(low, ["w1", "w2"]).where("low < doc_id")
        hits = hits.groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))
        hits = hits.union(copies.select("doc_id", "key", F.array(F.lit(-1)).alias("starts")).distinct())
        if old is not None:
            mine = own.select("doc_id", "key").distinct()
            hits = hits.join(mine, ["doc_id", "key"], "left_semi")
        out = scratch.keep(scratch.narrow(hits, most + copies.count()), "hits")
        for table in (windows, shared, first, copies, low):
            scratch.forget(table)
        self.compact()
        scratch.release(self.spark)
        return out


def _kept(word_count: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Whether each word stays."""
    if len(starts) and starts[0] < 0:
        return np.full(word_count, word_count < window)
    edge = np.zeros(word_count + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) == 0


def rewritten(docs: DataFrame, hits: DataFrame, window: int = WINDOW, how: str = "left") -> DataFrame:
    """rows.ROW, n_removed and kept_text of `docs`: the text without the words that `hits` cover.

    White space before a kept word stays, so lines stay lines. Without hits the
    text is unchanged and n_removed is 0; how="inner" leaves such rows out.
    """
    row = F.col(rows.ROW)
    whole = rows.packed(docs).withColumns({"id": row["doc_id"].cast("long"), "key": F.xxhash64(row["text"])})
    left = whole.join(hits.withColumnRenamed("doc_id", "id"), ["id", "key"], how)

    def run(text: pa.Array, starts: pa.Array) -> list:
        removed, texts = np.zeros(len(text), np.int64), []
        for i, (t, covered) in enumerate(zip(text, starts, strict=True)):
            t = t.as_py()
            if not covered.is_valid or t is None:
                texts.append(t)
                continue
            raw = np.frombuffer(t.encode(), np.uint8)
            begin, end, _ = spans.words(raw, np.array([0, len(raw)]))
            stays = _kept(len(begin), covered.values.to_numpy(), window)
            removed[i] = len(begin) - int(stays.sum())
            gap = np.concatenate(([0], end[:-1]))
            edge = np.zeros(len(raw) + 1, np.int64)
            edge[gap[~stays]] += 1
            edge[end[~stays]] -= 1
            texts.append(raw[np.cumsum(edge[:-1]) == 0].tobytes().decode().lstrip(" \t\n\v\f\r"))
        return [removed, pa.array(texts, pa.string())]

    return rows.mapped(left, ["text"], ["starts"], "n_removed long, kept_text string", run)


def word_line(text) -> F.Column:
    """The words joined by single spaces; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\v\f\r", "     ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def word_count(line):
    return F.when(line == "", F.lit(0)).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")


def duplicate_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(doc_id, key, starts) for a whole table: it passes through an index in `batches` of rising doc_id.

    As the batches rise, every window of a smaller doc_id is in the index or in
    the batch itself, so the result does not depend on their number. A batch is
    about as large as all before it, so all reading of history together is less
    than one more reading of the table.
    """
    spark = docs.sparkSession
    shares = [2.0 ** (i - batches) for i in range(1, batches)]
    cuts = docs.where("doc_id is not null").approxQuantile("doc_id", shares, 0.01) if shares else []
    index = WindowIndex(spark, scratch.new_path(spark, "window-index"), window, gram)
    out, low = None, None
    for high in [*sorted({int(x) for x in cuts}), None]:
        batch = docs if high is None else docs.where(F.col("doc_id") <= high)
        batch = batch if low is None else batch.where(F.col("doc_id") > low)
        hits = index.add(batch, None if low is None else docs.where(F.col("doc_id") <= low))
        out, low = hits if out is None else out.union(hits), high
    scratch.drop(spark, index.path)
    return out


def remove_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """`docs` without the passages; n_chars follows the text.

    Documents without a word left are dropped if words were removed from them.
    Rows with a null doc_id or text pass unchanged, as do repeated rows of one
    doc_id, which are never held against each other. Other columns stay,
    whatever their names. Texts of fewer than `window` words lose nothing, very
    long ones are read whole; no rows give no rows.
    """
    hits = duplicate_windows(docs, window, gram, batches)
    out = rewritten(docs, hits, window)
    out = out.where((F.col("n_removed") == 0) | (F.col("kept_text") != ""))
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        old = F.col(rows.ROW)["n_chars"]
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return out.select(*[changed.get(c, F.col(rows.ROW)[c]).alias(c) for c in docs.columns])


def op7_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what removal leaves of every document.

    A null or empty text has no words; a null doc_id loses none; no rows give no
    rows; repeated rows get the same result each; of equal windows that with the
    smallest doc_id stays, and windows that only rows of one doc_id share stay
    too. Very long texts are read whole.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = duplicate_windows(docs)
    keyed = docs.withColumn("key", text_key())
    cut = rewritten(keyed, hits, how="inner")
    cut = cut.select(f"{rows.ROW}.doc_id", f"{rows.ROW}.key", "n_removed", F.sha2(word_line(F.col("kept_text")), 256).alias("sha"))
    touched = cut.dropDuplicates(["doc_id", "key"])
    line = word_line(F.col("text"))
    base = keyed.select("doc_id", "key", word_count(line).alias("n_words"), F.sha2(line, 256).alias("whole"))
    return base.join(touched, ["doc_id", "key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256")
    )


ORACLE_SQL = {
    "op7_window_index": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, i, md5_number(array_to_string(list_slice(ws, i, i + 49), ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)
), f AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM g) WHERE low < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT i + j) AS gone FROM f, (SELECT unnest(generate_series(0, 49)) AS j) GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS n_removed,
    list_filter(list_zip(ws, generate_series(1, len(ws))), lambda x: gone IS NULL OR NOT list_contains(gone, x[2])) AS kept
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(kept, lambda x: x[1]), ' ')) AS kept_sha256
FROM k
"""
}
