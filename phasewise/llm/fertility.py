"""Quality rules from what public vocabularies make of a text.

Beside a few base counts, every text is encoded whole with each vocabulary;
characters per token, the share of tokens that stand for bytes or parts of a
character (byte fallback) and the entropy of its tokens are held against bands
of its language, or of its script where no language is given, and its length
(doublings of the tokens). A band is a median of the corpus and multiples of
the median deviation from it. The medians of a group count with its texts, those
of the wider group with PRIOR more, so groups of any size have bands and none
starts or ends at a certain size. The wider group of a language's length is the
language and then the corpus; for entropy, which rises with length, it is that
length in all languages, and then the shorter ones. A text goes if it is outside
of its bands for VOTES of the vocabularies.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows, scratch, spans
from .vocabularies import FOLDER, VOCABULARIES, vocabulary

#: Scripts by the first byte of a character in UTF-8: fixed values of the encoding.
SCRIPTS = {"latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCA)], "greek": [(0xCE, 0xCF)], "cyrillic": [(0xD0, 0xD3)], "semitic": [(0xD6, 0xDD)], "indic": [(0xE0, 0xE0)], "asian": [(0xE3, 0xED)]}
#: Deviations from the median that a band allows, and the least half width: a share of the median, and a share of bytes.
WIDTH, LEAST, LEAST_BYTES = 4.0, 0.05, 0.05
#: Texts that a wider group's median counts for, and vocabularies that must find a text odd.
PRIOR, VOTES = 50.0, 2

METRICS = ("chars_per_token", "byte_share", "token_entropy")
MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens array<long>, chars_per_token array<double>, byte_share array<double>, token_entropy array<double>, script string"
PATHS = tuple(f"{FOLDER}/{x}" for x in VOCABULARIES)


def _byte_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often each row has each byte."""
    return np.array([np.bincount(data[a:b], minlength=256) for a, b in zip(off[:-1], off[1:], strict=True)], np.int64).reshape(-1, 256)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that begin a character of a word.
_CHAR = ~spans._IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)


def base_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    starts, ends, rows = spans.words(data, off)
    n = len(off) - 1
    n_words = np.bincount(rows, minlength=n)
    counts = _byte_counts(data, off)
    dup = np.zeros(n, np.int64)
    raw = data.tobytes()
    for i in range(n):
        lines = [x for x in raw[off[i] : off[i + 1]].split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    gram, whole = spans.gram_codes(spans.codes(data, starts, ends)[0], rows, 3)
    covered = np.zeros(len(rows), bool)
    if len(gram):
        at = np.flatnonzero(whole)
        # The row of a gram is part of its number.
        twice = np.bincount(gram[at], minlength=1)[gram[at]] > 1
        for k in range(3):
            covered[at[twice] + k] = True
    return n_words, counts[:, _CHAR].sum(axis=1), counts[:, _SYMBOL].sum(axis=1), dup, np.bincount(rows[covered], minlength=n)


def script_of(data: np.ndarray, off: np.ndarray) -> list[str]:
    every, counts = _byte_counts(data, off), []
    for ranges in SCRIPTS.values():
        table = np.zeros(256, bool)
        for a, b in ranges:
            table[a : b + 1] = True
        counts.append(every[:, table].sum(axis=1))
    counts = np.array(counts)
    names = np.array([*SCRIPTS])[counts.argmax(axis=0)]
    return np.where(counts.max(axis=0) > 0, names, "other").tolist()


def token_metrics(texts: list[str], path: str) -> tuple[np.ndarray, ...]:
    """Tokens, characters per token, share of byte tokens and entropy in bits."""
    v = vocabulary(path)
    n, chars, share, entropy = np.zeros(len(texts), np.int64), *(np.zeros(len(texts)) for _ in METRICS)
    for i, text in enumerate(texts):
        ids = v.encode(text)
        n[i] = len(ids)
        if len(ids):
            rising = np.sort(ids)
            p = np.diff(np.flatnonzero(np.concatenate(([True], rising[1:] != rising[:-1], [True])))) / len(ids)
            chars[i], share[i], entropy[i] = len(text) / len(ids), v.part[ids].mean(), -(p * np.log2(p)).sum()
    return n, chars, share, entropy


def measure(docs: DataFrame, paths: Sequence[str]) -> DataFrame:
    """rows.ROW and the columns MEASURED, arrays with an entry for each vocabulary; a null text counts as empty."""

    def run(text: pa.Array) -> list:
        data, off = spans.buffers(text)
        texts = [t.as_py() or "" for t in text]
        tokens = zip(*(token_metrics(texts, path) for path in paths), strict=True)
        every = [pa.array(list(np.column_stack(x))) if texts else pa.array([], pa.list_(kind)) for x, kind in zip(tokens, (pa.int64(), *[pa.float64()] * 3), strict=True)]
        return [*base_counts(data, off), *every, script_of(data, off)]

    return rows.added(docs, ["text"], MEASURED, run, 1 << 20)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def medians(sound: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(name, length, and the columns `values`): for each cell of `sound` the medians of the values, drawn to those of wider groups.

    Names that end in 2 are entropies: their wider group is the length. The
    lengths are doublings, so at most 64, which is what the driver holds.
    """
    rising = [k for k in values if k.endswith("2")]
    level = [k for k in values if k not in rising]
    x = sound.select("name", "length", *[v.alias(k) for k, v in values.items()])
    mid = [F.percentile_approx(k, 0.5, 2000).alias(k) for k in values]
    cells = scratch.keep(x.groupBy("name", "length").agg(F.count("*").alias("n"), *mid), "cells")
    names = x.groupBy("name").agg(F.count("*").alias("n"), *[m for m, k in zip(mid, values, strict=True) if k in level])
    every = x.agg(*[m for m, k in zip(mid, values, strict=True) if k in level]).first()
    lengths = x.groupBy("length").agg(F.count("*").alias("n"), *[m for m, k in zip(mid, values, strict=True) if k in rising]).orderBy("length").collect()
    drawn = lambda n, own, wide: (n * own + PRIOR * wide) / (n + PRIOR)
    names = names.select("name", *[drawn(F.col("n"), F.col(k), F.lit(every[k])).alias(f"{k}_wide") for k in level])
    chain, last = [], None
    for r in lengths:
        last = {k: r[k] if last is None else drawn(r["n"], r[k], last[k]) for k in rising}
        chain.append((r["length"], *last.values()))
    wide = sound.sparkSession.createDataFrame(chain, f"length long, {', '.join(f'{k}_wide double' for k in rising)}")
    both = cells.join(names, "name").join(F.broadcast(wide), "length")
    return both.select("name", "length", *[drawn(F.col("n"), F.col(k), F.col(f"{k}_wide")).alias(k) for k in values])


def bands(measured: DataFrame, vocabularies: int) -> DataFrame:
    """(name, length, band): of each group of texts, for each vocabulary, the limits (low, high) of the METRICS; null is none.

    A row for each language or script and length, so few.
    """
    keys = {f"m{v}_{i}": F.col(m)[v] for v in range(vocabularies) for i, m in enumerate(METRICS)}
    # Copies of one text have equal measures and count once, else a large group of them would set the band.
    sound = measured.where(~base_failed()).select("name", "length", *[c.alias(k) for k, c in keys.items()]).distinct()
    sound = scratch.keep(sound, "sound")
    middle = scratch.keep(medians(sound, {k: F.col(k) for k in keys}), "middles")
    apart = sound.join(middle.withColumnsRenamed({k: f"{k}_mid" for k in keys}), ["name", "length"])
    off = medians(apart, {k: F.abs(F.col(k) - F.col(f"{k}_mid")) for k in keys}).withColumnsRenamed({k: f"{k}_dev" for k in keys})
    limits: list[Column] = []
    for v in range(vocabularies):
        for i, m in enumerate(METRICS):
            mid = F.col(f"m{v}_{i}")
            half = F.greatest(WIDTH * 1.4826 * F.col(f"m{v}_{i}_dev"), F.lit(LEAST_BYTES) if m == "byte_share" else LEAST * mid)
            none = F.lit(None).cast("double")
            limits.append(F.struct((none if m == "byte_share" else mid - half).alias("low"), (none if m == "token_entropy" else mid + half).alias("high")))
    return middle.join(off, ["name", "length"]).select("name", "length", F.array(*limits).alias("band"))


def verdicts(docs: DataFrame, paths: Sequence[str]) -> DataFrame:
    """rows.ROW, MEASURED, base_failed and kept."""
    measured = measure(docs, paths)
    script = F.concat(F.lit("script:"), "script")
    name = F.coalesce(F.col(rows.ROW)["lang"].cast("string"), script) if "lang" in docs.columns else script
    length = F.floor(F.log2(F.greatest(F.col("n_tokens")[0], F.lit(1))))
    measured = scratch.keep(measured.withColumns({"name": name, "length": length}), "measured")
    limits = scratch.keep(bands(measured, len(paths)), "bands")
    m = measured.join(limits, ["name", "length"], "left")

    def outside(v: int) -> Column:
        out = F.lit(False)
        for i, metric in enumerate(METRICS):
            x, band = F.col(metric)[v], F.col("band")[v * len(METRICS) + i]
            out = out | F.coalesce(x < band["low"], F.lit(False)) | F.coalesce(x > band["high"], F.lit(False))
        return out.cast("int")

    votes = sum((outside(v) for v in range(1, len(paths))), outside(0))
    out = m.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (votes < min(VOTES, len(paths))))
    return out.select(rows.ROW, *rows.names_of(MEASURED), "base_failed", "kept")


def judged(docs: DataFrame, paths: Sequence[str] = PATHS) -> DataFrame:
    """`docs` with MEASURED, base_failed and kept, which take the place of columns of these names.

    `docs` needs text; a lang column, where there is one and it is not null,
    chooses the bands, else the script does. A text that the base rules keep
    fails outside the bands of its language and length for VOTES vocabularies
    (all, where there are fewer). Null and empty texts fail; very long texts,
    or long runs of one character, are encoded whole; no rows give no rows;
    repeated rows are judged each, and count once for the bands.
    """
    return rows.spread(verdicts(docs, paths), docs.columns, [*rows.names_of(MEASURED), "base_failed", "kept"])


def keep_good(docs: DataFrame, paths: Sequence[str] = PATHS) -> DataFrame:
    """The rows of `docs` that are kept, as they were; see judged()."""
    return rows.own(verdicts(docs, paths).where("kept"), docs.columns)


def op1_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; arrays have an entry for each of VOCABULARIES. See judged()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    m = judged(docs)
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy")
