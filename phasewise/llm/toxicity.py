"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, replaces homoglyphs and digits that stand for letters,
drops joiners and makes everything that is no letter a space. The lexicon holds
whole words and word beginnings with the log-odds that labelled texts give
them, and exception phrases in which a word is no hit. Each word counts with
its heaviest match; the sums, plain and by length, make the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows
from .labelled import MOST_ROWS, held_out, logistic, sample

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u",
}
#: Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Characters that don't show.
JOINERS = "­​‌‍⁠﻿"
_FOLD = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | dict.fromkeys(JOINERS, ""))
_SIGNS = re.compile(r"[0134578@$]+")
_SWAP = str.maketrans(DIGITS)
_GAP = re.compile(r"[\W\d_]+")
#: Lengths of word beginnings that may enter the lexicon.
STEMS = range(4, 9)
#: An entry needs this many toxic texts, this log-odds, and so many standard errors. No other bound is set: the labelled sample is one.
LEAST_TEXTS, LEAST_ODDS, LEAST_Z = 5, 1.5, 4.0
#: An exception phrase needs LEAST_TEXTS other texts and at most this log-odds.
SPARED_ODDS = -0.5


def _swapped(m: re.Match) -> str:
    """A run of digits and signs, those read as letters that stand right before one.

    Behind a letter it is the whole run, else what starts at the first border
    between a digit and a sign, with the run's own start at a space or a digit.
    """
    run, text = m[0], m.string
    after = text[m.end() : m.end() + 1]
    if not after.isalpha():
        return run
    before = text[m.start() - 1 : m.start()] if m.start() else ""
    if before.isalpha():
        return run.translate(_SWAP)
    in_word = bool(before) and (before.isalnum() or before == "_")
    first = next((i for i, c in enumerate(run) if c.isdigit() != in_word), len(run))
    return run[:first] + run[first:].translate(_SWAP)


def fold(text: str | None) -> str:
    """Folded words with one space before, between and behind them."""
    text = (text or "").lower().translate(_FOLD)
    text = _SIGNS.sub(_swapped, text)
    return f" {_GAP.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Entries are ' word ' or ' stem'; exceptions are ' several words '."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    model: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 1.0, -2.0]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def automaton(self):
        if "_automaton" not in self.__dict__:
            import ahocorasick

            out = ahocorasick.Automaton()
            for key, weight in self.weights.items():
                out.add_word(key, (len(key), weight))
            for key in self.exceptions:
                out.add_word(key, (len(key), None))
            if len(out):
                out.make_automaton()
            self._automaton = out
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Heaviest weight by the position before the word; none inside an exception phrase."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        automaton = self.automaton()
        if not len(automaton):
            return found
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if spared and found:
            at = np.fromiter(found, np.int64, len(found))
            begin, end = np.sort(np.array(spared).T, axis=1)
            # Phrases begun at or before a word, less those that ended there.
            within = np.searchsorted(begin, at, "right") > np.searchsorted(end, at, "right")
            for start in at[within].tolist():
                del found[start]
        return found

    def features(self, folded: str) -> tuple[float, float, float]:
        """Logarithm of the summed weights, that sum by the root of the length, and by the length."""
        found = self.hits(folded)
        total, n = sum(found.values()), max(1, folded.count(" ") - 1)
        return float(np.log1p(total)), total / n**0.5, 20 * total / n

    def score(self, folded: str) -> float:
        z = float(np.dot(self.features(folded), self.model[:3]) + self.model[3])
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def _grams(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def _counted(texts: DataFrame, keys) -> DataFrame:
    """(gram, pos, neg): toxic and other texts of (text, y) that have each of the grams keys(folded) yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"].to_pylist(), strict=True):
                count[y].update(keys(fold(text.as_py())))
        every = list(count[0].keys() | count[1].keys())
        cols = [pa.array(every, pa.string()), pa.array([count[1][g] for g in every], pa.int64()), pa.array([count[0][g] for g in every], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["gram", "pos", "neg"])

    part = texts.select("text", "y").mapInArrow(run, "gram string, pos long, neg long")
    return part.groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _rated(counts: DataFrame, n_pos: int, n_neg: int) -> DataFrame:
    """`counts` with odds, the log-odds of toxic texts, and z, the standard errors it is from 0."""
    cells = F.col("pos") + 0.5, n_pos - F.col("pos") + 0.5, F.col("neg") + 0.5, n_neg - F.col("neg") + 0.5
    odds = F.log(cells[0]) - F.log(cells[1]) - F.log(cells[2]) + F.log(cells[3])
    return counts.withColumns({"odds": odds, "z": odds / F.sqrt(sum((1 / c for c in cells[1:]), 1 / cells[0]))})


def fit(texts: DataFrame, seeds: dict[str, float] | None = None, exceptions: frozenset[str] = frozenset()) -> Lexicon:
    """Lexicon of the labelled `texts` (text, y), a bounded sample; `seeds` and `exceptions` are kept as given.

    Without toxic or without other texts nothing is learnt and all scores are low.
    """
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Lexicon(dict(seeds or {}), exceptions)
    rated = _rated(_counted(texts, _grams), n_pos, n_neg)
    good = rated.where((F.col("pos") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z)).select("gram", "odds").collect()
    weights = {r["gram"]: r["odds"] for r in sorted(good)} | (seeds or {})
    lexicon = Lexicon(weights, exceptions)

    def phrases(folded: str) -> set[str]:
        out = set()
        for start in lexicon.hits(folded):
            end = folded.index(" ", start + 1)
            after = folded.find(" ", end + 1)
            before = folded.rfind(" ", 0, start) if start else -1
            if after > 0:
                out.add(folded[start : after + 1])
            if before >= 0:
                out.add(folded[before : end + 1])
        return out

    benign = _rated(_counted(texts, phrases), n_pos, n_neg).where((F.col("neg") >= LEAST_TEXTS) & (F.col("odds") <= SPARED_ODDS)).select("gram").collect()
    lexicon = Lexicon(weights, exceptions | {r["gram"] for r in benign})
    learnt = scored(texts, lexicon).select("y", "f").collect()
    x, y = np.array([r["f"] for r in learnt]), np.array([r["y"] for r in learnt], float)
    lexicon.model = logistic(x, y)
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """`docs` with toxicity (0 to 1) and its features f, in place of columns of these names.

    Null and empty texts have no hits; very long ones are folded and matched
    whole, in a time that grows with their length; repeated rows are scored
    each; no rows give no rows.
    """

    def run(text: pa.Array) -> list:
        f = [lexicon.features(fold(t.as_py())) for t in text]
        z = np.clip(np.array(f).reshape(-1, 3) @ lexicon.model[:3] + lexicon.model[3], -30, 30)
        return [1 / (1 + np.exp(-z)), pa.array([list(x) for x in f], pa.list_(pa.float64()))]

    out = rows.added(docs, ["text"], "toxicity double, f array<double>", run)
    return rows.spread(out, docs.columns, ["toxicity", "f"])


def op6_toxic_lexicon(spark: SparkSession, sf_dir: str, most: int = MOST_ROWS) -> DataFrame:
    """Score and verdict of every document; see scored(). Without both labels all scores are low."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = held_out(5, 0)
    texts = sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", ~held, most)
    out = scored(docs, fit(texts))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
