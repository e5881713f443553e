"""The lexicon and the classifier against plain computation, and how archives are read."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phasewise.llm import quality, toxicity, warc

LABELLED = "doc_id long, text string, y int"


def plain_hits(lexicon, folded):
    """Heaviest entry at each place, without those in an exception phrase, by looking everywhere."""
    found = {}
    for key, weight in lexicon.weights.items():
        for at in range(len(folded)):
            if folded.startswith(key, at):
                found[at] = max(found.get(at, 0.0), weight)
    spared = {x for key in lexicon.exceptions for at in range(len(folded)) if folded.startswith(key, at) for x in range(at, at + len(key) - 1)}
    return {k: v for k, v in found.items() if k not in spared}


def test_scores_match_plain_matching():
    rng = random.Random(1)
    lexicon = toxicity.Lexicon({" ab ": 2.0, " ab": 1.0, " cab ": 3.0, " b ": 0.5}, frozenset({" a ab ", " ab cab ", " cab b "}), np.array([0.5, 0.3, 0.2, -1.0]))
    for _ in range(300):
        folded = toxicity.fold(" ".join(rng.choice(["a", "b", "ab", "cab", "abb", "4b", "c"]) for _ in range(rng.randrange(12))))
        want = plain_hits(lexicon, folded)
        assert lexicon.hits(folded) == want
        total, n = sum(want.values()), max(1, len(folded.split()))
        assert lexicon.features(folded) == pytest.approx((np.log1p(total), total / n**0.5, 20 * total / n))


def test_very_long_texts_are_matched_whole():
    lexicon = toxicity.Lexicon({" bad ": 1.0}, frozenset({" not bad "}))
    assert len(lexicon.hits(toxicity.fold("bad not bad " * 100_000))) == 100_000
    for text in ("1@" * 500_000, "7" * 1_000_000, " " * 1_000_000, "$" * 1_000_000 + "x"):
        assert lexicon.features(toxicity.fold(text)) == (0.0, 0.0, 0.0)


def test_lexicon_has_no_cap(spark):
    bad = [f"vok{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, " ".join([*bad, "usual words"]), 1) for i in range(30)] + [(100 + i, "usual words of a text", 0) for i in range(60)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, LABELLED))
    assert all(f" {w} " in lexicon.weights for w in bad)
    assert toxicity.scored(spark.createDataFrame([], LABELLED), lexicon).count() == 0
    assert toxicity.fit(spark.createDataFrame([], LABELLED)).weights == {}


def test_word_vectors_match_plain_sums(spark):
    rows = [(1, "a b a c"), (2, None), (3, ""), (4, "b a"), (4, "b a"), (5, " ".join(f"w{i % 50}" for i in range(2000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = quality.word_table(docs)

    def place(word):
        return int(quality.words_of(pa.array([word]))[5][0] >> np.uint64(48))

    want = np.zeros((quality.WORDS, quality.WORD_DIMS))
    for _, text in rows:
        ws = (text or "").split()
        for left, right in zip(ws, ws[1:], strict=False):
            want[place(left)] += quality.INDEX[place(right)]
            want[place(right)] += np.roll(quality.INDEX[place(left)], 1)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1.0)
    assert np.allclose(table, want, atol=1e-6)
    vectors = quality.document_vectors(pa.array([t for _, t in rows], pa.string()), table)
    for (_, text), v in zip(rows, vectors, strict=True):
        ws = (text or "").split()
        mean = np.mean([table[place(w)] for w in ws], axis=0) if ws else np.zeros(quality.WORD_DIMS)
        assert np.allclose(v[: quality.WORD_DIMS], mean, atol=1e-5)
        extra = v[quality.WORD_DIMS + quality.SHAPE_DIMS :]
        grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        assert extra[0] == pytest.approx(np.log1p(len(ws))) and extra[1] == pytest.approx(len(set(ws)) / max(1, len(ws)))
        assert extra[2] == pytest.approx(len(set(grams)) / max(1, len(grams))) and extra[5] == (not ws)


def test_classifier_of_few_none_and_long(spark):
    few = spark.createDataFrame([(1, "good words", 1), (2, "BAD!!", 0)], LABELLED)
    model = quality.fit(few)
    assert model is not None and model.temperature == 1.0
    long = spark.createDataFrame([(1, "word " * 200_000), (2, "x" * 1_000_000), (3, " " * 1_000_000), (4, None)], "doc_id long, text string")
    out = quality.scored(long, model).collect()
    assert len(out) == 4 and all(0 <= r["quality"] <= 1 for r in out)
    none = few.limit(0)
    assert quality.fit(none) is None and quality.scored(none, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["quality"] for r in quality.scored(few, quality.learnt(few, labels)).collect()} == {0.5}


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    pages = spark.createDataFrame([(i, "u", rng.randbytes(300_000).hex()) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    read = warc.read(spark, str(tmp_path / "w"))
    tasks = read.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    # One index file, but as many tasks as there are partitions for shuffles.
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in tasks) == 12
