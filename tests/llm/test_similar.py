"""Near-duplicate stage of the pipeline."""

import random

import numpy as np
import pyarrow as pa

from phasewise.llm import scratch, similar, substring
from phasewise.llm.components import merge


def test_edited_copies_are_one_group(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    docs, plain = [], {}
    for d in range(60):
        text = [rng.choice(words) for _ in range(300)]
        docs.append((2 * d, " ".join(text)))
        edited = list(text)
        for at in rng.sample(range(20), 6):  # 0.8 and more of the shingles stay
            edited[at] = edited[at].upper() + "x"
        docs.append((2 * d + 1, " ".join(edited)))
    docs += [(None, "no number one two three four"), (None, "another text without any number here"), (500, ""), (501, None)]

    def cut(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    for d in range(60):
        a, b = cut(docs[2 * d][1]), cut(docs[2 * d + 1][1])
        plain[2 * d] = len(a & b) / len(a | b)
    assert min(plain.values()) >= 0.8
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(similar.keep_one(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    assert [r["doc_id"] for r in got] == [2 * d for d in range(60)] + [500, None, None]
    assert similar.keep_one(df.limit(0)).count() == 0


def test_texts_below_the_similarity_stay(spark):
    text = [f"w{i}" for i in range(100)]
    other = text[:50] + ["new"] * 1 + text[51:75] + ["also"] + text[76:90] + ["third"] + text[91:]
    assert similar.similarity(similar.shingles(" ".join(text)), similar.shingles(" ".join(other))) < 0.8
    df = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(other))], "doc_id long, text string")
    assert similar.keep_one(df).count() == 2


def test_second_pass_finds_what_the_first_does_not_name(spark, monkeypatch):
    """A ball of texts around the threshold: components are those of all pairs, however few a text may name."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for d in range(40):
        text = list(base)
        for at in rng.sample(range(200), 3):
            text[at] = f"x{d}"
        texts.append(" ".join(text))
    cut = [similar.shingles(t) for t in texts]
    group = list(range(40))
    for i in range(40):
        for j in range(i):
            if similar.similarity(cut[i], cut[j]) >= 0.8 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    lowest = sorted(min(i for i in range(40) if group[i] == g) for g in set(group))
    monkeypatch.setattr(similar, "NAMED", 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # At 64 bits every pair meets in the trie join, so the sketches alone could lose a link.
    got = [r["doc_id"] for r in similar.keep_one(df, bits=40).collect()]
    assert sorted(got) == lowest and 1 < len(lowest) < 40


def test_long_sketch_estimates_the_similarity():
    rng = random.Random(7)
    for share in (0.6, 0.8, 0.9):
        a = [rng.getrandbits(64) for _ in range(1000)]
        b = a[: int(2000 * share / (1 + share))]
        b += [rng.getrandbits(64) for _ in range(1000 - len(b))]
        x, y = (np.unique(np.array(t, np.uint64)) for t in (a, b))
        u, v = (np.frombuffer(similar.sketch(t, similar.LONG_SKETCH), np.uint8) for t in (x, y))
        assert len(u) == similar.LONG_SKETCH
        assert abs((u == v).mean() - similar.similarity(x, y)) < similar.LONG_SLACK


def ball(n):
    """Texts whose pairs are all a little under the similarity, and two copies of each with one edit."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for d in range(n):
        text = list(base)
        for at in rng.sample(range(20, 400), 6):
            text[at] = f"x{d}"
        texts.append(" ".join(text))
        for e in range(2):
            texts.append(" ".join([f"y{d}-{e}", *text[1:]]))
    return texts


def test_rows_of_a_ball_grow_with_its_size(spark, monkeypatch):
    texts = ball(40)
    made = [similar._described(pa.array([t]), 5) for t in texts]
    rows = [(m[0][0].as_py(), m[1][0].as_py(), m[2][0].as_py(), 7, t) for m, t in zip(made, texts, strict=True)]
    df = spark.createDataFrame(rows, "node long, fp long, sketch binary, root long, text string")
    # A task returns a forest of each of 17 rotations at most, where the pairs are 7140.
    assert similar.candidates(df.select("node", "fp", "sketch"), 16, 36).count() <= 17 * 120
    cut = [similar.shingles(t) for t in texts]
    plain = np.arange(120)
    for i in range(120):
        for j in range(i):
            if similar.similarity(cut[i], cut[j]) >= 0.8:
                plain = merge(plain, np.array([i]), np.array([j]))
    assert len(set(plain.tolist())) > 1
    for chunk in (1 << 10, 20):
        monkeypatch.setattr(similar, "CHUNK", chunk)
        links = similar.verified(df, 0.8, 5, 64, 0).collect()
        place = {r[0]: i for i, r in enumerate(rows)}
        a, b = (np.array([place[r[k]] for r in links]) for k in ("a", "b"))
        labels = merge(np.arange(120), a, b)
        assert labels.tolist() == plain.tolist()
        assert chunk == 20 or len(links) < 120


def test_small_tables_are_few_files(spark, monkeypatch):
    files, keep = {}, scratch.keep

    def kept(df, name, compression=None):
        out = keep(df, name, compression)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(scratch, "keep", kept)
    base = [f"w{i}" for i in range(60)]
    texts = [[f"d{d}x{i}" for i in range(200)] + base for d in range(40)]
    texts += [[*t[:-70], "other", *t[-69:]] for t in texts]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        one = sorted(r["doc_id"] for r in similar.keep_one(df).collect())
        cut = {r["doc_id"]: r["text"] for r in substring.remove_passages(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert one == list(range(40))
    assert cut[0] == " ".join(texts[0]) and all(cut[d] == " ".join(texts[d][:200]) for d in range(1, 40))
    small = ("stars", "components", "first-rows", "shared", "first-windows", "hits")
    assert {x: max(files.get(x, [0])) for x in small} == dict.fromkeys(small, 1)
    df = spark.range(0, 5 * scratch.FEW, 1, 8)
    assert scratch.narrow(df, 5 * scratch.FEW).rdd.getNumPartitions() == 5 and scratch.narrow(df, 9 * scratch.FEW).rdd.getNumPartitions() == 8
