"""SimHash groups, substring removal and nearest neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phasewise.llm import neighbours, simhash, spans, substring
from phasewise.llm.components import connected, merge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="abAÉñ \n\t\v ,", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def brute_labels(values, bits):
    labels = np.arange(len(values))
    i, j = np.triu_indices(len(values), 1)
    near = np.bitwise_count(values[i] ^ values[j]) <= bits
    return merge(labels, i[near], j[near])


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(2, 200))
def test_trie_join_finds_every_component(seed, bits, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, 5, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(n)], dtype=np.uint64)
    values = np.unique(np.concatenate([centres[rng.integers(0, 5, n)] ^ flips, rng.integers(0, 2**64, n // 2, dtype=np.uint64)]))
    labels = np.arange(len(values))
    offset = 0
    for r, width in enumerate(simhash.blocks(bits)):
        turned = simhash.rotate(values, offset)
        order = np.argsort(turned)
        head = turned[order] >> np.uint64(64 - width)
        lo = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
        hi = np.append(lo[1:], len(head))
        part = simhash.trie_forest(turned[order], np.full(len(lo), r), lo, hi, hi, bits)
        labels = merge(labels, order, order[part])
        offset += width
    assert np.array_equal(labels, brute_labels(values, bits))


@pytest.mark.parametrize("trie_rows", [1 << 16, 7])
def test_groups(spark, trie_rows):
    rng = random.Random(5)
    base = [" ".join(rng.choices("abcdefghij", k=30)) for _ in range(6)]
    texts = [None, "", "one two", *base]
    for t in base:
        for _ in range(8):
            ws = t.split()
            ws[rng.randrange(30)] = "z"
            texts.append(" ".join(ws))
    texts += base[:2]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)] + [(None, base[0])]
    fp = np.array([plain_fingerprint(t) for _, t in rows], dtype=np.uint64)
    labels = brute_labels(fp, 4)
    want = {}
    for (d, _), c in zip(rows, labels, strict=True):
        if d is not None:
            want[c] = min(want.get(c, d), d)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    if trie_rows == 7:
        old = simhash.links.__defaults__
        simhash.links.__defaults__ = (4, 7)
    try:
        got = simhash.near_groups(df).collect()
    finally:
        if trie_rows == 7:
            simhash.links.__defaults__ = old
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1, r["fp"] % 2**64, r["component_id"]) for r in got) == sorted((d or -1, int(f), want[c]) for (d, _), f, c in zip(rows, fp, labels, strict=True))


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(5, text, "x"), (3, text, "y"), (3, text, "y"), (9, "all other words here now", None)], "doc_id long, text string, fp string")
    assert sorted(tuple(r) for r in simhash.keep_one(df).collect()) == [(3, text, "y"), (9, "all other words here now", None)]
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.near_groups(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    labels = merge(np.arange(200), np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: int(labels[n]) for e in edges for n in e if e[0] != e[1]}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removal(rows, window):
    where = {}
    for d, t in rows:
        ws = WORD.findall(t or "")
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            where[key] = min(where.get(key, d), d) if d is not None else where.get(key, float("inf"))
    out = []
    for d, t in rows:
        ws = WORD.findall(t or "")
        gone = set()
        for i in range(len(ws) - window + 1):
            if d is not None and where[tuple(ws[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, [w for i, w in enumerate(ws) if i not in gone], len(gone)))
    return out


def passages(rng):
    shared = [[f"p{k}w{rng.randrange(40)}" for _ in range(25)] for k in range(3)]
    rows = []
    for d in range(40):
        ws = [rng.choice("abcdefg") + str(rng.randrange(9)) for _ in range(rng.randrange(30))]
        for p in rng.sample(shared, rng.randrange(3)):
            a = rng.randrange(12)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = p[a : a + rng.randrange(8, 20)]
        rows.append((d * 7 % 41, rng.choice([" ", "\n", "\t "]).join(ws)))
    return rows + [(50, None), (51, ""), (None, rows[0][1]), (60, rows[3][1]), (61, rows[3][1])]


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_substring_removal(spark, batches):
    rows = passages(random.Random(batches))
    df = spark.createDataFrame([(d, t, len(t or ""), "k") for d, t in rows], "doc_id long, text string, n_chars long, key string")
    docs = df.drop("key")
    hits = substring.duplicate_windows(docs, 10, 4, batches)
    got = substring.rewritten(docs, hits, 10).select("__row.doc_id", "n_removed", "kept_text").collect()
    want = sorted((d if d is not None else -1, ws, n) for d, ws, n in plain_removal(rows, 10))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, WORD.findall(r["kept_text"] or ""), r["n_removed"]) for r in got) == want
    kept = substring.remove_passages(docs, 10, 4, batches).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(d for d, ws, n in plain_removal(rows, 10) if (ws or not n) and d is not None)
    assert all(r["n_chars"] == len(r["text"] or "") for r in kept)


def test_index_runs_are_merged(spark, tmp_path):
    index = substring.WindowIndex(spark, str(tmp_path / "index"), 10, 4, fanout=2)
    rows = passages(random.Random(9))[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = None
    for low in range(0, 41, 10):
        hits = index.add(df.where(f"doc_id >= {low} and doc_id < {low + 10}"), df.where(f"doc_id < {low}"))
        found = hits if found is None else found.union(hits)
    assert len(index.runs()) <= 3 and any(r[0] != "0" for r in index.runs())
    got = {r["doc_id"] for r in found.collect()}
    assert got == {d for d, _, n in plain_removal(rows, 10) if n}


def test_substring_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.duplicate_windows(df).count() == 0 and substring.remove_passages(df).count() == 0


def test_query_digests(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(70))
    rows = [(1, long), (2, "x " + long + " y"), (3, None), (4, "short one"), (5, long)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in substring.op7_window_index(spark, str(tmp_path)).collect()}
    for d, ws, n in plain_removal(rows, 50):
        assert got[d]["n_removed"] == n and got[d]["kept_sha256"] == hashlib.sha256(" ".join(ws).encode()).hexdigest()


def test_groups_without_an_id_keep_one_row_each(spark):
    from phasewise.llm import similar

    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(None, one, 1), (None, one, 2), (None, other, 3), (4, one + " x", 4), (5, None, 5), (5, None, 6), (None, "", 7), (8, other + " y", 8), (8, other, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m int").withColumns({c: F.lit(c) for c in ("__nth", "__node", "__first", "__id", "__sha", "__n", "root", "best")})
    for keep in (simhash.keep_one, similar.keep_one):
        out = keep(df)
        assert out.columns == df.columns and all(r["__nth"] == "__nth" and r["best"] == "best" for r in out.collect())
    got = sorted((r["doc_id"], r["text"]) for r in similar.keep_one(df).collect())
    first = min((other, other + " y"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert [d for d, _ in got] == [4, 5, 8] and got[2][1] == first and got[0][1] == one + " x"
    # Exact fingerprints: texts apart by a word are no group, and rows without an id of different texts stay.
    plain = simhash.keep_one(spark.createDataFrame([(None, one), (None, other), (None, one)], "doc_id long, text string"), 0)
    assert sorted(r["text"] for r in plain.collect()) == sorted([one, other])
    assert simhash.keep_one(df.limit(0)).count() == similar.keep_one(df.limit(0)).count() == 0


def test_hot_keys_are_joined_whole(spark):
    from phasewise.llm import scratch, skew

    many = scratch.keep(spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")), "many")
    one = scratch.keep(many.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low")), "one")
    got = skew.joined(many, one, "k", "n").collect()
    assert len(got) == 6000 and all(r["low"] == (0 if r["k"] == 7 else r["k"]) for r in got)


def test_fingerprints_of_very_long_texts(spark):
    rows = [(1, "a b c d " * 100_000), (2, "x" * 1_000_000), (3, " " * 1_000_000), (4, ""), (5, None)]
    out = {r["doc_id"]: r for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["fp"] != 0 and out[2]["fp"] != 0 and {out[d]["component_id"] for d in (3, 4, 5)} == {3}


def thue_morse(n, a, b):
    """The first n letters of the sequence; it and its complement share every polynomial hash modulo 2**64 for n = 2**k, k > 10."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_that_defeat_rolling_hashes(spark, tmp_path, size):
    import duckdb

    one, other = thue_morse(size, "a", "b"), thue_morse(size, "b", "a")
    same = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*same, one])), (2, " ".join([*same, other])), (3, " ".join(["x", *same, one])), (4, " ".join(same * 2 + [other]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = substring.op7_window_index(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {1: 0, 2: 0, 3: 50, 4: 50}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(substring.ORACLE_SQL["op7_window_index"]).fetchall()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == sorted(want)


def test_windows_of_words_that_defeat_rolling_hashes(spark):
    # Sequences of two words, in the order of the sequence and of its complement.
    one, other = (thue_morse(2048, *x).replace("", " ").split() for x in ("ab", "ba"))
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(other))], "doc_id long, text string")
    want = {d: n for d, _, n in plain_removal([(1, " ".join(one)), (2, " ".join(other))], 1100)}
    got = substring.rewritten(df, substring.duplicate_windows(df, 1100), 1100).select("__row.doc_id", "n_removed").collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == want


def test_a_table_goes_through_two_levels(spark, monkeypatch):
    levels = []
    write = substring.WindowIndex._write
    monkeypatch.setattr(substring.WindowIndex, "_write", lambda self, rows, name: levels.append(name.split("-")[0]) or write(self, rows, name))
    rows = passages(random.Random(2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    substring.duplicate_windows(df, 10, 4)
    assert levels.count("0") == substring.BATCHES and levels.count("1") == 2 and levels.count("2") == 1


def test_substring_of_very_long_texts(spark):
    long = " ".join(f"w{i % 997}{i % 31}" for i in range(150_000))
    rows = [(1, long), (2, "head " + long), (3, " " * 1_000_000 + "few words"), (4, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("__id", "__key", "__starts", "__row")})
    out = substring.remove_passages(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["text"] == "head" and got[1]["text"] == long and len(got[3]["text"]) == 1_000_009 and got[4]["__starts"] == "__starts"


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a b", None, "", "  ñu\x0bx ", "b a"]
    data, off = spans.buffers(pa.array(texts))
    s, e, r = spans.words(data, off)
    assert [(data[a:b].tobytes().decode(), int(k)) for a, b, k in zip(s, e, r, strict=True)] == [("a", 0), ("b", 0), ("ñu", 3), ("x", 3), ("b", 4), ("a", 4)]
    h = spans.word_hashes(data, s, e)
    assert h[0] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 4
    x = np.array([5, 3, 9, 1, 7, 2], np.uint64)
    assert spans.sliding_min(x, 3).tolist() == [3, 1, 1, 1]


def exact(rows, k):
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            s = sorted((-float(np.dot(v, w)), j) for j, w in good if j != i)[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 2)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(61)]
    rows += [(400, None), (401, [0.0] * 8), (420, [float("nan")] * 8), (440, [1.0, None] + [0.0] * 6), (460, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(0))
    got = {}
    for r in neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hit = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in {j for j, _ in found}
        v = dict(rows)
        assert all(s == pytest.approx(float(np.dot(v[q], v[j])), abs=1e-12) for j, s in found)


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert neighbours.nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0


def test_descent_and_search_end_when_nothing_gets_better(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(3000, 24))
    e /= np.linalg.norm(e, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id long, embedding array<double>")
    # A narrow graph from two deals: two rounds of descent and five of search leave many neighbours out.
    narrow = neighbours.Settings(degree=10, trees=2, leaf=32, reverse=10, beam=160, expand=8)
    out = neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 10, narrow).collect()
    sims = e[::50] @ e.T
    sims[np.arange(60), np.arange(60) * 50] = -9
    true = {(50 * q, int(v)) for q in range(60) for v in np.argsort(-sims[q])[:10]}
    assert len(true & {(r["query_id"], r["vec_id"]) for r in out}) / len(true) > 0.9


def test_deals_and_beam_grow_with_the_table():
    small, large = (neighbours.sized(neighbours.Settings(), n) for n in (1000, 1_000_000))
    assert small == neighbours.Settings() and large.trees > 8 and large.beam > 1000


def test_parts_of_deals_descent_and_search_are_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1200, 8)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    cut: list[int] = []
    plain = neighbours.parts
    monkeypatch.setattr(neighbours, "MOVED", 0)
    monkeypatch.setattr(neighbours, "parts", lambda *a: cut.append(min(3, plain(*a))) or cut[-1])
    small = neighbours.Settings(degree=10, trees=4, leaf=64, reverse=8, beam=80, expand=40)
    got = neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 10, small).collect()
    assert cut == [3, 3, 3]
    want = exact(rows, 10)
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, k) for q in sorted(want) for k in range(1, 11)]
    true = {(q, j) for q, found in want.items() for j, _ in found}
    assert len(true & {(r["query_id"], r["vec_id"]) for r in got}) / len(true) > 0.95


def test_pairs_travel_without_vectors(spark, monkeypatch):
    """A node's vector is not shuffled for every query that looks at it."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plans = []
    plain = neighbours._products
    monkeypatch.setattr(neighbours, "_products", lambda pairs: plans.append(pairs._jdf.queryExecution().executedPlan().toString()) or plain(pairs))
    neighbours.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).count()
    assert plans and all("BroadcastHashJoin" in p for p in plans)


def test_best_of_edges_in_steps():
    rng = np.random.default_rng(8)
    src, dst = rng.integers(0, 20, (2, 3000))
    sim = (src * 31 + dst * 17) % 101 / np.float32(101)
    whole = neighbours._best_of([(src, dst, sim)], 5)
    steps = neighbours._best_of([(src[:1500], dst[:1500], sim[:1500])], 5)
    steps = neighbours._best_of([steps, (src[1500:], dst[1500:], sim[1500:])], 5)
    assert all(np.array_equal(a, b) for a, b in zip(whole, steps, strict=True))
    assert np.bincount(whole[0]).tolist() == [5] * 20
