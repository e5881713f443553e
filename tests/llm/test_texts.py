"""Quality rules, packing, pieces, HTML, toxicity, the classifier, WARC and the pipeline."""

import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phasewise.llm import fertility, html_text, packing, pieces, quality, spans, toxicity, vocabularies, warc
from phasewise.llm.labelled import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"
VOCABULARY = f"{vocabularies.FOLDER}/{vocabularies.VOCABULARY}"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
texts_of = st.text(alphabet="ab#&é \n\t\x0b日", max_size=80)


def plain_counts(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


@given(st.lists(st.one_of(st.none(), texts_of), max_size=6))
def test_base_counts(texts):
    import pyarrow as pa

    got = fertility.base_counts(*spans.buffers(pa.array(texts, pa.string())))
    assert [tuple(int(c[i]) for c in got) for i in range(len(texts))] == [plain_counts(t) for t in texts]


def test_base_counts_of_words_that_defeat_rolling_hashes():
    import pyarrow as pa

    letters = ["".join(("ab" if bin(i).count("1") % 2 == k else "ba")[0] for i in range(2048)) for k in (0, 1)]
    texts = [f"x {letters[0]} y x {letters[1]} y", f"x {letters[0]} y x {letters[0]} y"]
    got = fertility.base_counts(*spans.buffers(pa.array(texts)))
    assert [tuple(int(c[i]) for c in got) for i in range(2)] == [plain_counts(t) for t in texts] and got[4].tolist() == [0, 6]


@needs_vocabulary
@pytest.mark.parametrize("path", fertility.PATHS)
def test_token_metrics(path):
    texts = ["the the the", "", "日本 語 𐍈", "hello world, hello"]
    n, chars, share, entropy = fertility.token_metrics(texts, path)
    v = vocabularies.vocabulary(path)
    for i, t in enumerate(texts):
        ids = v.encode(t).tolist()
        assert n[i] == len(ids) and share[i] == pytest.approx(sum(bool(v.part[x]) for x in ids) / max(1, len(ids)))
        assert chars[i] == pytest.approx(len(t) / max(1, len(ids)))
        p = [ids.count(x) / len(ids) for x in set(ids)]
        assert entropy[i] == pytest.approx(-sum(x * np.log2(x) for x in p), abs=1e-12)
    assert share[2] > 0


@needs_vocabulary
def test_splitting_leaves_tokens_as_they_are(monkeypatch):
    v = vocabularies.vocabulary(VOCABULARY)
    rng = random.Random(5)
    spaces = [chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    monkeypatch.setattr(vocabularies, "_RUN", re.compile(f"[{vocabularies.SPACE}]{{3,}}"))
    monkeypatch.setattr(vocabularies, "STRETCH", 7)
    for _ in range(5000):
        text = "".join(rng.choice(["a", "b", "'s", "1", "#", "\x1c", "é", "日", "😀", " ", " ", "\n", rng.choice(spaces)]) for _ in range(rng.randrange(30)))
        assert v.encode(text).tolist() == v.encoding.encode_ordinary(text)


LONG_RUNS = [" ", "\n", "\t", "\xa0", "a", "7", "#", "日", " \n"]


@needs_vocabulary
def test_long_runs(spark):
    rows = [(i, f"x{c * (1_000_000 // len(c))}y", "en") for i, c in enumerate(LONG_RUNS)] + [(20, " " * 1_000_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    out = {r["doc_id"]: r for r in fertility.judged(df).collect()}
    assert len(out) == 10 and all(r["base_failed"] and min(r["n_tokens"]) > 10_000 for r in out.values())
    counts = packing.token_counts(df, VOCABULARY).collect()
    assert {r["doc_id"]: r["n"] - 1 for r in counts} == {d: r["n_tokens"][0] for d, r in out.items()}
    assert sum(r["n_tokens"] for r in packing.pack_documents(df).collect()) == sum(r["n"] for r in counts)


def plain_bands(rows):
    """{(name, length, vocabulary, metric): (low, high)} of [(name, length, [metrics of each vocabulary])]."""
    mid = lambda x: sorted(x)[(len(x) - 1) // 2]
    drawn = lambda own, wide: (len(own) * mid(own) + fertility.PRIOR * wide) / (len(own) + fertility.PRIOR) if own else wide

    def centre(values, rising):
        out, last = {}, None
        for k in sorted({k for _, k, _ in values}):
            own = [x for _, j, x in values if j == k]
            last = mid(own) if last is None else drawn(own, last)
            for name in {n for n, _, _ in values}:
                of_name = [x for n, _, x in values if n == name]
                wide = last if rising else drawn(of_name, mid([x for _, _, x in values]))
                out[name, k] = drawn([x for n, j, x in values if (n, j) == (name, k)], wide)
        return out

    out = {}
    for v in range(len(rows[0][2])):
        for m in range(3):
            values = [(n, k, x[v][m]) for n, k, x in rows]
            c = centre(values, m == 2)
            d = centre([(n, k, abs(x - c[n, k])) for n, k, x in values], m == 2)
            for cell in {(n, k) for n, k, _ in rows}:
                half = max(fertility.WIDTH * 1.4826 * d[cell], fertility.LEAST_BYTES if m == 1 else fertility.LEAST * c[cell])
                out[(*cell, v, m)] = (-np.inf if m == 1 else c[cell] - half, np.inf if m == 2 else c[cell] + half)
    return out


@needs_vocabulary
@needs_tables
def test_verdicts_match_plain_bands(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = fertility.judged(docs).collect()
    cell = lambda r: (r["lang"] or f"script:{r['script']}", int(np.log2(max(1, r["n_tokens"][0]))))
    of = lambda r: tuple(zip(r["chars_per_token"], r["byte_share"], r["token_entropy"], strict=True))
    sound = {(*cell(r), of(r)) for r in got if not r["base_failed"]}
    limits = plain_bands(list(sound))
    for r in got:
        votes = 0
        for v, metrics in enumerate(of(r)):
            sides = [limits.get((*cell(r), v, m), (-np.inf, np.inf)) for m in range(3)]
            votes += any(not low - 1e-12 <= x <= high + 1e-12 for x, (low, high) in zip(metrics, sides, strict=True))
        assert r["kept"] == (not r["base_failed"] and votes < fertility.VOTES)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(quality.get(r["doc_id"]), r["kept"]) for r in got if not r["base_failed"]]
    assert np.mean([k for q, k in judged if q == 1]) > 0.98 and np.mean([k for q, k in judged if q == 0]) < 0.25


@needs_vocabulary
def test_quality_rules(spark):
    rng = random.Random(1)
    lexicon = ["river", "house", "garden", "quietly", "because", "mountain", "letter", "morning", "between", "window", "and", "the", "of", "a"]
    good = [" ".join(rng.choices(lexicon, k=120)) for _ in range(120)]
    junk = "".join(rng.choice("#$%&*|<>x9") + rng.choice(["", " "]) for _ in range(500))
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(200, None, "en"), (201, "", None), (202, "few words", "en"), (203, "same words again " * 40, "en"), (204, junk, "en"), (205, good[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_words_", F.lit(1))
    out = {r["doc_id"]: r for r in fertility.judged(df).collect()}
    assert all(out[i]["kept"] for i in range(120)) and out[205]["kept"]
    assert [out[i]["base_failed"] for i in (200, 201, 202, 203)] == [True] * 4
    assert not out[204]["kept"]
    for i, t, _ in rows:
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(t)
    assert fertility.keep_good(df).columns == df.columns and fertility.judged(df.limit(0)).count() == 0


def plain_pack(lengths, capacities):
    """Best fit by looking at every open bin, and at every piece to come for the size of a new one."""
    bins, cost = [], packing.cost
    least = lambda n: min(c for c in capacities if c >= n)
    for i, n in enumerate(lengths):
        fitting = [b for b in bins if b[0] - b[1] >= n]
        if fitting:
            b = min(fitting, key=lambda b: b[0] - b[1])
        else:
            prices = []
            for c in capacities:
                full = n
                for m in lengths[i + 1 :]:
                    full += m if full + m <= c else 0
                prices += [(cost(least(full)) / full, c)] if n <= c else []
            b = [min(prices)[1], 0]
            bins.append(b)
        b[1] += n
    return sorted((b[1], least(b[1])) for b in bins)


def price(bins, final):
    return sum(packing.cost(c) for c in dict(zip(bins.tolist(), final.tolist(), strict=True)).values())


@settings(max_examples=60)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_packing_is_best_fit(lengths):
    lengths, capacities = sorted(lengths, reverse=True), (16, 32, 64)
    bins, offsets, final = packing.pack(lengths, capacities)
    used = {}
    for n, b, o, c in sorted(zip(lengths, bins, offsets, final, strict=True), key=lambda x: (x[1], x[2])):
        assert used.get(b, (0, c)) == (o, c)
        used[b] = (o + n, c)
    assert sum(u for u, _ in used.values()) == sum(lengths) and all(u <= c for u, c in used.values())
    # Which of several bins with equal room is taken may differ; how full they get in sum may not.
    assert len(used) == len(plain_pack(lengths, capacities))


@pytest.mark.parametrize("low,high", [(1, 8193), (600, 3000), (20, 900), (2000, 5000)])
def test_joint_sizes_beat_single_rules(low, high, monkeypatch):
    lengths = sorted(np.random.default_rng(high).integers(low, high, 1500).tolist(), reverse=True)
    bins, _, final = packing.pack(lengths)
    joint = price(bins, final)
    # One size for all that holds every piece whole, with and without shrinking; the least size that fits.
    for c in packing.CAPACITIES:
        if c >= max(lengths):
            alone, _, _ = packing.pack(lengths, [c])
            assert joint <= packing.cost(c) * len(set(alone.tolist())) and (c == 2048 or joint < packing.cost(c) * len(set(alone.tolist())))
            monkeypatch.setattr(packing, "size_to_open", lambda n, sizes, to_come, c=c: c)
            assert joint <= price(*packing.pack(lengths)[::2])
            monkeypatch.undo()
    monkeypatch.setattr(packing, "size_to_open", lambda n, sizes, to_come: min(c for c in sizes if c >= n))
    assert joint <= price(*packing.pack(lengths)[::2])


@needs_vocabulary
def test_packed_documents(spark):
    long = "word " * 20000
    rows = [(1, long), (2, "a"), (2, "a"), (3, None), (None, "b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(0))
    out = packing.pack_documents(df).collect()
    encode = vocabularies.vocabulary(VOCABULARY).encode
    want = sorted((d or 0, len(encode(t or "")) + 1) for d, t in rows)
    total = {}
    for r in out:
        total.setdefault(r["doc_id"] or 0, []).append((r["start"], r["n_tokens"]))
        assert r["bin_offset"] + r["n_tokens"] <= r["capacity"]
    assert sum(n for _, n in total[1]) == want[1][1] and len(total[2]) == 2
    at = 0
    for start, n in sorted(total[1]):
        assert start == at
        at += n
    spans_ = sorted((r["bin_id"], r["bin_offset"], r["n_tokens"]) for r in out)
    assert all(a[0] != b[0] or a[1] + a[2] <= b[1] for a, b in zip(spans_, spans_[1:], strict=False))
    assert packing.pack_documents(df.limit(0)).count() == 0


MODEL = f"{vocabularies.FOLDER}/{pieces.MODEL}"


@needs_vocabulary
@given(st.text(max_size=60))
@settings(max_examples=80, deadline=None)
def test_pieces_round_trip(text):
    m = pieces.model(MODEL)
    assert m.decode(m.encode([text])[0]) == text


@needs_vocabulary
def test_pieces_match_the_library():
    import sentencepiece
    from tokenizers import Tokenizer, models

    m = pieces.model(MODEL)
    file = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocab = [(file.id_to_piece(i), float(m.scores[i]) if np.isfinite(m.scores[i]) else -1000.0) for i in range(file.get_piece_size())]
    other = Tokenizer(models.Unigram(vocab, 0, True))
    rng = random.Random(0)
    texts = ["Hello  world\n a\tb", "日本語 テスト 😀", "ﬁne naïve café"] + ["".join(rng.choices("abcdefghijklmnop éñ\n", k=80)) for _ in range(60)]
    for text, ids in zip(texts, m.encode(texts), strict=True):
        theirs = other.encode("▁" + text.replace(" ", "▁")).ids
        score = lambda x: sum(m.scores[i] if np.isfinite(m.scores[i]) else 0 for i in x)
        assert ids == theirs or (len(ids) == len(theirs) and score(ids) == pytest.approx(score(theirs), abs=1e-9))
        assert file.decode(ids) == text


def test_double_array():
    keys = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, "é".encode(): 5, b"\xff\x00": 6}
    d = pieces.DoubleArray(keys)

    def find(key):
        s = 0
        for c in key:
            t = d.base[s] + c
            if d.base[s] <= 0 or t >= len(d.check) or d.check[t] != s:
                return -1
            s = t
        return int(d.value[s])

    assert {k: find(k) for k in keys} == keys and find(b"ac") == find(b"c") == find("è".encode()) == -1


@needs_vocabulary
def test_pieces_in_spark(spark):
    rows = [(1, "Some words here"), (2, None), (3, ""), (4, "Some words here"), (5, "▁ x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.lit(1))
    out = {r["doc_id"]: r for r in pieces.decode(pieces.encode(df)).collect()}
    assert all(out[d]["decoded"] == (t or "") for d, t in rows) and out[2]["ids"] == []
    assert pieces.decode(pieces.encode(df.limit(0))).count() == 0
    assert all(r["round_trip"] for r in pieces.encode(df, verify=True).collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this long page of ours.</div>
<article><h1>A &amp; B</h1><p><b>First <i>line</i>
 of&nbsp;text<br><p>Short.<div class="ad-box">Buy now</div><form><input><label>Name</label></form><p>Third &#233;l&eacute;ment &lt;x&gt;</p>
<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><aside>Side</aside><section class="comments"><article><p>Reader says a long long long comment.</p></article></section></article>
<div id="sidebar">More</div><footer>&copy; x</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A & B\n\nFirst line of text\n\nShort.\n\nThird élément <x>\n\none\n\ntwo\n\nc1\n\nc2"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    bare = "<body><div class=menu><a>x</a> <a>y</a></div><div><p>" + "Long text of the page. " * 10 + "<p>And its end.</div><div><a>q</a><a>r</a></div></body>"
    assert html_text.main_text(bare).split("\n\n") == [("Long text of the page. " * 10).strip(), "And its end."]
    assert html_text.main_text("no markup at all") == "no markup at all"
    assert html_text.main_text("<p>unclosed <b>bold") == "unclosed bold"
    assert len(html_text.main_text("<article>" + "<div>" * 3000 + "x" * 10**6)) == 10**6


def test_extract_in_spark(spark):
    df = spark.createDataFrame([(1, PAGE, "t"), (2, None, None), (1, PAGE, "t")], "page_id long, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "html", "text", "main_text"] and sorted(len(r["main_text"]) for r in out.collect())[0] == 0
    assert html_text.extract(df.limit(0)).count() == 0


def test_fold_and_match():
    assert toxicity.fold("An IDI0T, 1d1ot & іdіоt​!") == " an idiot idiot idiot "
    assert toxicity.fold(None) == toxicity.fold("") == "  "
    lexicon = toxicity.Lexicon({" idiot ": 2.0, " fool": 1.0}, frozenset({" april fool "}))
    assert sorted(lexicon.hits(toxicity.fold("Fools and an idiot, idiots; April fool")).values()) == [1.0, 2.0]
    assert toxicity.Lexicon({}).features("  ") == (0.0, 0.0, 0.0)


def labelled(rng, n, bad, good):
    rows = []
    for i in range(n):
        y = int(i % 4 == 0)
        ws = rng.choices(good, k=rng.randrange(20, 120))
        if y:
            for _ in range(3):
                ws[rng.randrange(len(ws))] = rng.choice(bad)
        rows.append((i, " ".join(ws), y))
    return rows


def test_toxicity_learns(spark):
    rng = random.Random(3)
    good = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "vi", "pe")]
    rows = labelled(rng, 800, ["grobnik", "Gr0bnik", "zemplar", "zemplaris"], good)
    texts = spark.createDataFrame(rows[:600], "doc_id long, text string, y int")
    lexicon = toxicity.fit(texts)
    assert any("grob" in k for k in lexicon.weights)
    test = spark.createDataFrame(rows[600:] + [(9001, None, 0), (9002, "", 0)], "doc_id long, text string, y int")
    out = toxicity.scored(test, lexicon).collect()
    assert np.mean([(r["toxicity"] >= 0.5) == r["y"] for r in out]) > 0.97 and all(0 <= r["toxicity"] <= 1 for r in out)
    assert toxicity.scored(test, toxicity.fit(texts.where("y = 0"))).where("toxicity >= 0.5").count() == 0


def test_quality_learns(spark):
    rng = random.Random(4)
    good = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "vi", "pe")]
    rows = []
    for i in range(500):
        ws = rng.choices(good, k=rng.randrange(20, 100))
        y = int(i % 3 != 0)
        rows.append((i, " ".join(ws) if y else " ".join(w.upper() + "!!" for w in ws), y))
    model = quality.fit(spark.createDataFrame(rows[:400], "doc_id long, text string, y int"))
    test = spark.createDataFrame(rows[400:] + [(900, None, 0), (901, "", 0)], "doc_id long, text string, y int")
    out = quality.scored(test, model).collect()
    assert np.mean([(r["quality"] >= 0.5) == r["y"] for r in out]) > 0.95 and all(0 <= r["quality"] <= 1 for r in out)
    assert {r["quality"] for r in quality.scored(test, None).collect()} == {0.5}


def test_held_out(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", held_out(5, 0))
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows.collect())


@needs_tables
@pytest.mark.parametrize(("name", "target"), [("op6_toxic_lexicon", "toxic"), ("op8_random_indexing", "quality")])
def test_held_out_accuracy(spark, name, target):
    from phasewise.llm.queries import QUERIES

    out = QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert out.count() == docs and np.mean([r["predicted"] == r[target] for r in rows]) > 0.9


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "ü" * 100 + "</p>\r\n\r\nWARC/1.1"
    rows = [(7, "http://a\r\nb", body), (3, "u", body), (9, None, body), (4, "u", "small"), (2, "u", "small"), (5, "u", None), (6, "u", "x" * 3_000_000), (None, "n", "y" * 200), (8, "n", "y" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write(df.repartition(3), str(tmp_path / "w"))
    assert index.count() == len(rows)
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(spark, str(tmp_path / "w")).collect()), key=str)
    size = len(body.encode())
    want = [(0, "response", None, 200), (2, "response", None, 5), (3, "response", None, size), (4, "response", None, 5), (5, "response", None, 0), (6, "response", None, 3_000_000), (7, "revisit", 3, size), (8, "response", None, 200), (9, "revisit", 3, size)]
    assert got == sorted(want, key=str)
    one = warc.read(spark, str(tmp_path / "w"), index.where("page_id = 3")).collect()
    assert len(one) == 1 and bytes(one[0]["payload"]) == body.encode()


def test_bundle_is_plain_zstandard(tmp_path):
    import zstandard

    writer = warc.BundleWriter(open(tmp_path / "b", "wb"))
    records = [warc.record(i, "u", "d", 600_000, None, os.urandom(600_000)) for i in range(5)]
    places = [writer.add(r) for r in records]
    writer.close()
    import pyarrow.fs as pf

    reader = warc.BundleReader(pf.LocalFileSystem().open_input_file(str(tmp_path / "b")))
    assert len(reader.frames) == 5
    for (frame, at), r in zip(places, records, strict=True):
        assert reader.frame(frame)[at : at + len(r)] == r
    with open(tmp_path / "b", "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(records)


def test_warc_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


@needs_tables
@needs_vocabulary
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("e")).limit(300)
    columns = docs.columns
    ids = {r["doc_id"] for r in docs.collect()}
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-stage-{i}-{random.random()}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
        if i < len(p.STAGES) - 1:
            assert docs.columns == columns
    assert {"bin_id", "capacity", "bin_offset"} <= set(docs.columns)


@needs_tables
@pytest.mark.parametrize("name", ["op7_window_index", "op9_seekable_warc"])
def test_queries_match_sql(spark, name):
    import duckdb

    from phasewise.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    cols = [c[0] for c in con.description]
    got = [tuple(r[c] for c in cols) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


CLASHES = (
    "key starts n_removed kept_text quality toxicity f fp first component_id ids decoded main_text html_ n_words kept base_failed script band n_tokens x y low high tag "
    "digest payload size refers_to row start stop y_ label h found count n shard piece bin_id"
).split()


@needs_vocabulary
def test_clashing_columns(spark):
    from phasewise.llm import simhash, substring

    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, "en"), (2, "x " + long, "en"), (3, long, None), (None, "null id", "en"), (4, None, "en"), (4, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in CLASHES})
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for out in (fertility.keep_good(df), quality.keep_good(df, labels), simhash.keep_one(df), substring.remove_passages(df)):
        assert out.columns == df.columns
        assert all(r[c] == c for r in out.collect() for c in CLASHES)
    assert sorted(r["doc_id"] or 0 for r in substring.remove_passages(df).collect()) == [0, 1, 2, 4, 4]
    same = pieces.decode(pieces.encode(df)).collect()
    assert all(r["decoded"] == (r["text"] or "") and r["key"] == "key" for r in same)
    assert toxicity.scored(df, toxicity.Lexicon({" w1 ": 1.0})).count() == html_text.extract(df.withColumn("html", F.col("text"))).count() == 6
    assert packing.pack_documents(df).count() == 6 and fertility.judged(df).where("kept is null").count() == 0


def test_main_text_without_end_of_head():
    text = "Long text of the article. " * 10
    for head in ("<html><head><title>t</title><body>", "<head><title>t</title>", "<head><title>t</title><meta charset=utf-8><body>"):
        assert html_text.main_text(f"{head}<article><p>{text}</p></article>") == text.strip()
    assert html_text.main_text("<head><title>t</title>Text at once") == "Text at once"
    assert html_text.main_text("<head><template><div>x</div></template><title>t</title></head><p>y") == "y"


def test_main_text_in_a_marked_wrapper():
    text, plain, reply = "Long text of the article. " * 10, "Plain words of the page. " * 10, "I reply at length. " * 5
    comments = f"<div class=comments><article><p>{reply}</p></article></div>"
    wrapped = f"<div class='layout has-sidebar'><article><p>{text}</p><p class=share>x</p></article>{comments}<p>y</p></div>"
    assert html_text.main_text(wrapped) == text.strip()
    assert html_text.main_text(wrapped.replace("article", "main", 1).replace("</article>", "</main>", 1)) == text.strip()
    assert html_text.main_text(f"<article><p>{text}</p></article>{comments}") == text.strip()
    assert html_text.main_text(f"<div><p>{plain}</p></div>{comments}") == plain.strip()
    assert html_text.main_text(f"<div hidden><article>{text}</article></div>") == ""


STORY = "Long text of the article, which goes on for a while. " * 8


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='page has-sidebar'><article><p>{STORY}</p></article></div>",
        f"<div class='page has-sidebar'><p>{STORY}</p></div>",
        f"<div class='sidebar'><div><p>{STORY}</p></div></div>",
        f"<div class='post comments-enabled'><p>{STORY}</p></div>",
        f"<div class='widget-content'><p>{STORY}</p></div>",
        f"<div class='no-banner'><p>{STORY}</p></div>",
        f"<form><nav>a b</nav><div><p>{STORY}</p></div><button>Go</button></form>",
        f"<form action=/><p>{STORY}</p></form>",
        f"<div class=ad>Buy now</div><div><p>{STORY}</p></div><div class=comments><p>{'I reply at some length. ' * 30}</p></div>",
    ],
)
def test_no_class_or_form_loses_the_article(page):
    assert html_text.main_text(page) == html_text.main_text(f"<body>{page}") == STORY.strip()


def plain_pages(rng, n):
    """Pages of div elements without any telling name, and their blocks of content."""
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    links = lambda k: "".join(f"<a href=/{word()}>{word()}</a> " for _ in range(k))
    for _ in range(n):
        blocks = [prose(rng.randrange(4, 9)), *(prose(rng.randrange(30, 90)) for _ in range(rng.randrange(4, 10)))]
        body = "".join(f"<h1>{x}</h1>" if i == 0 else f"<p>{x}</p>" for i, x in enumerate(blocks))
        before = "".join(f"<div>{links(rng.randrange(3, 9))}</div>" for _ in range(rng.randrange(2, 5)))
        after = "".join(f"<div><ul>{''.join(f'<li>{links(1)}' for _ in range(6))}</ul></div>" for _ in range(rng.randrange(2, 5)))
        yield f"<html><body><div><div>{before}</div><div>{body}</div><div>{after}</div><div>{links(2)} {word()}</div></div>", blocks


def test_ratio_and_threshold_choose_the_text(monkeypatch):
    pages = list(plain_pages(random.Random(8), 60))
    right = lambda: np.mean([html_text.main_text(h).split("\n\n") == blocks for h, blocks in pages])
    assert right() > 0.95
    # Without the threshold, without the ratio, or without smoothing pages come out otherwise.
    monkeypatch.setattr(html_text, "threshold", lambda smooth: -1.0)
    assert right() == 0
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "ratios", lambda lines: np.ones(len(lines)))
    assert right() == 0
    monkeypatch.undo()
    mixed = "<div><a>x</a> <a>y</a> <a>z</a></div><div><p>" + "</p><p>".join([STORY, "A <i>b</i> <i>c</i>.", STORY]) + "</p></div><div><a>q</a> <a>r</a></div>"
    assert html_text.main_text(mixed) == f"{STORY.strip()}\n\nA b c.\n\n{STORY.strip()}"
    lines = html_text.LineParser()
    lines.feed(mixed)
    ratio = html_text.ratios(lines.finish())
    assert (html_text.smoothed(ratio) >= html_text.threshold(html_text.smoothed(ratio))).sum() != (ratio >= html_text.threshold(ratio)).sum()


def test_main_text_of_very_long_pages():
    lines = [f"Line {i} of a very long page with words enough." for i in range(60_000)]
    assert html_text.main_text("<nav>x</nav><div><p>" + "<p>".join(lines) + "</div>") == "\n\n".join(lines)
    assert html_text.main_text("<p>" + " " * 1_000_000 + "x" * 1_000_000) == "x" * 1_000_000
    assert html_text.main_text("<div>" * 50_000 + STORY) == STORY.strip()


def test_windows_are_numbered_once_where_their_numbers_fit(monkeypatch):
    rng = np.random.default_rng(13)
    code, row = rng.integers(0, 30, 4000), np.sort(rng.integers(0, 9, 4000))
    want = [(row[i], *code[i : i + 3]) for i in range(3998)]
    asked = []
    plain = spans._numbered
    monkeypatch.setattr(spans, "_numbered", lambda x: asked.append(1) or plain(x))
    for most, times in ((1 << 63, 1), (1 << 10, 3)):
        monkeypatch.setattr(spans, "MOST", most)
        asked.clear()
        gram, whole = spans.gram_codes(code, row, 3)
        assert len({*zip(want, gram.tolist(), strict=True)}) == len(set(want)) == len(set(gram.tolist()))
        assert whole.tolist() == [row[i] == row[i + 2] for i in range(3998)] and len(asked) == times


def test_scripts_and_counts_of_bytes():
    texts = ["", "abc # déf", "Ωμέγα αβγ $", "привет мир", "漢字 かな", "12 34", "שלום"]
    data, off = spans.buffers(pa.array(texts))
    assert fertility.script_of(data, off) == ["other", "latin", "greek", "cyrillic", "asian", "other", "semitic"]
    assert [x.tolist() for x in fertility.base_counts(data, off)[1:3]] == [[len("".join(t.split())) for t in texts], [0, 1, 1, 0, 0, 0, 0]]
