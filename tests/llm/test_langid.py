import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshloom.llm import langid
from meshloom.llm.arrow_text import BASE, split
from meshloom.llm.queries import QUERIES


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(0)
    e, start, move = rng.normal(size=(9, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    bounds = np.array([0, 4, 4, 9])
    g, pairs = langid.posteriors(e, bounds, start, move, pairs=True)
    want, want_pairs = np.zeros_like(e), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 9)):
        total, part, pair = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=b - a):
            s = start[y[0]] + sum(e[a + i, c] for i, c in enumerate(y)) + sum(move[c, d] for c, d in itertools.pairwise(y))
            p = np.exp(s)
            total += p
            for i, c in enumerate(y):
                part[i, c] += p
            for c, d in itertools.pairwise(y):
                pair[c, d] += p
        want[a:b] = part / total
        want_pairs += pair / total
    assert np.allclose(g, want) and np.allclose(pairs, want_pairs)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op2_crf_language"](spark, d).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and 0.2 < len(held) / len(got) < 0.3
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_edges_and_code_switching(spark):
    en = "the and of that with this for was are they have from".split()
    fr = "le la les des est dans pour que qui sur avec une".split()
    rows = [(i, " ".join((en if i % 2 else fr)[(i + j) % 12] for j in range(30)), "en" if i % 2 else "fr") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "2 AS passage", "3 AS k"))
    test = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? —"), (4, "The OF that"), (5, " ".join(fr * 3 + en * 2)), (5, "日本")], "doc_id long, text string").selectExpr("*", "'x' AS lang_pred", "1 AS score")
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(test, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr")} <= got
    from meshloom.llm.arrow_text import Memo

    w = next(split(pa.RecordBatch.from_arrays([pa.array([" ".join(fr + en)])], names=["text"]), lower=True))
    labels = model.words(w, Memo(8, 2, np.float32), langid._letters(w)).argmax(axis=1)
    assert list(labels) == [model.langs.index("fr")] * 12 + [model.langs.index("en")] * 12
    assert {r.lang_pred for r in langid.predict(test, None).collect()} == {"und"} and langid.predict(test.limit(0), model).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 1024])
def test_pieces_change_nothing(monkeypatch, piece):
    rng = np.random.default_rng(1)
    e, start, move = rng.normal(size=(60, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    bounds = np.array([0, 0, 1, 30, 33, 33, 60])
    want, pairs = langid.posteriors(e, bounds, start, move, pairs=True)
    monkeypatch.setattr(langid, "PIECE", piece)
    got, again = langid.posteriors(e, bounds, start, move, pairs=True)
    assert np.allclose(got, want) and np.allclose(pairs, again)


def brute(model, text):
    """Label and score of one text, word by word in plain Python."""
    mask, base = (1 << 64) - 1, int(BASE)

    def spread(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    b = [spread((i + 1) * base & mask) for i in range(256)]
    e, use = [], []
    for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split():
        word = next(split(pa.RecordBatch.from_arrays([pa.array([w.decode()])], names=["text"]))).hashes()
        f = [int(word[0])]
        for k in (1, 2, 3):
            if len(w) >= k:
                for tag, part in ((k, w[:k]), (k + 3, w[-k:])):
                    x = tag
                    for c in part:
                        x = spread((x * base + b[c]) & mask)
                    f.append(x)
        for i in range(len(w)):
            x = b[w[i - 1]] if i else 7
            x = (x * base + b[w[i]]) & mask
            f.append(spread((x * base + (b[w[i + 1]] if i + 1 < len(w) else 11)) & mask))
        use.append(any(c.isalpha() for c in w.decode()))
        e.append([float(sum(model.weights[x % langid.BUCKETS, c] for x in f)) * use[-1] for c in range(len(model.langs))])
    if not any(use):
        return "und", 0.0
    k = range(len(model.langs))
    a, back = [[model.start[c] + e[0][c] for c in k]], [[0.0 for _ in k]]
    for x in e[1:]:
        a.append([x[c] + logsum([a[-1][d] + model.move[d, c] for d in k]) for c in k])
    for x in e[:0:-1]:
        back.append([logsum([model.move[c, d] + x[d] + back[-1][d] for d in k]) for c in k])
    total = [0.0 for _ in k]
    for x, y, u in zip(a, back[::-1], use, strict=True):
        z = logsum([x[c] + y[c] for c in k])
        for c in k:
            total[c] += u * math.exp(x[c] + y[c] - z)
    best = max(k, key=lambda c: total[c])
    return model.langs[best], total[best] / sum(total)


def logsum(x):
    top = max(x)
    return top + math.log(math.fsum(math.exp(v - top) for v in x))


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    learn = docs.where(F.col("doc_id").isin([i for i in texts if not held[i]]))
    model = langid.train(learn)
    got = QUERIES["op2_crf_language"](spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == held[r.doc_id]
        if len(texts[r.doc_id] or "") < 6000:
            lang, score = brute(model, texts[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_long_labels_and_rare_languages(spark):
    """Labels on long texts only, a language with three of 2,003 rows, and letterless and null rows between them."""
    en, fr, ru = "the and of that with this".split(), "le la les des est dans".split(), "и в не на что он".split()
    long = lambda w, i: " ".join(w[(i + j * j) % 6] for j in range(7000))
    rows = [(i, long(en if i % 2 else fr, i), "en" if i % 2 else "fr") for i in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fr"]
    rows = [(i, " ".join(en[(i + j) % 6] for j in range(9)), "en") for i in range(2000)] + [(3000 + i, " ".join(ru), "ru") for i in range(3)] + [(5000 + i, "12 34", "en") for i in range(2000)] + [(9000, None, "xx"), (9001, "1 " * 9000 + "ça", "fr")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=90)
    assert model.langs == ["en", "fr", "ru"]
    test = spark.createDataFrame([(1, "и не он"), (2, "the this of"), (3, long(ru, 0) + " " + long(en, 0)[:9000])], "doc_id long, text string")
    assert {(r.doc_id, r.lang_pred) for r in langid.predict(test, model).collect()} == {(1, "ru"), (2, "en"), (3, "ru")}


def test_transitions_see_switches(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in (("alpha beta gamma delta " * 20, "a"), ("uno dos tres cuatro " * 20, "b"))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    m = np.exp(model.move)
    assert (np.diag(m) > m[[0, 1], [1, 0]]).all() and (m[[0, 1], [1, 0]] > 0.005 * np.diag(m)).all()


def test_letters_of_all_scripts():
    text = "a 1 é ß 中 ½ Ⅷ ² 𝔸 😀 _ я1 ª \u0660 x\u0301 \u0301"
    w = next(split(pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])))
    assert langid._letters(w).tolist() == [any(c.isalpha() for c in x) for x in text.split(" ")]


def test_one_text_of_several_megabytes(spark):
    """More different words than the table of words holds."""
    model = langid.Model(["en", "fr"])
    text = " ".join(f"w{i % 900_000}" for i in range(1_000_000))
    got = langid.predict(spark.createDataFrame([(1, text), (2, "w1")], "doc_id long, text string").coalesce(1), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "en"), (2, "en")]
