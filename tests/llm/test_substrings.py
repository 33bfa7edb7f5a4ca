import hashlib
import random

import pytest

from meshloom.llm.substrings import remove_repeats


def brute(docs):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - 49):
                s = tuple(w[k : k + 50])
                first[s] = min(first.get(s, i), i)
    out = set()
    for i, w in split:
        keep = [True] * len(w)
        if i is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < i:
                    keep[k : k + 50] = [False] * 50
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.add((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def rows(df):
    return {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_on_patched_texts(spark, seed):
    """Passages of 30 to 120 words in random order, with edits, periods and repeats."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    pool = [[rng.choice(words) for _ in range(rng.choice([30, 49, 50, 51, 60, 74, 75, 76, 120]))] for _ in range(12)] + [["x", "y", "z"] * 40, ["q"] * 130]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(pool))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = rng.choice(words)
            text += part + [rng.choice(words) for _ in range(rng.choice([0, 0, 1, 20]))]
        docs.append((i, rng.choice([" ", "\n"]).join(text)))
    docs += [(100, docs[3][1]), (101, docs[3][1].replace(" ", "\n")), (102, None), (103, ""), (104, "é" * 50), (None, docs[5][1]), (105, docs[7][1]), (105, docs[7][1])]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS start", "'a' AS name", "2 AS n_words")
    assert rows(remove_repeats(df)) == brute(docs)


def test_rows_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(2, t), (2, t), (1, t)], "doc_id long, text string")
    got = remove_repeats(df)
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in got.where("doc_id = 2").collect()) == [(2, 60, "")] * 2
    assert got.count() == 3 and remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("turn", [1, -1])
def test_one_id_with_several_texts(spark, turn):
    """Each text is a document of its id, whatever the order of the rows."""
    rng = random.Random(3)
    part = [" ".join(f"p{k}w{rng.randrange(10**6)}" for _ in range(80)) for k in range(6)]
    docs = [(5, part[0]), (5, part[1] + " x " + part[2]), (5, "short text"), (7, part[2] + " y " + part[0]), (7, part[1]), (7, part[3]), (8, part[3].replace(" ", "  ")), (8, part[3]), (9, f"a {part[4]}"), (9, f"b {part[4]}")][::turn]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(remove_repeats(df)) == brute(docs)
    assert remove_repeats(df).count() == len(docs)


def test_words_decide(spark):
    """Passages that the graph takes for one path are told apart by their words."""
    from meshloom.llm.substrings import proposals

    words = [[f"{k}w{i}" for i in range(60)] for k in range(2)]
    texts = spark.createDataFrame([(1, 0, " ".join(words[0])), (2, 0, " ".join(words[1])), (3, 0, "\n".join(words[0]))], "doc_id long, tag long, text string")
    marks = spark.createDataFrame([(i, 0, [(0, 0, 60)]) for i in (1, 2, 3)], "doc_id long, tag long, marks array<struct<at: int, start: int, stop: int>>")
    got = {r.doc_id: (list(r.start), list(r.stop), list(r.d1), list(r.d2)) for r in proposals(texts, marks).collect()}
    assert got[1] == got[3] and got[1][:2] == got[2][:2] == ([0], [60]) and got[1][2] != got[2][2] and got[1][3] != got[2][3]
