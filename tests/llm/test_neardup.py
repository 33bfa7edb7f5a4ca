import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import neardup
from meshloom.llm.neardup import components, groups, superminhash


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    """docs: (id, text); the contract's rows."""
    sets = {i: shingle_set(t) for i, t in docs}
    ids = [i for i in sets if sets[i]]
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    seen = set()
    for owners in where.values():
        for a in owners:
            for b in owners:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def rows(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(groups(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def chains(seed, n=220):
    """Texts that drift word by word, so that links form long chains and stop near the threshold."""
    rng, docs = random.Random(seed), []
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(60)]
    for i in range(n):
        if i % 40 == 0:
            base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        base = list(base)
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = rng.choice(words)
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(base)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force_on_chains(spark, seed):
    docs = chains(seed) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "two one"), (1006, "a b c d e " * 4000), (1007, "A B C D E " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS n", "'y' AS sig", "1 AS component_id")
    assert rows(groups(df)) == brute(docs)


def test_nulls_repeats_and_empty(spark):
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (3, t.upper())], "doc_id long, text string")
    got = sorted(map(tuple, groups(df).collect()), key=str)
    assert got == sorted([(None, 6, None, True), (5, 6, 3, False), (5, 6, 3, False), (3, 6, 3, True)], key=str)
    assert groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [0, 200_000])
@pytest.mark.parametrize("order", ["shuffled", "sorted"])
def test_components_of_a_long_path(spark, monkeypatch, one_task, order):
    monkeypatch.setattr(neardup, "ONE_TASK", one_task)
    n = 300
    ids = random.Random(0).sample(range(1000), n)
    if order == "sorted":
        ids.sort()
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(2000, 2001)], "a long, b long").repartition(40)
    got = {tuple(r) for r in components(links).select("node", "component").collect()}
    assert {x for x in got if x[0] != x[1]} == {(i, min(ids)) for i in ids if i != min(ids)} | {(2001, 2000)}


def test_a_chain_in_order_takes_few_rounds(spark, monkeypatch):
    """1,000 nodes over 100 partitions."""
    monkeypatch.setattr(neardup, "ONE_TASK", 0)
    rounds = []
    flat = neardup._flat
    monkeypatch.setattr(neardup, "_flat", lambda step: rounds.append(1) or flat(step))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = components(spark.range(1000).selectExpr("id AS a", "id + 1 AS b").repartition(100)).where("node <> component").agg(F.count("*"), F.max("component")).head()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(got) == (1000, 0) and len(rounds) <= 3


def test_one_id_with_several_texts(spark):
    """Each text is a document of its id: no link is lost, and one row of each group stays."""
    a, b, c = ("one two three four five six seven", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "p q r s t u v")
    docs = [(3, a), (5, a), (5, b), (7, b + " zz"), (7, c), (8, c), (8, c), (9, "x y"), (9, "x y"), (9, "q q"), (10, None), (10, None)]
    for rows_ in (docs, docs[::-1]):
        df = spark.createDataFrame(rows_, "doc_id long, text string").selectExpr("*", "'k' AS text_tag", "1 AS k").repartition(3)
        got = sorted((r.doc_id, r.component_id) for r in groups(df).collect())
        assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (7, 7), (8, 7), (8, 7), (9, 9), (9, 9), (9, 9), (10, 10), (10, 10)]
        kept = neardup.keep_first(df)
        assert kept.columns == df.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(3, a), (5, b), (7, c), (9, "q q"), (9, "x y"), (10, ""), (10, "")])


def test_hot_keys_without_broadcasts(spark, monkeypatch):
    """Joins by shuffle, with hot keys dealt over tasks, find the same groups."""
    from meshloom.llm import joins

    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    monkeypatch.setattr(neardup, "ONE_TASK", 0)
    docs = chains(3, 80) + [(500 + i, "the same text of seven words here") for i in range(40)] + [(600 + i, " ".join(f"n{j}" for j in range(60)) + f" tail{i}") for i in range(40)]
    assert rows(groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_signature_equals_sequential_definition():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    doc = np.repeat([0, 2], [39, 1])
    got = superminhash(h, doc, 3, 16)
    want = np.full((3, 16), 0xFFFFFFFF, np.uint64)
    for e, d in zip(h, doc, strict=True):
        perm = list(range(16))
        for j in range(16):
            x = int(neardup.mix(np.array([(int(e) + (j + 1) * int(neardup.BASE)) % (1 << 64)], np.uint64))[0])
            k = j + ((x >> 32) * (16 - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            want[d, perm[j]] = min(int(want[d, perm[j]]), j << 24 | x & 0xFFFFFF)
    assert (got == want).all()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    s = superminhash(np.concatenate([a, b]), np.repeat([0, 1], 400), 2)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12


def test_keep_first_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k in brute([(r.doc_id, r.text) for r in docs.collect()]) if k}


@pytest.mark.parametrize("block", [4, 1024])
def test_blocked_comparison_alone_finds_the_components(spark, monkeypatch, block):
    """Every class is its own component at first, so all links must come from the comparison across components."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = chains(7, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    classes = neardup.sign(df).groupBy("set_id").agg(F.min(F.struct("doc_id", "tag", "n", "sig")).alias("c")).selectExpr("c.doc_id AS rep", "c.doc_id AS doc_id", "c.tag AS tag", "c.n AS n", "c.sig AS sig")
    at = neardup.bands(classes).selectExpr("key", "rep", "n", "rep AS c")
    suspects = neardup.strangers(at, classes)
    links = neardup.cross_links(suspects, classes.selectExpr("rep", "rep AS c"), classes, df)
    got = {r.node: r.component for r in components(links).collect()}
    assert all(got.get(i, i) == c for i, _, c, _ in brute(docs) if i in {r.rep for r in classes.collect()})
