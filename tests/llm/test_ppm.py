import math
import random
from collections import Counter

import numpy as np
import pytest

from meshloom.llm import ppm
from meshloom.llm.queries import QUERIES

D = "/root/testdata/sf0.001"


def normal(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def reference(train, floor):
    """Counts of all grams of six bytes and of their ends."""
    full = Counter()
    for t in train:
        s = b"\n" * ppm.ORDER + normal(t)
        full.update(s[i - ppm.ORDER : i + 1] for i in range(ppm.ORDER, len(s)))
    total = sum(full.values())
    every = []
    for k in range(ppm.ORDER + 1):
        c = Counter()
        for g, n in full.items():
            c[g[ppm.ORDER - k :]] += n
        every.append(c)
    after = [{} for _ in range(ppm.ORDER + 1)]
    for k, c in enumerate(every):
        for g, n in c.items():
            t, d, here = after[k].setdefault(g[:-1], (0, 0, {}))
            if n >= max(1.0, floor * total):
                here[g[-1]] = n
            after[k][g[:-1]] = (t + n, d + 1, here)
    return [{c: x for c, x in a.items() if x[2]} for a in after]


def brute(after, text):
    s, total = b"\n" * ppm.ORDER + normal(text), 0.0
    for i in range(ppm.ORDER, len(s)):
        out, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            if s[i - k : i] not in after[k]:
                continue
            t, d, here = after[k][s[i - k : i]]
            left = {b: n for b, n in here.items() if b not in out}
            size = t + d - sum(here[b] + 1 for b in out)
            if s[i] in left:
                p *= left[s[i]] / size
                break
            p *= (size - sum(left.values())) / size if size else 1.0
            out |= here.keys()
        else:
            p /= max(256 - len(out), 1)
        total += math.log10(p)
    return total


def test_query_equals_brute_force(spark):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    train = [t for i, t in docs.items() if not held[i]]
    after = reference(train, ppm.FLOOR)
    c = Counter(w for t in train for w in normal(t).split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    got = QUERIES["op5_ppm_score"](spark, D).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        if len(docs[r.doc_id] or "") > 8000:
            continue
        w = normal(docs[r.doc_id]).split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w) + 1, sum(x in c for x in w) + 1, n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert abs(r.score - brute(after, docs[r.doc_id])) < 1e-4 * abs(r.score)


@pytest.mark.parametrize("floor", [0.0, 2e-3, 2e-2])
def test_small_texts(spark, floor):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "abc", "Ba", "cé", "zz top", "a\tb"]) for _ in range(rng.randint(0, 12))) for _ in range(40)] + [None, "", "\x00\x00\x00\x00\x00\x00\x01"]
    rows = [(i, t, i % 5 == 0) for i, t in enumerate(texts)] + [(7, texts[7], False), (None, "ab", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").selectExpr("*", "1 AS n", "2 AS word")
    after = reference([t for _, t, h in rows if not h], floor)
    c = Counter(w for _, t, h in rows if not h for w in normal(t).split())
    got = ppm.score(df, floor=floor).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        assert abs(r.score - brute(after, text)) < 1e-4 * max(1, abs(r.score))
        assert r.n_known == 1 + sum(x in c for x in normal(text).split())


@pytest.mark.parametrize("travel", [2e-3, 2e-2, 1.0])
def test_joined_grams_and_words(spark, travel):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "abc", "Ba", "cé", "zz top", "a\tb"]) for _ in range(rng.randint(0, 12))) for _ in range(40)] + [None, "", "\x00\x00\x00\x00\x00\x00\x01", "qx ab", "qx ab"]
    rows = [(i, t, i % 5 == 0 or i >= 43) for i, t in enumerate(texts)] + [(7, texts[7], False), (43, texts[43], True)]
    after = reference([t for _, t, h in rows if not h], 0.0)
    c = Counter(w for _, t, h in rows if not h for w in normal(t).split())
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), travel=travel).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - brute(after, texts[r.doc_id])) < 1e-4 * max(1, abs(r.score))
        assert r.n_known == 1 + sum(x in c for x in normal(texts[r.doc_id]).split())


def test_rare_grams_count_in_large_corpora(spark):
    """The training text is above 1 / FLOOR bytes, so that a gram seen once is below the floor."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=1000)) for _ in range(1400)]
    texts += ["once upon a qjxzv", "a qjxzv upon once qjxzk"]
    rows = [(i, t, i % 100 == 50 or i == len(texts) - 1) for i, t in enumerate(texts)]
    train = [t for _, t, h in rows if not h]
    assert sum(len(normal(t)) for t in train) > 1 / ppm.FLOOR
    after = reference(train, 0.0)
    got = {r.doc_id: r.score for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    for i in (0, 50, len(texts) - 2, len(texts) - 1):
        assert abs(got[i] - brute(after, texts[i])) < 1e-4 * abs(got[i])


def test_no_training(spark):
    r = ppm.score(spark.createDataFrame([(1, "ab c", True)], "doc_id long, text string, held_out boolean")).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and abs(r.score + 5 * math.log10(256)) < 1e-4
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string, held_out boolean")).count() == 0


def test_probabilities_sum_to_one():
    data = b"\n\n\n\n\nabracadabra abra\n" * 3
    full = Counter(data[i - 5 : i + 1] for i in range(5, len(data)))
    for least in (1, 2, 5):
        tables, totals = [], []
        for k in range(6):
            c, t, d = Counter(), Counter(), Counter()
            for g, n in full.items():
                c[int.from_bytes(g[5 - k :], "big")] += n
            for g, n in c.items():
                t[g >> 8] += n
                d[g >> 8] += 1
            kept = sorted(g for g in c if c[g] >= least)
            contexts = sorted({g >> 8 for g in kept})
            tables.append((np.array(kept, np.uint64), np.array([c[x] for x in kept])))
            totals.append((np.array([t[x] for x in contexts]), np.array([d[x] for x in contexts])))
        check_sums(ppm.Trie(tables, totals))


def check_sums(trie):
    for ctx in (b"abrac", b"zzzzz", b"zzabr", b"\n\n\n\n\n"):
        g = (np.uint64(int.from_bytes(ctx, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** trie.score(g)).sum() - 1) < 1e-9


def test_adaptive_learns():
    assert ppm.adaptive_score(b"abc abc abc abc abc") > 4 * ppm.adaptive_score(b"abc ") and ppm.adaptive_score(b"") == pytest.approx(-math.log10(256))


def test_one_text_of_a_megabyte(spark):
    """More different grams than the table of grams holds: a text scores what its two halves score, but for the six bytes where they meet."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=6)) for _ in range(240_000)]
    half = len(words) // 2
    rows = [(1, " ".join(words), False), (2, " ".join(words[:half]), True), (3, " ".join(words[half:]), True)]
    got = {r.doc_id: r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1)).collect()}
    assert [got[i].n_known for i in (1, 2, 3)] == [got[i].n_tokens for i in (1, 2, 3)] == [len(words) + 1, half + 1, half + 1]
    assert abs(got[1].score - got[2].score - got[3].score) < 60
