import hashlib
import random

from meshloom.llm import lines

D = "/root/testdata/sf0.001"


def text(rng, n):
    return "\n".join(f"line {rng.random()}" for _ in range(n))


def cut(text):
    """Chunks of a text by the rule, in plain Python."""
    ls = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
    r = [sum(h[i - j] * 31**j for j in range(3) if i >= j) % (2**31 - 1) for i in range(len(h))]
    stops = [i for i in range(len(h)) if i == len(h) - 1 or 0 < i < len(h) - 2 and r[i - 1] > r[i] <= r[i + 1]]
    return ["\n".join(ls[a + 1 : b + 1]) for a, b in zip([-1, *stops], stops, strict=False)]


def brute(docs):
    """(doc_id, n_lines, n_removed_lines, kept text) of documents with distinct ids."""
    seen, out = set(), set()
    for i, t in sorted((d for d in docs if d[1]), key=lambda d: d[0]):
        kept = []
        for c in cut(t):
            if "\n" in c and c.strip(" \t\n\x0b\f\r") and (c in seen or seen.add(c)):
                continue
            kept.append(c)
        n = t.count("\n") + 1
        text = "\n".join(kept)
        out.add((i, n, n - sum(c.count("\n") + 1 for c in kept), text))
    return out | {(i, 0, 0, t) for i, t in docs if not t}


def test_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    rng = random.Random(2)
    pool = [text(rng, n) for n in (1, 2, 3, 5, 8, 13)] + ["\n\n\n", "", " \n \n "]
    docs += [(10_000 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 5)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in lines.dedup_report(df).collect()} == brute(docs)


def test_every_line_of_a_copy_goes(spark):
    rng = random.Random(1)
    first = [text(rng, n) for n in range(2, 42)]
    rows = [(i, t) for i, t in enumerate(first + first)] + [(98, "alone"), (99, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in lines.dedup_report(df).collect():
        assert (r.n_removed_lines, r.kept_text) == ((r.n_lines, "") if len(first) <= r.doc_id < 98 else (0, dict(rows)[r.doc_id]))
    assert {r.doc_id for r in lines.remove_repeated(df).collect()} == {*range(len(first)), 98, 99}


def test_lines_before_move_boundaries_and_only_near_ones(spark):
    rng = random.Random(4)
    ls = [f"line {rng.random()}" for _ in range(400)]
    stops = lambda x: {sum(c.count("\n") + 1 for c in x[: i + 1]) - 1 for i in range(len(x))}
    texts = ["\n".join(ls)] + ["\n".join([*ls[:k], "other", *ls[k + 1 :]]) for k in range(50, 350, 3)] + ["\n".join(["more", *ls])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: stops([c.body for c in r.c]) for r in df.select("doc_id", lines.chunks(df["text"]).alias("c")).collect()}
    assert got[0] == stops(cut(texts[0]))
    moved_after = 0
    for i, k in enumerate(range(50, 350, 3), 1):
        changed = got[0] ^ got[i]
        assert all(k - 1 <= x <= k + 3 for x in changed)
        moved_after += any(x > k for x in changed)
    assert moved_after > 20  # a line decides about boundaries after later lines
    assert {x - 1 for x in got[len(texts) - 1] if x > 4} == {x for x in got[0] if x > 3}  # a line ahead shifts nothing further on


def test_one_id_with_several_texts(spark):
    a, b = "one\ntwo", "three\nfour"
    docs = [(1, a), (2, a), (2, b), (3, b), (None, a)]
    got = sorted((r.doc_id or 0, r.n_removed_lines) for r in lines.dedup_report(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (2, 2), (3, 2)]
