"""The pipeline's rows against a version of each stage in plain Python."""

import hashlib
import math
from pathlib import Path

import corpus_pipeline
import pytest
import test_lines
import test_native
import test_neardup
from meshloom.llm import quality

D = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\f\r"


def read(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{D}/{name}.parquet").collect()]


def values(text):
    """Rule values and whether the base rule fails."""
    n, chars, symbols, dups, repeats = test_native.repeats(text)
    lines = sum(bool(x.strip(WHITE)) for x in (text or "").split("\n"))
    ratio = lambda a, b: a / b if b else 0.0
    shouts = (text or "").count("!")
    return {"symbols": ratio(symbols, chars), "dup_lines": ratio(dups, lines), "repeats": ratio(repeats, n), "shouts": ratio(shouts, n)}, n < 10 or 100 * repeats > 20 * n


def quality_rules(docs, labels, alpha):
    marks = {}
    for x in labels:
        if x["doc_id"] is not None and x["quality"] is not None:
            marks[x["doc_id"]] = min(x["quality"], marks.get(x["doc_id"], 1))
    cutoffs = test_native.plan([(d["doc_id"], d["lang"], marks[d["doc_id"]], values(d["text"])[0]) for d in docs if marks.get(d["doc_id"]) in (0, 1)], alpha)

    def keeps(d):
        v, failed = values(d["text"])
        return not failed and not any(c is not None and v[r] > c for r, c in cutoffs.get(d["lang"] or "", {}).items())

    return [d for d in docs if keeps(d)], cutoffs


def line_dedup(docs):
    out = []
    kept = {i: (t, gone) for i, _, gone, t in test_lines.brute([(d["doc_id"], d["text"]) for d in docs])}
    for d in docs:
        text, gone = kept[d["doc_id"]]
        if not gone:
            out.append(d)
        elif text.strip(WHITE):
            out.append(d | {"text": text, "n_chars": len(text)})
    return out


def near_dedup(docs):
    kept = {i for i, _, _, k in test_neardup.brute([(d["doc_id"], d["text"]) for d in docs]) if k}
    return [d for d in docs if d["doc_id"] in kept]


def decontamination(docs, items):
    bad = {x[0] for x in test_native.contamination([(d["doc_id"], d["text"]) for d in docs], [(b["item_id"], b["text"]) for b in items]) if x[4]}
    return [d for d in docs if d["doc_id"] not in bad]


def mix(docs):
    """(doc_id, source, n_tokens, block, copies) at the exponent that repeats no source more than four times."""
    draw = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:15], 16)
    by = {}
    for d in docs:
        by.setdefault(d["source"], []).append((d["doc_id"], len((d["text"] or "").encode().split())))
    sizes = {s: sum(n for _, n in own) for s, own in by.items()}
    top, least = max(sizes.values()), min(n for n in sizes.values() if n)
    t = max(0.0, 1 - math.log(4) / math.log(top / least)) if top > least else 0.0
    out = set()
    for s, own in by.items():
        k = round((sizes[s] / top) ** (t - 1), 9) if sizes[s] else 1.0
        rest = round((k - int(k)) * sizes[s], 6)
        blocks = {}
        for i, n in own:
            blocks.setdefault(draw(0, i) % max(1, len(own) // 256), []).append((i, n))
        before = 0
        for b in sorted(blocks, key=lambda b: (draw(1, s, b), b)):
            size, run = sum(n for _, n in blocks[b]), 0
            for i, n in sorted(blocks[b], key=lambda x: (draw(2, x[0]), x[0])):
                run += n
                more = rest > 0 and (before + size <= rest or before < rest and before + run <= rest)
                out.add((i, s, n, b, int(k) + more))
            before += size
    return out


@pytest.mark.parametrize("alpha", [quality.ALPHA, 0.2])
def test_every_stage_equals_plain_python(spark, monkeypatch, alpha):
    """At an alpha of 0.2 the few labels of the small tables prove some cutoffs."""
    if alpha != quality.ALPHA:
        keep_good = quality.keep_good
        monkeypatch.setattr(quality, "keep_good", lambda docs, labels: keep_good(docs, labels, alpha))
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kind = docs.dtypes
    want, cutoffs = quality_rules(read(spark, "documents"), read(spark, "labels"), alpha)
    assert bool(cutoffs) == (alpha == 0.2)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "quality_rules":
            want = line_dedup(want) if name == "line_dedup" else near_dedup(want) if name == "near_dedup" else decontamination(want, read(spark, "benchmark"))
        now = stage(spark, now, D).cache()
        assert now.dtypes == kind
        key = lambda d: d["doc_id"]
        assert sorted((r.asDict() for r in now.collect()), key=key) == sorted(want, key=key), name
    last = corpus_pipeline.STAGES[-1][1](spark, now, D)
    assert {tuple(r) for r in last.select("doc_id", "source", "n_tokens", "block", "copies").collect()} == mix(want)


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mix_sources"]
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.glob("pipeline-*"))
    got = {tuple(r) for r in corpus_pipeline.run(spark, D).select("doc_id", "source", "n_tokens", "block", "copies").collect()}
    docs, _ = quality_rules(read(spark, "documents"), read(spark, "labels"), quality.ALPHA)
    assert got == mix(decontamination(near_dedup(line_dedup(docs)), read(spark, "benchmark")))
    made = set(folder.glob("pipeline-*")) - before
    assert [x.name for f in made for x in f.iterdir()] == ["3-decontamination"]
