import json

import numpy as np
import public_tokenizers
import pytest

from meshloom.llm import tokens
from meshloom.llm.arrow_text import Memo

PATHS = {k: public_tokenizers.path(k) for k in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")}
WORD = PATHS["word_bpe_49k.json"]
TEXTS = [
    None, "", " \t\n", "Hello  World's <|endoftext|>x<|startoftext|> 123 é café İstanbul x  y", "a" * 3000, ("word " * 900 + "z" * 2000 + "\n") * 3, "é中" * 900,
    "It's 42 o'clock; 'tis ne'er don't!! ### \U0001f600\U0001f600 x", "x\u0085y\u001cz​", "ΣΑΣ ß",
]


def whole(path, text):
    return int(tokens.library(path)([(text or "").encode()])[0])


@pytest.mark.parametrize("name", PATHS)
@pytest.mark.parametrize(("long", "overlap"), [(300, 16), (64, 8)])
def test_counts_equal_the_library(spark, name, long, overlap):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id long, text string").coalesce(1).withColumnRenamed("doc_id", "k")
    got = {r.k: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df, PATHS[name], "k", long=long, overlap=overlap).collect()}
    assert got == {i: (len((t or "").encode()), whole(PATHS[name], t)) for i, t in enumerate(TEXTS)}


def test_word_kind():
    assert tokens.splits_at_space(WORD) and not tokens.splits_at_space(PATHS["byte_bpe_50k.json"])


@pytest.mark.parametrize("pattern", ["[^\\s]+|\\s", "[^\\s]+|\\s{2}", "\\S+", "[^\\s\\p{L}\\p{N}]+|.", " ?[\\p{L}]+|[^\\s\\p{L}\\p{N}]+"])
def test_unknown_kinds_of_splitting(tmp_path, pattern):
    d = json.loads(open(WORD, encoding="utf-8").read())
    d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = pattern
    d["model"] |= {"vocab": {}, "merges": []}
    (tmp_path / "x.json").write_text(json.dumps(d))
    assert not tokens.splits_at_space(str(tmp_path / "x.json"))


@pytest.mark.parametrize("name", PATHS)
def test_one_long_text(name):
    """Production sizes, on a text of about a megabyte that has a word of 100,000 bytes."""
    text = (" ".join(f"word{i % 977}'s  é{i}\n" for i in range(40_000)) + "z" * 100_000 + " end " + "中文 " * 20_000).encode()
    ends = tokens.PieceEnds(PATHS[name]) if name.endswith(".model") else tokens.LibraryEnds(PATHS[name])
    calls = []
    got = tokens.count_long(lambda d: calls.append(len(d)) or ends(d), np.frombuffer(text, np.uint8))
    assert got == int(tokens.library(PATHS[name])([text])[0]) and len(calls) > 20


def test_empty_table(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string, n_tokens int"), WORD).count() == 0


def test_query_whole_table(spark):
    from meshloom.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in QUERIES["op4_overlap_tokens"](spark, d).collect():
        assert r.n_tokens == whole(WORD, texts[r.doc_id]) and r.over_limit == (r.n_tokens > 2048)


def test_memo_forgets_and_stays_right():
    """Calls with more new, known or distinct keys than the table holds."""
    m, rng = Memo(bits=8), np.random.default_rng(0)
    for n, top in [(300, 400)] * 30 + [(120, 130), (220, 260), (3000, 10_000), (0, 2), (250, 10_000)]:
        h = rng.integers(1, top, n).astype(np.uint64)
        assert (m.get(h, lambda i, h=h: (h[i] * 3).astype(np.int32))[:, 0] == h * 3).all()
    known = np.arange(1, 121, dtype=np.uint64)
    m.get(known, lambda i: known[i].astype(np.int32))
    both = np.arange(1, 221, dtype=np.uint64)
    assert (m.get(both, lambda i: both[i].astype(np.int32))[:, 0] == both).all()
