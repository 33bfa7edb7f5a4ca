"""Language of words and texts by a linear-chain conditional random field.

**Features** of a word (lower-cased in ASCII): its first and last one to three bytes, its byte trigrams with its edges, and the whole word as lexicon
entry, all hashed to weights for each language. A word without a letter has none. **Chain.** Neighbouring words have learned transition weights, so that in
code-switched text a language holds for a run of words. Forward-backward gives each word's posterior; all texts of a chunk step through their words together.
**Training.** From a bounded sample of labelled passages: texts are passages of at most `PASSAGE` characters, and each language gives those of
least hash, `SAMPLE` in all, an equal share of each (one at least), so that every language that labels a letter is learned, however rare it is and however long its texts are. First
weights of single words are learned, then the chain by gradients of the conditional likelihood, on passages and on code-switched texts made of runs of words of several of them. Each
word carries its passage's label, so the transitions see languages both hold and switch. **Text.** The language with the largest sum of posteriors over words with a letter; the score
is its share. Nothing but the text enters a prediction.

Edge cases: null and empty texts and those without a letter are `und` with score 0; without any labelled letter all are; one language is predicted everywhere
if only one is labelled; ties go to the first in alphabetical order; rows that repeat a document each get a row; null ids are ids like others; an empty table gives an empty
result; extra columns are not read, whatever their names. A very long text is one chunk: its chain is stepped through in `PIECE` words at a time for all pieces
together, which is exact, as the pieces' products of transitions carry the messages between them.
"""

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshloom.llm.arrow_text import BASE, BYTES, U, Memo, Words, mix, split
from meshloom.llm.joins import if_small
from meshloom.plans.lineage import cut

#: passages to learn from, and their most characters
SAMPLE, PASSAGE = 3000, 4000
#: words of a switched text's runs, and its runs; the part of the passages that are switched
RUN, RUNS, SWITCHED = (4, 30), 8, 0.3
#: words of a text that are stepped through one after the other
PIECE = 1024
#: hashed features
BUCKETS = 1 << 18
CHUNK = 4 << 20
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


@cache
def _letter_points() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _letters(w: Words) -> np.ndarray:
    """Whether each word has a letter."""
    mark = ASCII_LETTER[w.data]
    lead = np.flatnonzero(w.data >= 0xC2)
    if len(lead):
        at = np.concatenate([w.data, np.zeros(3, np.uint8)]).astype(np.int64)
        a, b, c, d = (at[lead + j] for j in range(4))
        point = np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63))
        mark[lead] = _letter_points()[np.minimum(point, sys.maxunicode)]
    total = np.concatenate([[0], np.cumsum(mark)])
    return total[w.ends] > total[w.starts]


def features(w: Words, which: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the chosen words, flat, and the word (place in `which`) of each."""
    s, e = w.starts[which], w.ends[which]
    n = e - s
    out, owner = [h[which]], [np.arange(len(which))]
    b = BYTES
    for k in (1, 2, 3):
        ok = np.flatnonzero(n >= k)
        for tag, begin in ((k, s[ok]), (k + 3, e[ok] - k)):
            x = np.full(len(ok), tag, U)
            for j in range(k):
                x = mix(x * BASE + b[w.data[begin + j]])
            out.append(x)
            owner.append(ok)
    # trigrams with an edge byte before and after: places s - 1 to e - 2
    who = np.repeat(np.arange(len(which)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + s[who] - 1
    left = np.where(at < s[who], U(7), b[w.data[np.maximum(at, 0)]])
    right = np.where(at + 2 >= e[who], U(11), b[w.data[np.minimum(at + 2, len(w.data) - 1)]])
    out.append(mix((left * BASE + b[w.data[at + 1]]) * BASE + right))
    owner.append(who)
    return (np.concatenate(out) & U(BUCKETS - 1)).astype(np.int64), np.concatenate(owner)


def emissions(w: Words, which: np.ndarray, h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    f, owner = features(w, which, h)
    return np.stack([np.bincount(owner, weights[f, k], len(which)) for k in range(weights.shape[1])], axis=1)


def _pieces(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts' pieces of at most `PIECE` words, and the text of each piece."""
    n = np.diff(bounds)
    k = np.maximum(1, -(-n // PIECE))
    text = np.repeat(np.arange(len(n)), k)
    ahead = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    return np.append(bounds[:-1][text] + ahead * PIECE, bounds[-1]), text


def _messages(p: np.ndarray, bounds: np.ndarray, text: np.ndarray, s: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What goes into each piece: forward weights before its first word's, and backward weights at its last word."""
    k = len(s)
    into, back = np.tile(s, (len(text), 1)), np.ones((len(text), k))
    more = np.flatnonzero(np.bincount(text, minlength=1)[text] > 1)
    if not len(more):
        return into, back
    # each piece's product of transitions, for all pieces of long texts together
    first, size = bounds[:-1][more], np.diff(bounds)[more]
    t_of = np.zeros((len(more), k, k))
    t_of[:, range(k), range(k)] = p[first]
    for t in range(1, int(size.max())):
        i = np.flatnonzero(size > t)
        x = (t_of[i] @ m) * p[first[i] + t][:, None, :]
        t_of[i] = x / x.sum(axis=(1, 2), keepdims=True)
    for j in range(len(more) - 1):
        if text[more[j + 1]] == text[more[j]]:
            x = into[more[j]] @ t_of[j] @ m
            into[more[j + 1]] = x / x.sum()
    for j in range(len(more) - 1, 0, -1):
        if text[more[j - 1]] == text[more[j]]:
            x = m @ (t_of[j] @ back[more[j]])
            back[more[j - 1]] = x / x.sum()
    return into, back


def posteriors(e: np.ndarray, bounds: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Forward-backward over all texts at once: e has a row of log scores for each word, bounds the texts' first words.

    Returns the words' posteriors and, with pairs, the sum of the posteriors of neighbouring labels.
    """
    p = np.exp(e - e.max(axis=1, keepdims=True)) if len(e) else e
    m, s = np.exp(move), np.exp(start)
    parts, text = _pieces(bounds)
    into, back = _messages(p, parts, text, s, m)
    n = np.diff(parts)
    order = np.argsort(-n, kind="stable")
    live = int((n > 0).sum())
    first, size = parts[:-1][order], n[order]
    into, back = into[order], back[order]
    a, b = np.zeros_like(p), np.zeros_like(p)
    longest = int(size[0]) if live else 0
    # pieces are sorted by length: those that have a word t come first
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    cur = None
    for t in range(longest):
        i = first[: active[t]] + t
        x = p[i] * (into[: active[t]] if t == 0 else cur[: active[t]] @ m)
        cur = x / x.sum(axis=1, keepdims=True)
        a[i] = cur
    cur = np.ones((0, p.shape[1]))
    for t in range(longest - 1, -1, -1):
        i = first[: active[t]] + t
        if len(cur) < len(i):  # pieces whose last word this is
            cur = np.concatenate([cur, back[len(cur) : len(i)]])
        b[i] = cur
        x = (p[i] * cur) @ m.T
        cur = x / x.sum(axis=1, keepdims=True)
    g = a * b
    g /= np.maximum(g.sum(axis=1, keepdims=True), 1e-300)
    if not pairs:
        return g
    inner = np.ones(len(e), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    j = np.flatnonzero(inner)
    left, right = a[j - 1], p[j] * b[j]
    z = ((left @ m) * right).sum(axis=1)
    return g, (left / z[:, None]).T @ right * m


def switched(words: list[list[bytes]], labels: np.ndarray, rng: np.random.Generator) -> list[tuple[bytes, np.ndarray]]:
    """Texts with a label for each word: the passages, and some that are made of runs of words of several."""
    out = [(b" ".join(w), np.full(len(w), y)) for w, y in zip(words, labels, strict=True)]
    some = [i for i, w in enumerate(words) if w]
    for _ in range(int(len(some) * SWITCHED)):
        text, ys = [], []
        for i in rng.choice(some, RUNS):
            n = int(rng.integers(*RUN))
            at = int(rng.integers(0, max(1, len(words[i]) - n + 1)))
            run = words[i][at : at + n]
            text += run
            ys.append(np.full(len(run), labels[i]))
        out.append((b" ".join(text), np.concatenate(ys)))
    return out


class Model:
    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs, self.weights = langs, np.zeros((BUCKETS, k))
        self.start, self.move = np.zeros(k), np.zeros((k, k))

    def fit(self, texts: list[str], langs: list[str], rounds: int = 3, rate: float = 0.3, seed: int = 0) -> "Model":
        """AdaGrad in batches of texts; the first round treats words singly."""
        k = len(self.langs)
        number = {x: i for i, x in enumerate(self.langs)}
        rng = np.random.default_rng(seed)
        whole = switched([t.encode().split() for t in texts], np.array([number[x] for x in langs]), rng)
        grads = np.full((BUCKETS, k), 1e-2)
        g_start, g_move = np.full(k, 1e-2), np.full((k, k), 1e-2)
        order = rng.permutation(len(whole))
        for r in range(rounds):
            for i in range(0, len(order), 50):
                own = [whole[j] for j in order[i : i + 50]]
                batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in own], pa.binary()).cast(pa.string())], names=["text"])
                for w in split(batch, "text", lower=True, chunk=1 << 40):
                    y = np.concatenate([y for _, y in own])
                    if not len(y):
                        continue
                    use = _letters(w)
                    h, inv, n = np.unique(w.hashes(), return_inverse=True, return_counts=True)
                    one = np.zeros(len(h), np.int64)
                    one[inv] = np.arange(len(inv))
                    f, owner = features(w, one, w.hashes())
                    scores = np.stack([np.bincount(owner, self.weights[f, c], len(h)) for c in range(k)], axis=1)
                    e = scores[inv] * use[:, None]
                    begins = w.bounds[:-1][w.counts > 0]
                    if r == 0:
                        g = np.exp(e - e.max(axis=1, keepdims=True))
                        g /= g.sum(axis=1, keepdims=True)
                    else:
                        g, pair = posteriors(e, w.bounds, self.start, self.move, pairs=True)
                        inner = np.ones(len(y), bool)
                        inner[begins] = False
                        j = np.flatnonzero(inner)
                        want = np.bincount(y[j - 1] * k + y[j], minlength=k * k).reshape(k, k)
                        step = (want - pair) / len(own)
                        g_move += step * step
                        self.move += rate * step / np.sqrt(g_move) - 1e-3 * self.move
                        step = (np.bincount(y[begins], minlength=k) - g[begins].sum(axis=0)) / len(own)
                        g_start += step * step
                        self.start += rate * step / np.sqrt(g_start)
                    d = -g * use[:, None]
                    d[np.arange(len(y)), y] += use
                    by_word = np.stack([np.bincount(inv, d[:, c], len(h)) for c in range(k)], axis=1) / len(own)
                    rows, at = np.unique(f, return_inverse=True)
                    step = np.stack([np.bincount(at, by_word[owner, c], len(rows)) for c in range(k)], axis=1)
                    grads[rows] += step * step
                    self.weights[rows] += rate * step / np.sqrt(grads[rows])
        self.weights = self.weights.astype(np.float32)
        return self

    def words(self, w: Words, memo: Memo, use: np.ndarray) -> np.ndarray:
        """Posteriors of all words of a chunk; use says which have a letter."""
        h = w.hashes()
        e = memo.get(h, lambda i: emissions(w, i, h, self.weights).astype(np.float32)).astype(np.float64) if len(h) else np.zeros((0, len(self.langs)))
        return posteriors(e * use[:, None], w.bounds, self.start, self.move)


def passages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, passage): at most `sample` of all passages with a letter of labelled texts, but one of each language at least; each language gives those of least hash."""
    size = F.ceil(F.length("text") / F.lit(PASSAGE)).cast("int")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("doc_id", "text", "lang", size.alias("n"))
    known = cut(labelled.groupBy("lang").agg(F.sum("n").alias("all")))
    quota = max(1, sample // max(1, known.count()))
    # a cut through the hashes leaves a few times the quota; texts are only cut at places that it leaves
    limit = F.least(F.lit(1.0), F.lit(4.0 * quota) / F.col("all")) * F.lit(float(1 << 40))
    draw = lambda i: F.pmod(F.xxhash64("doc_id", i), F.lit(1 << 40))

    def drawn(rows: DataFrame, few) -> DataFrame:
        at = F.filter(F.sequence(F.lit(0), F.col("n") - 1), few)
        one = rows.select("lang", "doc_id", "text", F.explode(at).alias("i")).select("lang", "doc_id", "i", draw(F.col("i")).alias("o"), F.expr(f"substring(text, i * {PASSAGE} + 1, {PASSAGE})").alias("passage"))
        return one.where(F.col("passage").rlike("\\p{L}"))

    near = drawn(labelled.join(if_small(known.select("lang", limit.alias("limit"))), "lang"), lambda i: draw(i) < F.col("limit"))
    first = Window.partitionBy("lang").orderBy("o", "doc_id", "i", "passage")
    got = cut(near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= quota).select("lang", "passage"))
    missing = cut(known.select("lang").join(got.select("lang").distinct(), "lang", "left_anti"))
    if not missing.limit(1).count():
        return got
    # all of the passages near the cut had no letter
    rest = drawn(labelled.join(if_small(missing), "lang"), lambda i: F.lit(True))
    return got.unionByName(rest.groupBy("lang").agg(F.min_by("passage", F.struct("o", "doc_id", "i", "passage")).alias("passage")))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """From docs (doc_id, text, lang); None if none is labelled."""
    got = sorted((r["lang"], r["passage"]) for r in passages(docs, sample).collect())
    if not got:
        return None
    return Model(sorted({lang for lang, _ in got})).fit([t for _, t in got], [lang for lang, _ in got])


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score, a row for each row of docs; texts stay where they are read."""
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        memo = Memo(20, len(model.langs), np.float32)
        names = [*keep, "lang_pred", "score"]
        langs = np.array([*model.langs, "und"], object)
        for batch in batches:
            for w in split(batch, "text", lower=True, chunk=CHUNK):
                use = _letters(w)
                g = model.words(w, memo, use) * use[:, None]
                doc = w.doc()
                total = np.stack([np.bincount(doc, g[:, c], w.n_docs) for c in range(len(model.langs))], axis=1)
                size = total.sum(axis=1)
                best = np.where(size > 0, total.argmax(axis=1), len(model.langs))
                share = np.clip(total.max(axis=1) / np.maximum(size, 1e-300), 0, 1)
                cols = [batch.column(i).slice(w.first, w.n_docs) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs[best], pa.string()), pa.array(np.where(size > 0, share, 0.0))], names=names)

    return kept.mapInArrow(run, schema)
