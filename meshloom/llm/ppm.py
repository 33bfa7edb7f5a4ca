"""Language-model scores of whole texts by prediction by partial matching over bytes, with a word-unigram base beside it.

**Text.** A-Z are lower-cased and words joined by one space; a line feed ends the text and, five times, goes before it.
**Training.** All texts of the training part are counted: every byte with the five before it, and every word. Counts of shorter contexts
are sums of those. **Scoring.** A byte is looked for in its longest context that training has. A context with total T and D different bytes gives a byte of
count n the probability n / (T + D) and escapes with the rest, D / (T + D) (method C), to the next shorter one; there, the bytes of the longer context are
excluded. Below order 0 all bytes not yet excluded are equally likely. As counts are fixed while scoring, a byte's code length depends on six bytes only.
So it is worked out once for each gram of six bytes that any text has, in tasks that each hold whole contexts of three bytes and all that is longer; of the shorter
orders, each has all grams (of at most three bytes, so their number is bounded by the alphabet). Grams that make up at least `FLOOR` of all bytes travel to
all executors, at most 1 / FLOOR; the rest is looked up in one join, pre-counted by document. So the floor changes no score.

**Base.** log10((c + 1) / (N + 1 * (V + 1))) for each word and one end. Words that are at least FLOOR of all words travel as well; the rare rest is
looked up in the same join.

Edge cases: null and empty texts score their end; without training texts N = V = 0 and all bytes are equally likely; rows that repeat a
document each count and each get a row, also where one id has several texts; null ids are texts of the training part; counts have no ties to break; an empty table gives an empty result; extra
columns are not read, whatever their names. A very long text is one chunk, with some 60 bytes of arrays for each of its bytes. Grams are exact; words are counted by 64-bit hashes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.arrow_text import U, Memo, Words, split
from meshloom.plans.lineage import cut

ORDER = 5
#: share of all bytes, or words, from which a gram, or word, travels to all executors
FLOOR = 2e-7
#: orders whose grams every task has
SHARED = 3
END = 10
CHUNK = 1 << 18
#: distinct entries of a task after which it hands its counts on
FLUSH = 1 << 20


def stream(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all documents with their padding, places of the bytes to code, and the place of each document's first of those."""
    lens = w.ends - w.starts
    empty = (w.counts == 0).astype(np.int64)
    doc = w.doc()
    # a separator or end after each word, an end in a document without words, padding before each document
    done = np.cumsum(empty) - empty
    before = np.cumsum(lens + 1) - (lens + 1) + ORDER * (doc + 1) + done[doc]
    total = int(lens.sum()) + len(lens) + int(empty.sum()) + ORDER * w.n_docs
    out = np.full(total, 32, np.uint8)
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts] += 1
    np.subtract.at(inside, w.ends, 1)
    src = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    at = np.arange(int(lens.sum())) + np.repeat(before - (np.cumsum(lens) - lens), lens)
    out[at] = w.data[src]
    upto = np.concatenate([[0], np.cumsum(lens + 1)])
    size = upto[w.bounds[1:]] - upto[w.bounds[:-1]] + empty
    last = np.cumsum(size + ORDER)
    out[last - 1] = END
    first = last - size
    pad = (first[:, None] - np.arange(1, ORDER + 1)).ravel()
    out[pad] = END
    code = np.ones(total, bool)
    code[pad] = False
    places = np.flatnonzero(code)
    return out, places, np.cumsum(size) - size


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each byte to code with the ORDER before it, as one number; and where each document's begin."""
    b, places, first = stream(w)
    g = np.zeros(len(places), U)
    for j in range(ORDER, -1, -1):
        g = (g << U(8)) | b[places - j]
    return g, first


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
    return k[at], np.add.reduceat(n, at) if len(at) else n


def count(docs: DataFrame, held_out: str) -> DataFrame:
    """(kind, key, n, m): grams of all rows (kind 0), n times in those whose held_out is false and m times in all; words (kind 1) of the rows whose held_out is false; kind 2 is the number of those rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def flush():
            for kind in (0, 1):
                if held[kind]:
                    k, n = _merge(held[kind])
                    held[kind] = []
                    for i in range(0, len(k), 1 << 18):
                        part, m = k[i : i + (1 << 18)], n[i : i + (1 << 18)]
                        in_train = np.ones(len(part), np.int64) if kind else 1 - (part >> OUT).astype(np.int64)
                        part = part if kind else part & (ONE_OUT - U(1))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(m * in_train), pa.array(m)], names=["kind", "key", "n", "m"])

        docs_seen = 0
        for batch in batches:
            out_of = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            docs_seen += int((~out_of).sum())
            for w in split(batch, "text", lower=True, chunk=CHUNK):
                here = out_of[w.first : w.last]
                g, first = grams(w)
                g |= np.repeat(here, np.diff(np.append(first, len(g)))).astype(U) << OUT
                for kind, x in ((0, g), (1, w.hashes()[~here[w.doc()]])):
                    x.sort()
                    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)
                    held[kind].append((x[at], np.diff(np.append(at, len(x)))))
                    if len(held[kind]) >= 16:
                        held[kind] = [_merge(held[kind])]
                if sum(len(p[0]) for k in held for p in k) > FLUSH:
                    yield from flush()
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([docs_seen], pa.int64()), pa.array([docs_seen], pa.int64())], names=["kind", "key", "n", "m"])

    return docs.select("text", held_out).mapInArrow(run, "kind int, key bigint, n bigint, m bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


#: place of the bit that marks grams of held-out rows while they are counted
OUT = U(8 * (ORDER + 1))
ONE_OUT = U(1) << OUT


class Trie:
    """Kept grams and contexts of each order with the logarithms that scoring adds up."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]):
        """tables[k]: sorted grams of order k (k + 1 bytes) and their counts; a gram's shorter forms must be kept too. totals[k]: for each of their contexts, in order, the count and the number of different bytes after it, kept or not."""
        self.grams, self.found, self.ctx, self.size, self.first, self.down, self.kinds = [], [], [], [], [], [], []
        below = None
        for k, ((g, n), (t, d)) in enumerate(zip(tables, totals, strict=True)):
            n, t, d = n.astype(np.float64), t.astype(np.float64), d.astype(np.float64)
            ctx, start, kinds = np.unique(g >> U(8), return_index=True, return_counts=True)
            kept = np.add.reduceat(n, start) if len(start) else np.zeros(0)
            self.grams.append(g)
            self.ctx.append(ctx)
            self.found.append(np.log10(n))
            self.kinds.append(kinds)
            self.size.append(np.log10(t + d))
            # what is not kept goes to the escape
            self.first.append(np.log10(np.maximum(t - kept + d, 1e-300) / (t + d)))
            if below is None:
                self.down.append((np.zeros(len(ctx)), np.zeros(len(ctx))))
            else:
                # the next shorter context without the bytes kept here: its size, and the escape from it
                bg, bn, bctx, bt, bd, bkept = below
                short = U((1 << (8 * k)) - 1)
                x = np.add.reduceat(bn[np.searchsorted(bg, g & short)], start) if len(start) else np.zeros(0)
                p = np.searchsorted(bctx, ctx & (short >> U(8)))
                size, esc = bt[p] - x + bd[p] - kinds, bt[p] - bkept[p] + bd[p] - kinds
                some = size > 0
                self.down.append((np.log10(np.where(some, size, 1.0)), np.log10(np.where(some, np.maximum(esc, 1e-300) / np.where(some, size, 1.0), 1.0))))
            below = (g, n, ctx, t, d, kept)

    @staticmethod
    def _at(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Place of each x in the sorted keys, or -1."""
        if not len(keys):
            return np.full(len(x), -1)
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[i] == x, i, -1)

    def score(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others."""
        out = np.zeros(len(gram))
        todo = np.arange(len(gram))
        # the context one longer that was escaped from, or -1 if none is known yet
        above = np.full(len(gram), -1)
        for k in range(len(self.grams) - 1, -1, -1):
            g = gram[todo] & U((1 << (8 * (k + 1))) - 1)
            c = self._at(self.ctx[k], g >> U(8))
            hit = self._at(self.grams[k], g)
            up = above[todo]
            came = up >= 0
            size = self.size[k][np.maximum(c, 0)] if len(self.ctx[k]) else np.zeros(len(todo))
            if k + 1 < len(self.grams) and len(self.ctx[k + 1]):
                size = np.where(came, self.down[k + 1][0][np.maximum(up, 0)], size)
                esc_came = self.down[k + 1][1][np.maximum(up, 0)]
            else:
                esc_came = np.zeros(len(todo))
            known = c >= 0
            esc = np.where(came, esc_came, self.first[k][np.maximum(c, 0)] if len(self.ctx[k]) else 0.0)
            value = self.found[k][np.maximum(hit, 0)] if len(self.grams[k]) else np.zeros(len(todo))
            ok = hit >= 0
            out[todo[ok]] += value[ok] - size[ok]
            miss = known & ~ok
            out[todo[miss]] += esc[miss]
            above[todo] = np.where(known, c, -1)
            todo = todo[~ok]
        if len(todo):
            d = int(self.kinds[0][0]) if len(self.kinds[0]) else 0
            out[todo] += -np.log10(max(256 - d, 1))
        return out


def _orders(g: np.ndarray, n: np.ndarray, orders: range, least: float) -> tuple[list, list]:
    """Of each order, the grams with a count of least or more, and the totals of their contexts, from longer grams."""
    tables, totals = [], []
    for k in orders:
        x, c = _merge([(g & U((1 << (8 * (k + 1))) - 1), n)])
        start = np.flatnonzero(np.append(True, x[1:] >> U(8) != x[:-1] >> U(8))) if len(x) else np.zeros(0, int)
        d = np.diff(np.append(start, len(x)))
        keep = c >= least
        some = np.add.reduceat(keep.astype(np.int64), start) > 0 if len(x) else np.zeros(0, bool)
        tables.append((x[keep], c[keep]))
        totals.append(((np.add.reduceat(c, start) if len(x) else c)[some], d[some]))
    return tables, totals


def values(counts: DataFrame, floor: float = 0.0) -> DataFrame:
    """(key, m, value): log10 probability of the last byte of each gram in (key, n, m). A floor above 0 leaves out of the model what is less than that share of it."""
    spark = counts.sparkSession
    low = (1 << (8 * SHARED)) - 1
    short = counts.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(low)).alias("g")).agg(F.sum("n").alias("n")).toArrow()
    g, n = short.column(0).to_numpy().astype(U), short.column(1).to_numpy().astype(np.int64)
    least = max(1.0, floor * int(n.sum()))
    sent = spark.sparkContext.broadcast(_orders(g, n, range(SHARED), least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(i).to_numpy() for i in range(3)) for b in batches]
        if not parts:
            return
        g, n, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        g = g.astype(U)
        tables, totals = _orders(g[n > 0], n[n > 0], range(SHARED, ORDER + 1), least)
        trie = Trie(sent.value[0] + tables, sent.value[1] + totals)
        for i in range(0, len(g), CHUNK):
            x = g[i : i + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(m[i : i + CHUNK]), pa.array(trie.score(x))], names=["key", "m", "value"])

    # contexts of three bytes are whole in a task, and so are the longer ones that end in them
    dealt = counts.select("key", "n", "m").repartition(F.shiftright("key", 8).bitwiseAND(F.lit(low)))
    return dealt.mapInArrow(run, "key bigint, m bigint, value double")


def score(docs: DataFrame, held_out: str = "held_out", floor: float = 0.0, travel: float = FLOOR) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs, which has doc_id, text and held_out. floor is that of values; travel changes no result."""
    spark = docs.sparkSession
    # one place for each row, so that repeated rows stay apart
    rows = docs.select("doc_id", "text", F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    counts = cut(count(rows, "held_out"))
    words = counts.where("kind = 1")
    n_docs = counts.where("kind = 2").agg(F.sum("n")).head()[0] or 0
    v, n = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    n, v = n + n_docs, v + (n_docs > 0)
    coded_grams = counts.where("kind = 0").select("key", "n", "m")
    n_bytes = coded_grams.agg(F.sum("m")).head()[0] or 0
    valued = cut(values(coded_grams, floor))

    def often(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
        t = df.select("key", value).toArrow()
        keys = t.column(0).to_numpy().astype(np.int64).view(U)
        order = np.argsort(keys)
        return keys[order], t.column(1).to_numpy()[order]

    gram_keys, gram_values = often(valued.where(F.col("m") >= max(1.0, travel * n_bytes)).withColumn("value", F.col("value").cast("float")), "value")
    sent = spark.sparkContext.broadcast((gram_keys, gram_values, *often(words.where(F.col("n") >= max(1.0, travel * n)), "n")))
    end = n_docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_values, keys, ns = sent.value
        coded = Memo(21, 1, np.float32)
        table = Memo(max(8, int(len(keys) * 2).bit_length()), 1, np.int64)
        if len(keys):
            table.put(keys, ns[:, None])

        def look(g: np.ndarray) -> np.ndarray:
            """Values of grams, nan for those that the join has."""
            i = Trie._at(gram_keys, g)
            return np.where(i >= 0, gram_values[np.maximum(i, 0)] if len(gram_keys) else np.nan, np.nan).astype(np.float32)

        def rest(kind: int, x: np.ndarray, doc: np.ndarray, where: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rare keys, counted by document."""
            o = np.lexsort((x, doc))
            x, doc = x[o], doc[o]
            at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (doc[1:] != doc[:-1]))) if len(x) else np.zeros(0, int)
            m = len(at)
            if m:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[doc[at]]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.array(np.full(m, kind, np.int32)), pa.array(x[at].view(np.int64)), pa.array(np.diff(np.append(at, len(x)))), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())],
                    names=NAMES,
                )

        for batch in batches:
            rid, ids, out_of = batch.column(0), batch.column(1), batch.column(3)
            for w in split(batch, "text", lower=True, chunk=CHUNK):
                g, first = grams(w)
                value = coded.get(g + U(1), lambda i, g=g: look(g[i]))[:, 0].astype(np.float64)
                rare = np.isnan(value)
                total = np.add.reduceat(np.where(rare, 0.0, value), first)
                h, doc = w.hashes(), w.doc()
                slot = table.slots(h)
                hit = slot >= 0
                base = np.bincount(doc[hit], np.log10(table.values[slot[hit], 0] + 1.0), w.n_docs)
                known = np.bincount(doc[hit], minlength=w.n_docs)
                span = slice(w.first, w.last)
                where = rid.to_numpy(zero_copy_only=False)[span]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where), ids.slice(w.first, w.n_docs), out_of.slice(w.first, w.n_docs), pa.nulls(w.n_docs, pa.int32()), pa.nulls(w.n_docs, pa.int64()), pa.array(w.counts.astype(np.int64) + 1), pa.array(known + (1 if end else 0)), pa.array(base + np.log10(end + 1.0)), pa.array(total)],
                    names=NAMES,
                )
                yield from rest(1, h[~hit], doc[~hit], where)
                yield from rest(0, g[rare], np.searchsorted(first, np.flatnonzero(rare), "right") - 1, where)

    placed = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text", "held_out")
    got = placed.mapInArrow(run, "rid bigint, doc_id bigint, held_out boolean, kind int, key bigint, n bigint, known bigint, base double, score double")
    rare_words = words.where(F.col("n") < max(1.0, travel * n)).select(F.col("kind").alias("k"), F.col("key").alias("x"), F.log10(F.col("n") + 1.0).alias("value"))
    rare_grams = valued.where(F.col("m") < max(1.0, travel * n_bytes)).select(F.lit(0).alias("k"), F.col("key").alias("x"), "value")
    # rows of documents meet nothing; they are spread over the join by their place
    placed_at = got.withColumn("at", F.coalesce("key", F.xxhash64("rid"))).withColumn("kind", F.coalesce("kind", F.lit(2)))
    joined = placed_at.join(rare_words.unionByName(rare_grams), (F.col("at") == F.col("x")) & (F.col("kind") == F.col("k")), "left")
    of_doc, of_word, of_gram = (F.col("kind") == i for i in (2, 1, 0))
    hit = of_word & F.col("value").isNotNull()
    weighed = F.col("n") * F.col("value")
    sums = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum(F.when(of_doc, F.col("n"))).alias("n_tokens"),
        (F.sum(F.when(of_doc, F.col("known"))) + F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))).alias("n_known"),
        (F.sum(F.when(of_doc, F.col("base"))) + F.coalesce(F.sum(F.when(hit, weighed)), F.lit(0.0))).alias("base"),
        (F.sum("score") + F.coalesce(F.sum(F.when(of_gram, weighed)), F.lit(0.0))).alias("score"),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score")


NAMES = ["rid", "doc_id", "held_out", "kind", "key", "n", "known", "base", "score"]


def adaptive_score(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text by a trie that starts empty and learns as it reads; for single documents."""
    data = b"\n" * order + b" ".join(text.lower().split()) + b"\n"
    seen: dict[bytes, dict[int, int]] = {}
    total = 0.0
    for i in range(order, len(data)):
        excluded: set[int] = set()
        p = 1.0
        for k in range(order, -1, -1):
            here = seen.get(data[i - k : i])
            if here is None:
                continue
            left = {s: n for s, n in here.items() if s not in excluded}
            size = sum(left.values()) + len(left)
            if data[i] in left:
                p *= left[data[i]] / size
                break
            p *= len(left) / size if left else 1.0
            excluded |= here.keys()
        else:
            p *= 1 / (256 - len(excluded))
        total += np.log10(p)
        for k in range(order + 1):
            here = seen.setdefault(data[i - k : i], {})
            here[data[i]] = here.get(data[i], 0) + 1
    return float(total)
