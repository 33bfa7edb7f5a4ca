"""Removal of word passages that an earlier document has, by compaction of a sampled de Bruijn graph.

A window is 50 consecutive words; a word goes if a window over it also starts in a document of smaller id.

**Edges.** Each window contributes its k-mer (25 words) of least hash. Equal windows choose equal k-mers at equal places, so windows can
only be equal where the chosen k-mer is, and one k-mer in about 13 is enough. k-mers that only one document has end here.
**Compaction.** The remaining k-mers are edges of a graph in which a document is a walk. If every occurrence of one edge is followed by the same edge at
the same distance, and that one always preceded by it, nothing branches between them. Such edges are compacted by pointer doubling, in joins, to paths. All of a path
lies in the same documents. **Verification by coordinates.** At the coordinates of each occurrence, the words are read from the text: of a path of 50 words or more all of its span at
once, and each window that sticks out of its path by itself. They are compared as 128-bit digests of the words' bytes; what also lies in a document of smaller id
goes. So graph and hashes only propose, and no word goes for a colliding hash. Windows of equal words are proposed alike, as that depends on nothing but the window's own words and the path.

Documents of equal word sequences are one document from the start. Edge cases: null, empty and short texts lose nothing (unless an equal text of 50 words or more came
before); rows that repeat a document with its id get equal results; if one id has several texts, each is a document of that id, and none of them is earlier than another; rows of null
id neither lose words nor make others lose any; of documents with equal ids (ties) each keeps its words; an empty table gives an empty result; extra columns are not
read, whatever their names. A very long text is handled whole, in one task, with some 100 bytes of arrays a word; k-mers are sampled by 64-bit hashes.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.arrow_text import U, Words, split, windows
from meshloom.llm.joins import if_small, lookup
from meshloom.plans.lineage import cut

WINDOW, KMER = 50, 25
SPREAD = WINDOW - KMER + 1
#: bytes of repeated digests up to which they are broadcast
TRAVEL = 2 << 20
TOP = U(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n consecutive entries."""
    if len(x) < n:
        return x[:0]
    done = 1
    while done * 2 <= n:
        x = f(x[: len(x) - done], x[done:])
        done *= 2
    return f(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def minimizers(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k-mers, least hash of each window's k-mers (0 where no window of one document starts), and places and documents of the chosen k-mers."""
    n = len(h)
    k = windows(h, KMER)
    k = np.where((k == 0) | (k == TOP), U(1), k)
    least = np.zeros(n, U)
    got = _sliding(k, SPREAD, np.minimum)
    room = np.maximum(w.counts - WINDOW + 1, 0)
    valid = np.repeat(w.bounds[:-1], room) + (np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room))
    least[valid] = got[valid]
    # a k-mer is chosen if it equals the largest of the minima of the windows around it
    padded = np.concatenate([np.zeros(SPREAD - 1, U), least])
    top = _sliding(padded, SPREAD, np.maximum)[: len(k)]
    at = np.flatnonzero((k == top) & (top > 0))
    return k, least, at, np.searchsorted(w.bounds, at, "right") - 1


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): the tag tells texts of one id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")


def survey(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, n_words, name, sha, at, kmer, nxt, gap): a row for each row; arrays in order. nxt is the next chosen k-mer if it touches this one, else 0; sha is that of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in split(batch, "text"):
                h = w.hashes()
                k, _, at, doc = minimizers(w, h)
                chosen = k[at] if len(at) else np.zeros(0, U)
                nxt, gap = np.zeros(len(at), U), np.zeros(len(at), np.int32)
                if len(at) > 1:
                    step = at[1:] - at[:-1]
                    touch = (doc[1:] == doc[:-1]) & (step <= KMER)
                    nxt[:-1][touch], gap[:-1][touch] = chosen[1:][touch], step[touch]
                off = pa.array(np.searchsorted(doc, np.arange(w.n_docs + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in ((at - w.bounds[doc]).astype(np.int32), chosen.view(np.int64), nxt.view(np.int64), gap)]
                names, shas = [], []
                for d in range(w.n_docs):
                    raw = w.data[w.offsets[d] : w.offsets[d + 1]].tobytes()
                    sha = hashlib.sha256(b" ".join(raw.split()))
                    names.append(sha.digest()[:16])
                    shas.append(sha.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n_docs), batch.column(1).slice(w.first, w.n_docs), pa.array(w.counts.astype(np.int64)), pa.array(names, pa.binary()), pa.array(shas), *lists], names=["doc_id", "tag", "n_words", "name", "sha", "at", "kmer", "nxt", "gap"])

    return tagged(docs).mapInArrow(run, "doc_id bigint, tag bigint, n_words bigint, name binary, sha string, at array<int>, kmer array<bigint>, nxt array<bigint>, gap array<int>")


def paths(occurrences: DataFrame) -> DataFrame:
    """(kmer, first_doc, off, reach): for each k-mer of occurrences(doc_id, kmer, nxt, gap) the smallest document, its distance from the start of its path, and the path's length from start to start."""
    follow = F.struct("nxt", "gap")
    after = occurrences.groupBy("kmer").agg(F.min("doc_id").alias("first_doc"), F.min(follow).alias("a"), F.max(follow).alias("b"), F.count("*").alias("n"))
    after = cut(after)
    # each occurrence but the first of a run is the successor of one: if all occurrences of a successor are counted by one predecessor, nothing else precedes it
    out = after.where("a = b AND a.nxt <> 0").select(F.col("kmer").alias("p"), F.col("a.nxt").alias("kmer"), F.col("a.gap").alias("gap"), F.col("n").alias("m"))
    link = out.join(after.select("kmer", "n"), "kmer").where("m = n AND p <> kmer")
    # of two predecessors with equal counts neither would have all, as the sum would exceed n
    at = cut(after.select("kmer").join(link.select("kmer", "p", "gap"), "kmer", "left").select("kmer", F.coalesce("p", "kmer").alias("to"), F.coalesce("gap", F.lit(0)).cast("bigint").alias("off")))
    while True:
        next_step = at.select(F.col("kmer").alias("to"), F.col("to").alias("to2"), F.col("off").alias("off2"))
        at2 = cut(at.join(next_step, "to").select("kmer", F.col("to2").alias("to"), (F.col("off") + F.col("off2")).alias("off"), (F.col("to2") != F.col("to")).alias("moved")))
        moved = at2.where("moved").limit(1).count()
        at = at2.drop("moved")
        if not moved:
            break
    reach = at.groupBy("to").agg(F.max("off").alias("reach"))
    return at.join(reach, "to").join(after.select("kmer", "first_doc"), "kmer").select("kmer", "first_doc", "off", "reach")


def _narrow(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, tag, text), once each, of the given distinct (doc_id, tag), before any shuffle if they are few."""
    return tagged(docs).join(if_small(keys), ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])


def _digests(text: bytes, starts: np.ndarray, stops: np.ndarray) -> bytes:
    """128 bits of the words from each start up to each stop, joined by a space, one after the other."""
    w = text.split()
    joined = b" ".join(w)
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in w])])
    return b"".join(hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(at[starts].tolist(), (at[stops] - 1).tolist(), strict=True))


def proposals(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, tag, start, stop, d1, d2), a row for each text, with arrays of places and of the two halves of their words' digests, of passages that may be repeated: spans of paths in marks(doc_id, tag, marks array of (at, start, stop)) with 50 words or more, and windows whose k-mer is in marks and that stick out of its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            marked = batch.column(3)
            for w in split(batch, "text"):
                h = w.hashes()
                k, least, at, _ = minimizers(w, h)
                mine = marked.slice(w.first, w.n_docs)
                v = mine.flatten()
                sizes = np.array([len(x) for x in mine], np.int64) if mine.null_count else np.diff(mine.offsets.to_numpy())
                base = w.bounds[np.repeat(np.arange(w.n_docs), sizes)]
                place, start, stop = (v.field(i).to_numpy() + base for i in range(3))
                order = np.argsort(place, kind="stable")
                place, start, stop = place[order], start[order], stop[order]
                long = stop - start >= WINDOW
                found = [np.unique(np.stack([start[long], stop[long]]), axis=1)]
                p = np.flatnonzero(least)
                if len(p) and len(place):
                    # the leftmost chosen k-mer of the window that has its least hash
                    i = np.searchsorted(at, p)
                    while len(bad := np.flatnonzero(k[at[i]] != least[p])):
                        i[bad] += 1
                    j = np.minimum(np.searchsorted(place, at[i]), len(place) - 1)
                    out = p[(place[j] == at[i]) & ((p < start[j]) | (p + WINDOW > stop[j]))]
                    found.append(np.stack([out, out + WINDOW]))
                begin, end = np.concatenate(found, axis=1)
                doc = np.searchsorted(w.bounds, begin, "right") - 1
                order = np.argsort(doc, kind="stable")
                begin, end, doc = begin[order], end[order], doc[order]
                cuts = np.searchsorted(doc, np.arange(w.n_docs + 1))
                digests = bytearray()
                for d in np.unique(doc):
                    own = slice(cuts[d], cuts[d + 1])
                    digests += _digests(w.data[w.offsets[d] : w.offsets[d + 1]].tobytes(), begin[own] - w.bounds[d], end[own] - w.bounds[d])
                halves = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
                lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in ((begin - w.bounds[doc]).astype(np.int32), (end - w.bounds[doc]).astype(np.int32), halves[:, 0].copy(), halves[:, 1].copy())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[w.first : w.last]), pa.array(tags[w.first : w.last]), *lists], names=["doc_id", "tag", "start", "stop", "d1", "d2"])

    return texts.join(marks, ["doc_id", "tag"]).select("doc_id", "tag", "text", "marks").mapInArrow(run, "doc_id bigint, tag bigint, start array<int>, stop array<int>, d1 array<bigint>, d2 array<bigint>")


def removed_spans(docs: DataFrame, surveyed: DataFrame) -> DataFrame:
    """(doc_id, tag, start, stop) of words that go, possibly overlapping, for documents whose word sequence is the first of its kind."""
    occ = surveyed.select("doc_id", "tag", F.explode(F.arrays_zip("at", "kmer", "nxt", "gap")).alias("o")).select("doc_id", "tag", "o.*")
    shared = cut(occ.groupBy("kmer").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("kmer"))
    here = cut(occ.join(if_small(shared), "kmer"))
    path = cut(paths(here))
    placed = lookup(here.select("doc_id", "tag", "at", "kmer"), path, ["kmer"], ["doc_id", "at"]).withColumn("start", (F.col("at") - F.col("off")).cast("int")).withColumn("stop", (F.col("start") + F.col("reach") + KMER).cast("int"))
    marks = cut(placed.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "start", "stop")).alias("marks")))
    texts = _narrow(docs, marks.select("doc_id", "tag"))
    found = cut(proposals(texts, marks)).select("doc_id", "tag", F.explode(F.arrays_zip("start", "stop", "d1", "d2")).alias("p")).select("doc_id", "tag", "p.*")
    first = found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("_n")).where("first <> last").drop("last")
    first = cut(first)
    again = lookup(found, first.drop("_n"), ["d1", "d2"], ["doc_id", "start"], counts=first.select("d1", "d2", "_n"), most=TRAVEL)
    return again.where("doc_id > first").select("doc_id", "tag", "start", "stop")


def _cover(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What stays of the words, joined by a space, and how many go."""
    w = text.split()
    gone = np.zeros(len(w) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return b" ".join(x for x, k in zip(w, keep, strict=True) if k), int(len(w) - keep.sum())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for each row of docs; kept_text is null for documents that lose nothing."""
    surveyed = cut(survey(docs))
    key = F.struct("doc_id", "tag")
    named = surveyed.where("doc_id IS NOT NULL").groupBy("name").agg(F.min(key).alias("f"), F.max(key).alias("l")).where("f <> l").select("name", F.col("f.doc_id").alias("first"), F.col("f.tag").alias("first_tag"))
    # rows of word sequences that no other text has are their own first
    joined = lookup(surveyed, cut(named), ["name"], ["doc_id", "tag"], "left")
    every = joined.withColumn("first", F.coalesce("first", "doc_id")).withColumn("first_tag", F.coalesce("first_tag", "tag"))
    reps = every.where("doc_id = first AND tag = first_tag").select("doc_id", "tag", "at", "kmer", "nxt", "gap").dropDuplicates(["doc_id", "tag"])
    spans = removed_spans(docs, cut(reps))
    by_doc = cut(spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_cover((t or "").encode(), [(s["start"], s["stop"]) for s in m]) for t, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for _, n in out], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t, _ in out], pa.string()), pa.array([t.decode("utf-8", "replace") for t, _ in out], pa.string())], names=["first", "first_tag", "gone", "kept", "kept_text"])

    touched = _narrow(docs, by_doc.select("doc_id", "tag")).join(by_doc, ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans").mapInArrow(run, "first bigint, first_tag bigint, gone bigint, kept string, kept_text string")
    rows = every.select("doc_id", "tag", "n_words", "sha", "first", "first_tag")
    # only rows that are a first text, or equal one with its id, meet the cut texts
    own = rows.where("first = doc_id").join(touched, ["first", "first_tag"], "left")
    met = own.unionByName(rows.where("first <> doc_id OR doc_id IS NULL"), allowMissingColumns=True)
    whole = F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= WINDOW), F.lit(False))
    none = hashlib.sha256(b"").hexdigest()
    pick = lambda all_gone, some, else_: F.when(whole, all_gone).otherwise(F.coalesce(some, else_))
    return met.select("doc_id", "n_words", pick(F.col("n_words"), F.col("gone"), F.lit(0).cast("bigint")).alias("n_removed"), pick(F.lit(none), F.col("kept"), F.col("sha")).alias("kept_sha256"), pick(F.lit(""), F.col("kept_text"), F.lit(None)).alias("kept_text"))
