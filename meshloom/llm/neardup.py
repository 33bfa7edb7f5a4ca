"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find.

**Signature.** Each element of a document's set (distinct shingles of five lower-cased words) walks through its own random permutation of the 240 slots: its
j-th step offers the value j + r, with r in [0, 1), to its j-th slot, and a slot keeps the least offer. As each element offers one value to each
slot, and in different order, the slots are less correlated than those of independent hashes. Once all slots of a document hold values below j + 1, later steps
cannot change them, and its walk stops. All elements of many documents step together in numpy.

**Candidates.** Documents of equal sets are one class from here on. 48 bands of 5 slots: a pair of Jaccard similarity 0.75 shares none with probability 2e-6, at 0.8
with 5e-9. Within a bucket no pairs are listed: each class meets the smallest of the bucket and of its salted part. What is linked that way forms
components. Only then do classes of different components that share a bucket meet, as they may be linked through other members: in blocks, by their signatures first,
and those near the threshold then ask the other component's full sets, again in blocks.
**Verification.** Pairs whose sizes rule out the threshold, or whose signatures agree in less than half of the slots (nine standard deviations below 0.75), go; for the
rest the full sets are intersected. **Grouping.** Partitions first reduce links to forests by union-find. While more than `ONE_TASK` links are left, each node hooks on to its smallest
neighbour, the trees of hooks are flattened by pointer doubling and links are redrawn between their roots, of which there are at most half as many as nodes; the rest is one task's union-find.

Edge cases: null and blank texts have the empty set and are linked with nothing; texts of fewer than five words have their whole sequence as one
shingle; rows that repeat a document get its result each; if one id comes with several texts, each is a document of its own with that id; rows of null id are linked with
nothing and kept, with a null component; of documents with equal sets (ties) the smallest id names the group; an empty table gives an empty result; extra columns are
not read, whatever their names. A very long text is handled whole, in one task, with some 100 bytes of arrays a word. Shingles are held as 64-bit hashes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.arrow_text import BASE, U, Words, mix, split, window_starts, windows
from meshloom.llm.joins import if_small, lookup
from meshloom.llm.text import fresh
from meshloom.plans.lineage import cut

SHINGLE, SLOTS, ROWS = 5, 240, 5
BANDS = SLOTS // ROWS
#: bytes of text whose elements step together
CHUNK = 1 << 19
SALTS = 16
#: rows of a bucket or component that meet others in one block
BLOCK = 1024
#: slots that must agree for two classes of a bucket to be compared in full (five standard deviations below 0.75)
LIKELY = 146
#: links (16 bytes each) up to which one task joins them
ONE_TASK = 200_000


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles with their document, in order; repeated ones are there as often as they occur."""
    h = w.hashes()
    at, doc = window_starts(w.bounds, SHINGLE)
    all_h = windows(h, SHINGLE)[at] if len(at) else np.zeros(0, U)
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    if not len(short):
        return all_h, doc
    few = np.array([mix(windows(h[w.bounds[d] : w.bounds[d + 1]], int(w.counts[d])) + U(w.counts[d]))[0] for d in short], U)
    doc = np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    return np.concatenate([all_h, few])[order], doc[order]


def distinct(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, sorted by document."""
    key = (doc.astype(U) << U(48)) | (h >> U(16))
    key.sort()
    twice = np.unique((key[1:][key[1:] == key[:-1]] >> U(48)).astype(np.int64))
    if not len(twice):
        return h, doc
    again = np.zeros(n_docs, bool)
    again[twice] = True
    sel = again[doc]
    hs, ds = h[sel], doc[sel]
    order = np.lexsort((hs, ds))
    hs, ds = hs[order], ds[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1]))
    h, doc = np.concatenate([h[~sel], hs[new]]), np.concatenate([doc[~sel], ds[new]])
    order = np.argsort(doc, kind="stable")
    return h[order], doc[order]


def superminhash(h: np.ndarray, doc: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """uint32 signatures (n_docs, slots): step in the upper 8 bits, draw in the lower 24; all ones for the empty set."""
    sig = np.full(n_docs * slots, 0xFFFFFFFF, np.uint32)
    rows = np.arange(len(h))
    base = doc.astype(np.int64) * slots
    perm = None
    for j in range(slots):
        x = mix(h + U((j + 1) * int(BASE) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x >> U(32)) * U(slots - j) >> U(32)).astype(np.int64)
        if j == 0:
            p, k0 = k, k
        else:
            if perm is None:  # the first step's swap, for those that take a second
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
                perm[rows, k0] = 0
                perm[rows, 0] = k0
            p = perm[rows, k]
            perm[rows, k] = perm[rows, j]
            p = p.astype(np.int64)
        np.minimum.at(sig, base + p, (U(j << 24) | (x & U(0xFFFFFF))).astype(np.uint32))
        full = sig.reshape(n_docs, slots).max(axis=1) < (j + 1) << 24
        go = ~full[doc]
        if not go.all():
            if not go.any():
                break
            h, doc, base = h[go], doc[go], base[go]
            if perm is None:
                k0 = k0[go]
            else:
                perm = perm[go]
            rows = np.arange(len(h))
    return sig.reshape(n_docs, slots)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, n, set_id, sig): a tag that tells texts of one id apart, size of the set, 128 bits that name it, one byte of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0), batch.column(1)
            for w in split(batch, "text", lower=True, chunk=CHUNK):
                h, doc = distinct(*shingles(w), w.n_docs)
                n = np.bincount(doc, minlength=w.n_docs)
                # a byte of each slot's draw, which is random whatever its step
                sig = (superminhash(h, doc, w.n_docs) & np.uint32(0xFF)).astype(np.uint8)
                name = np.zeros((w.n_docs, 2), U)
                np.add.at(name[:, 0], doc, mix(h))
                np.add.at(name[:, 1], doc, mix(h ^ BASE))
                sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SLOTS), w.n_docs, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), w.n_docs, [None, pa.py_buffer(name.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.n_docs), tags.slice(w.first, w.n_docs), pa.array(n), names, sigs], names=["doc_id", "tag", "n", "set_id", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(run, "doc_id bigint, tag bigint, n bigint, set_id binary, sig binary")


def sets(docs: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, s): the distinct shingles of each class that reps(id) names, from the text of its first document."""
    wanted = cut(classes.select(F.col("rep").alias("id"), "doc_id", "tag").join(if_small(reps), "id", "left_semi"))
    own = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").join(if_small(wanted), ["doc_id", "tag"]).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in split(batch, "text", lower=True, chunk=CHUNK):
                h, doc = distinct(*shingles(w), w.n_docs)
                off = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=w.n_docs))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n_docs), pa.ListArray.from_arrays(pa.array(off), pa.array(h.view(np.int64)))], names=["id", "s"])

    # rows may repeat a document
    return cut(own.mapInArrow(run, "id bigint, s array<bigint>").dropDuplicates(["id"]))


def bands(classes: DataFrame) -> DataFrame:
    """(key, rep, n): a row for each band of each class; the key is the band's number and its slots' bytes."""
    keys = F.array(*[F.concat(F.lit(bytes([b])), F.substring(F.col("sig"), b * ROWS + 1, ROWS)) for b in range(BANDS)])
    return classes.select(F.explode(keys).alias("k"), "rep", "n").select(F.xxhash64("k").alias("key"), "rep", "n")


def _can(a: str, b: str):
    """Sizes that allow the threshold."""
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) those with 100 |A and B| >= 75 |A or B|."""
    x = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    likely = lookup(lookup(pairs, x, ["a"], ["b"]), y, ["b"], ["a"]).where(_can("na", "nb")).select("a", "b", "sa", "sb")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SLOTS) for c in (batch.column(2), batch.column(3))]
                yield batch.filter(pa.array((s[0] == s[1]).sum(axis=1) * 2 >= SLOTS)).select(["a", "b"])

    likely = cut(likely.mapInArrow(alike, "a bigint, b bigint"))
    full = sets(docs, classes, cut(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    x, y = full.select(F.col("id").alias("a"), F.col("s").alias("x")), full.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = lookup(lookup(likely, x, ["a"], ["b"]), y, ["b"], ["a"]).select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("t"))
    # union = total - intersection
    return both.where(100 * F.col("i") >= 75 * (F.col("t") - F.col("i"))).select("a", "b").distinct()


def forest(links: DataFrame) -> DataFrame:
    """The same components from at most one link (node, root) a node and partition, by union-find within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _flat(step: DataFrame) -> DataFrame:
    """(node, to) with `to` led on to the root of its tree, where a root leads to itself."""
    while True:
        onward = step.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        step = cut(lookup(step.select("node", "to"), onward, ["to"], ["node"]).select("node", F.col("to2").alias("to"), (F.col("to") != F.col("to2")).alias("moved")))
        if not step.where("moved").limit(1).count():
            return step.select("node", "to")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest id that each end of links (a, b) reaches.

    A round of hooking and flattening leaves the nodes that are smaller than all of their neighbours, at most half of them, so n nodes take log2(n) rounds at most, and
    a chain in the order of its ids takes one.
    """
    links = cut(forest(links))
    maps: list[DataFrame] = []
    while links.count() > ONE_TASK:
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        step = _flat(cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))))
        maps.append(step)
        sa, sb = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        ends = lookup(lookup(links, sa, ["a"], ["b"]), sb, ["b"], ["a"])
        links = cut(forest(ends.select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct()))
    out = cut(forest(links.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("component")))
    for m in reversed(maps):
        after = out.select(F.col("node").alias("to"), "component")
        out = cut(lookup(m, after, ["to"], ["node"], "left").select("node", F.coalesce("component", F.col("to")).alias("component")))
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first columns, which come one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[0].column(i)[0].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _blocks(df: DataFrame, own: str, n: str, into: str, other: str, m: str) -> DataFrame:
    """Each row in its block of n, and for each of the m blocks of the other side."""
    return df.withColumn(into, F.pmod(F.xxhash64(own), F.col(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(m) - 1)))


def strangers(at: DataFrame, classes: DataFrame) -> DataFrame:
    """(p, c): classes, and other components that have a class in one of their buckets whose signature may belong to the threshold; at(key, rep, n, c).

    In a bucket, what is not of its largest component meets the rest, block by block; only the result leaves a block.
    """
    sizes = at.groupBy("key", "c").agg(F.count("*").alias("k"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("bigint")
    main = sizes.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("all"), F.max("k").alias("most")).where("parts > 1")
    main = main.select("key", "main", blocks(F.col("all")).alias("nq"), blocks(F.col("all") - F.col("most")).alias("np"))
    rows = cut(lookup(lookup(at, main, ["key"], ["rep"]), classes.select("rep", "sig"), ["rep"], ["key"]))
    left = _blocks(rows.where("c <> main"), "rep", "np", "bp", "bq", "nq").withColumn("side", F.lit(0))
    right = _blocks(rows, "rep", "nq", "bq", "bp", "np").withColumn("side", F.lit(1))
    both = left.unionByName(right).select("key", "bp", "bq", "side", "rep", "c", "n", "sig").repartition("key", "bp", "bq").sortWithinPartitions("key", "bp", "bq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            side, rep, c, n = (t.column(i).to_numpy() for i in (3, 4, 5, 6))
            sig = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(-1, SLOTS)
            p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            found = set()
            for i in range(0, len(p), 32):
                own = p[i : i + 32]
                may = (c[own][:, None] != c[q]) & (4 * np.minimum(n[own][:, None], n[q]) >= 3 * np.maximum(n[own][:, None], n[q]))
                x, y = np.nonzero(may)
                near = (sig[own[x]] == sig[q[y]]).sum(axis=1) >= LIKELY
                found |= set(zip(rep[own[x[near]]].tolist(), c[q[y[near]]].tolist(), strict=True))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names=["p", "c"])

    return both.mapInArrow(run, "p bigint, c bigint").distinct()


def cross_links(suspects: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): for suspects (p, c) links of p to members (rep, c) of the component, one a block of members at most; full sets are looked up in the block's inverted index."""
    blocks = lambda n, size: F.ceil(n / F.lit(size)).cast("bigint")
    asked = cut(suspects.groupBy("c").agg(blocks(F.count("*"), BLOCK).alias("np")))
    need = cut(lookup(members, asked, ["c"], ["rep"]))
    size = cut(need.groupBy("c").agg(blocks(F.count("*"), BLOCK // 4).alias("nq")))
    need = cut(lookup(need, size, ["c"], ["rep"]))
    left = cut(lookup(lookup(suspects, asked, ["c"], ["p"]), size, ["c"], ["p"]))
    full = sets(docs, classes, cut(need.select(F.col("rep").alias("id")).union(left.select("p")).distinct()))
    q = _blocks(need, "rep", "nq", "bq", "bp", "np").select("c", "bp", "bq", F.lit(1).alias("side"), F.col("rep").alias("id"))
    p = _blocks(left, "p", "np", "bp", "bq", "nq").select("c", "bp", "bq", F.lit(0).alias("side"), F.col("p").alias("id"))
    both = lookup(q.unionByName(p), full, ["id"], ["c", "bp", "bq"]).select("c", "bp", "bq", "side", "id", "s").repartition("c", "bp", "bq").sortWithinPartitions("c", "bp", "bq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            t = t.combine_chunks()
            side, ids = t.column(3).to_numpy(), t.column(4).to_numpy()
            lists = t.column(5).combine_chunks()
            off = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            n = np.diff(off)
            q = np.flatnonzero(side == 1)
            v = np.concatenate([values[off[i] : off[i + 1]] for i in q]) if len(q) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(q)), n[q])
            order = np.argsort(v, kind="stable")
            v, owner = v[order], owner[order]
            out = []
            for i in np.flatnonzero(side == 0):
                s = values[off[i] : off[i + 1]]
                lo, hi = np.searchsorted(v, s, "left"), np.searchsorted(v, s, "right")
                k = hi - lo
                at = np.repeat(lo, k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                common = np.bincount(owner[at], minlength=len(q))
                hit = np.flatnonzero(100 * common >= 75 * (n[i] + n[q] - common))
                if len(hit):
                    out.append((int(ids[i]), int(ids[q[hit[0]]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, n, set_id, c, least) for each row of docs: the number of its group and the group's smallest document, both null for rows that are alone."""
    own = docs.select("doc_id", "text")
    signed = cut(sign(own))
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    by_set = some.groupBy("set_id").agg(F.min(F.struct("doc_id", "tag", "n", "sig")).alias("c"), F.count("*").alias("rows")).select("set_id", "c.*", "rows")
    # a number for each class, from its place in storage, which lost executors do not change
    classes = cut(cut(by_set).withColumn("rep", F.monotonically_increasing_id()))

    rows = bands(classes)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    part = salted.groupBy("key", "salt").agg(F.min("rep").alias("part_min"), F.count("*").alias("m"))
    whole = cut(part.groupBy("key").agg(F.min("part_min").alias("all_min"), F.sum("m").alias("m")).where("m > 1"))
    shared = cut(lookup(salted, whole, ["key"], ["rep"]))
    near = cut(shared.groupBy("key", "salt").agg(F.min("rep").alias("part_min")))
    star = lookup(shared, near, ["key", "salt"], ["rep"]).select("rep", F.explode(F.array_distinct(F.array("all_min", "part_min"))).alias("to")).where("rep <> to")
    pairs = cut(star.select(F.greatest("rep", "to").alias("a"), F.least("rep", "to").alias("b")).distinct())
    links = cut(verify(pairs, classes, own))
    comp = components(links)

    # classes of different components that share a bucket of three or more; in one of two they have met
    of = lambda c: c.select(F.col("node").alias("rep"), "component")
    at = lookup(shared.where("m > 2").select("key", "rep", "n"), of(comp), ["rep"], ["key"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    suspects = cut(strangers(at, classes))
    if suspects.limit(1).count():
        members = lookup(classes.select("rep"), of(comp), ["rep"], ["rep"], "left").select("rep", F.coalesce("component", "rep").alias("c"))
        extra = cut(cross_links(suspects, members, classes, own))
        if extra.limit(1).count():
            comp = components(links.unionByName(extra))

    named = lookup(classes.select("rep", "set_id", "doc_id", "rows"), of(comp), ["rep"], ["rep"], "left").select("set_id", "doc_id", "rows", F.coalesce("component", "rep").alias("c"))
    named = cut(named)
    linked = cut(named.groupBy("c").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1").select("c", "least"))
    # only sets that several rows or classes share say more than the row itself
    labels = lookup(named, linked, ["c"], ["set_id"], "left").where("rows > 1 OR least IS NOT NULL").select("set_id", "c", F.coalesce("least", "doc_id").alias("least"))
    return lookup(signed.select("doc_id", "tag", "n", "set_id"), cut(labels), ["set_id"], ["doc_id", "tag"], "left")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    own = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.coalesce("least", "doc_id"))
    out = _grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, with its columns: of the smallest id; of its texts the one of least hash, and of equal rows any. Rows of null id or without words all stay."""
    rows = cut(_grouped(docs).where("c IS NOT NULL AND n > 0 AND doc_id IS NOT NULL").groupBy("c", "doc_id", "tag").agg(F.count("*").alias("k")))
    first = cut(rows.groupBy("c").agg(F.min(F.struct("doc_id", "tag", "k")).alias("f")).select("f.*"))
    gone = rows.select("doc_id", "tag").join(if_small(first.select("doc_id", "tag")), ["doc_id", "tag"], "left_anti")
    again = first.where("k > 1").select("doc_id", "tag")
    tag = fresh(docs, "text_tag")
    tagged = docs.withColumn(tag, F.xxhash64("text"))

    def among(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"))
        return tagged.join(if_small(keys), (tagged["doc_id"] == keys["_d"]) & (tagged[tag] == keys["_t"]), how)

    if not again.limit(1).count():
        return among(cut(gone), "left_anti").select(*docs.columns)
    repeated = among(again, "left_semi").groupBy("doc_id", tag).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    one = repeated.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    return among(cut(gone.unionByName(again)), "left_anti").select(*docs.columns).unionByName(one)
