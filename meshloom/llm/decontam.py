"""Benchmark decontamination by a positional inverted index over the training documents.

A benchmark item of 13 words or more has a window for each 13 consecutive words, a shorter one is a window by itself. **Index.** Each document is read and split
into words once. What is kept is partitioned by document: entry n of a document's array is the 64-bit hash of word n. From it the posting lists of the terms that are asked for are
drawn: for a term and a document, all places. **Intersection.** Terms of windows are counted over all documents. The list of a window's rarest term gives the places where the window
might start, the list of its second rarest, adjusted by its offset, is intersected with them, and what is left with the lists of all its other terms, which are only drawn for
documents that are left. **Check.** The words at the places found are compared with the window's, so a match is exact.

Edge cases: null and empty texts have no words; items or documents without words match nothing; repeated documents each get the result of their text, and if one id has several texts,
each is a document by itself; documents of null id are kept with no hits; items of null id are ignored; of equally rare terms (ties) that of smaller hash comes first, which
changes no result; empty tables give empty results or no hits; extra columns are not read, whatever their names. A very long text is one array of 8 bytes a word.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshloom.llm.joins import if_small, lookup
from meshloom.llm.text import alnum_words, fresh
from meshloom.plans.lineage import cut

WINDOW = 13


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def index_of(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, tag, h): a number and a tag of its text for each row of docs, and the hashes of its words in order."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), _hashed(alnum_words(F.col("text"))).alias("h"))
    # numbers come from places in storage, which lost executors do not change
    return cut(rows).withColumn("rid", F.monotonically_increasing_id())


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words) of all windows of all items."""
    w = items.where("item_id IS NOT NULL").select("item_id", alnum_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(at, lambda i: F.slice("w", i, window))).alias("words")).distinct()


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, n) over all documents for the given distinct terms."""
    return index.select(F.explode("h").alias("t")).join(if_small(terms), "t").groupBy("t").agg(F.count("*").alias("n"))


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, rid, at): the list of places of each of the given distinct terms in each document with an id."""
    tokens = index.where("doc_id IS NOT NULL").select("rid", F.posexplode("h").alias("pos", "t"))
    return tokens.join(if_small(terms), "t").groupBy("t", "rid").agg(F.collect_list("pos").alias("at"))


def _adjusted(at: str, offset: str) -> Column:
    return F.transform(F.col(at), lambda p: p - F.col(offset))


def _ranked(index: DataFrame, parts: DataFrame) -> DataFrame:
    """(wid, t, offset, size, k): the terms of each window (wid, words), the rarest first, where all of its terms occur."""
    places = cut(parts.select("wid", F.size("words").alias("size"), F.posexplode(_hashed(F.col("words"))).alias("offset", "t")))
    counts = cut(term_counts(index, cut(places.select("t").distinct())))
    known = places.join(if_small(counts), "t").withColumn("found", F.count("*").over(Window.partitionBy("wid"))).where("found = size")
    return cut(known.withColumn("k", F.row_number().over(Window.partitionBy("wid").orderBy("n", "t", "offset"))).select("wid", "t", "offset", "size", "k"))


def phrase_matches(index: DataFrame, parts: DataFrame, docs: DataFrame) -> DataFrame:
    """(rid, wid, start, size): every place where the words of a window (wid, words) stand in a document."""
    ranked = _ranked(index, parts)
    # the lists of the two rarest terms come from one pass over the index
    lists = cut(postings(index, cut(ranked.where("k <= 2").select("t").distinct())))
    rarest = lists.join(if_small(ranked.where("k = 1").drop("k")), "t").select("wid", "rid", "size", _adjusted("at", "offset").alias("starts"))
    second = cut(rarest.where("size > 1")).join(if_small(ranked.where("k = 2").select("wid", "t", "offset")), "wid")
    both = second.join(lists, ["t", "rid"]).select("wid", "rid", "size", F.array_intersect("starts", _adjusted("at", "offset")).alias("starts"))
    left = cut(rarest.where("size = 1").unionByName(both.where(F.size("starts") > 0)))
    others = ranked.where("k > 2").select("wid", "t", "offset")
    asked = cut(left.where("size > 2"))
    here = index.join(if_small(cut(asked.select("rid").distinct())), "rid", "left_semi")
    more = cut(postings(here, cut(others.select("t").distinct())))
    probes = asked.join(if_small(others), "wid").join(more, ["t", "rid"])
    met = probes.groupBy("wid", "rid", "size").agg(F.first("starts").alias("starts"), F.collect_list(_adjusted("at", "offset")).alias("lists")).where(F.size("lists") == F.col("size") - 2)
    all_met = met.select("wid", "rid", "size", F.aggregate("lists", F.col("starts"), F.array_intersect).alias("starts"))
    found = cut(left.where("size <= 2").unionByName(all_met).select("rid", "wid", "size", F.explode("starts").alias("start")))

    # the words themselves, of documents with a match only
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("wid", "size", "start")).alias("spans"))
    named = cut(index.select("rid", "doc_id", "tag").join(if_small(cut(spans)), "rid"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").join(if_small(named.select("doc_id", "tag").distinct()), ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])
    cases = lookup(named, texts.select("doc_id", "tag", alnum_words(F.col("text")).alias("w")), ["doc_id", "tag"], ["rid"])
    there = cases.select("rid", F.explode(F.transform("spans", lambda s: F.struct(s["wid"].alias("wid"), s["start"].alias("start"), s["size"].alias("size"), F.slice("w", s["start"] + 1, s["size"]).alias("there")))).alias("s"))
    return there.select("rid", "s.*").join(if_small(parts), "wid").where(F.col("there") == F.col("words")).select("rid", "wid", "start", "size")


def proximity_matches(docs: DataFrame, items: DataFrame, terms: int = 3, slop: int = 10) -> DataFrame:
    """(item_id, doc_id, pos): places of an item's rarest term that have all of its `terms` rarest distinct terms at most `slop` words away.

    Items whose terms include one that no document has match nothing. Terms are compared as 64-bit hashes.
    """
    index = index_of(docs)
    words = items.where("item_id IS NOT NULL").select("item_id", F.explode(F.array_distinct(_hashed(alnum_words(F.col("text"))))).alias("t")).distinct()
    counts = term_counts(index, words.select("t").distinct())
    ranked = words.join(counts, "t", "left").withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "t"))).where(F.col("k") <= terms)
    ranked = cut(ranked.withColumn("of", F.count("*").over(Window.partitionBy("item_id"))).select("item_id", "t", "k", "of"))
    lists = cut(postings(index, ranked.select("t").distinct()))
    met = lists.join(if_small(ranked), "t").groupBy("item_id", "rid", "of").agg(F.max(F.when(F.col("k") == 1, F.col("at"))).alias("rare"), F.collect_list("at").alias("all")).where(F.size("all") == F.col("of"))
    near = lambda p: F.forall("all", lambda at: F.exists(at, lambda q: F.abs(q - p) <= slop))
    return met.select("item_id", "rid", F.explode(F.filter("rare", near)).alias("pos")).join(index.select("rid", "doc_id"), "rid").select("item_id", "doc_id", "pos").distinct()


def hits(index: DataFrame, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, n_hit, items) of documents with a match: covered words, and the items (sorted as strings) that have a window there."""
    owned = cut(windows_of(items, window).groupBy("words").agg(F.collect_set("item_id").alias("ids"))).withColumn("wid", F.monotonically_increasing_id())
    found = phrase_matches(index, owned.select("wid", "words"), docs).join(if_small(owned.select("wid", "ids")), "wid")
    spans = found.groupBy("rid").agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.collect_set("ids").alias("ids"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    return cut(spans.select("rid", F.size(covered).cast("bigint").alias("n_hit"), F.array_sort(F.transform(F.array_distinct(F.flatten("ids")), lambda i: i.cast("string"))).alias("items")))


def _judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, tag, n_words, n_hit, items, contaminated) for each row of docs: contaminated with a hit word, and one in twenty or more."""
    own = docs.select("doc_id", "text")
    index = index_of(own)
    rows = index.select("rid", "doc_id", "tag", F.size("h").cast("bigint").alias("n_words")).join(if_small(hits(index, own, items)), "rid", "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.select("doc_id", "tag", "n_words", n.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) for each row of docs."""
    return _judged(docs, items).drop("tag")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    bad = cut(_judged(docs, items).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).distinct())
    tag = fresh(docs, "text_tag")
    tagged = docs.withColumn(tag, F.xxhash64("text"))
    return tagged.join(if_small(bad), (tagged["doc_id"] == bad["_d"]) & (tagged[tag] == bad["_t"]), "left_anti").select(*docs.columns)
