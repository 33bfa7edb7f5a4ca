"""Line dedup by content-defined chunks of lines.

**Chunks.** A rolling hash runs over the hashes of a document's lines: the polynomial in `MULTIPLIER` of the last `WINDOW` of them, modulo a prime. A chunk ends after each
line whose rolling hash is smaller than that of the line before and not larger than that of the line after, and after the last line; never after the first line or the
last but one. So chunks have two lines or more (but for texts of one line) and three on the mean. The choice depends on `WINDOW` + 2 lines only, so an
inserted or lost line shifts no boundary but those beside it, and a passage that documents share is cut alike in all of them but for its edges. **Removal.** Of the
chunks with two lines or more and some non-blank line, equal ones are found by hash over the whole corpus and then compared byte by byte; all but the first place (smallest
doc_id, then place in the document) are cut out. Single lines stay: lines that recur by themselves are often text of their own.

The hash runs first, over narrow rows; chunk texts are only moved for repeated hashes, and texts not at all as long as the places to cut are few enough to travel to them.

Edge cases: null or empty texts have no chunks and stay as they are; of rows that repeat a document with its id, each is treated like the document (their chunks are one
place); if one id has several texts, places of the id are cut from all of them where the chunk there is a repeated one; rows of null id are neither cut nor compared;
equal line hashes end no chunk twice, as one of the two comparisons is strict; an empty table gives an empty result; extra columns, whatever their names, are
carried along and not read (but for n_chars, which is counted anew). A very long text is one row of arrays: memory is a few times its size.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.joins import if_small
from meshloom.llm.text import WHITE, fresh, let
from meshloom.plans.lineage import cut

#: lines under the rolling hash, its multiplier and its modulus, a prime
WINDOW, MULTIPLIER, PRIME = 3, 31, (1 << 31) - 1


def line_hash(line: Column) -> Column:
    """28 bits of MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("int")


def rolling(h: Column) -> Column:
    """Of each line the hash of it and the lines before it in the window."""
    at = lambda i, j: F.coalesce(F.get(h, i - j).cast("bigint"), F.lit(0)) * F.lit(MULTIPLIER**j)
    return F.transform(h, lambda x, i: sum((at(i, j) for j in range(1, WINDOW)), x.cast("bigint")) % PRIME)


def chunks(text: Column) -> Column:
    """Array of structs (n_lines, body) that partition the text's lines in order."""
    def ends(r: Column) -> Column:
        last = F.size(r) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ((i > 0) & (i < last - 1) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) <= F.get(r, i + 1))))

    def parts(x: Column) -> Column:
        begin = lambda e, j: F.coalesce(F.get(x["e"], j - 1) + 1, F.lit(0))
        return F.transform(x["e"], lambda e, j: F.struct((e - begin(e, j) + 1).alias("n_lines"), F.array_join(F.slice(x["l"], begin(e, j) + 1, e - begin(e, j) + 1), "\n").alias("body")))

    split = F.split(F.coalesce(text, F.lit("")), "\n")
    return let(split, lambda ln: let(F.transform(ln, line_hash), lambda h: let(rolling(h), lambda r: let(F.struct(ends(r).alias("e"), ln.alias("l")), parts))))


def _multi(docs: DataFrame) -> DataFrame:
    """(doc_id, at, body, h) of chunks that may go."""
    c = docs.where("doc_id IS NOT NULL AND text <> ''").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("at", "c")).select("doc_id", "at", "c.*")
    return c.where((F.col("n_lines") >= 2) & (F.length(F.btrim("body", F.lit(WHITE + "\n"))) > 0)).select("doc_id", "at", "body", F.xxhash64("body").alias("h"))


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, cut): digests of the chunks to cut, by place, for documents that lose any."""
    c = _multi(docs)
    often = cut(c.select("h", "doc_id", "at").groupBy("h").agg(F.min(F.struct("doc_id", "at")).alias("a"), F.max(F.struct("doc_id", "at")).alias("b")).where("a <> b").select("h"))
    again = cut(c.join(if_small(often), "h"))
    # grouped by the bytes themselves: equal hashes of different chunks part here
    # written, so that the join below is one of two exchanges, whose hot keys Spark can split
    first = cut(again.groupBy("h", "body").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", F.col("body").alias("b"), "first"))
    gone = again.join(first, "h").where((F.col("body") == F.col("b")) & (F.struct("doc_id", "at") != F.col("first")))
    return cut(gone.groupBy("doc_id").agg(F.collect_set(F.struct("at", "h")).alias("cut")))


def _with_cuts(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with arrays of chunks and of places to cut; both are null where nothing is cut."""
    name, at = fresh(docs, "cut_chunks"), fresh(docs, "all_chunks")
    cuts = removals(docs).select(F.col("doc_id").alias("_doc"), F.col("cut").alias(name))
    joined = docs.join(if_small(cuts), docs["doc_id"] == cuts["_doc"], "left").drop(cuts["_doc"])
    joined = joined.withColumn(at, F.when(F.col(name).isNotNull(), chunks(docs["text"])))
    # places whose chunk is the one that was judged: another text of the id may have a different one there
    same = F.filter(F.col(name), lambda c: F.xxhash64(F.get(F.col(at), c["at"])["body"]) == c["h"])
    places = F.transform(same, lambda c: c["at"])
    return joined.withColumn(name, F.when(F.size(places) > 0, places)), name, at


def _kept(name: str, at: str) -> Column:
    left = F.array_except(F.sequence(F.lit(0), F.size(at) - 1), F.col(name))
    return F.array_join(F.transform(left, lambda i: F.get(F.col(at), i)["body"]), "\n")


def dedup_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed_lines, kept_text) of each row; null text has no lines and stays null."""
    df, name, at = _with_cuts(docs.select("doc_id", "text"))
    n = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(F.split("text", "\n")))
    gone = F.aggregate(F.transform(F.col(name), lambda i: F.get(F.col(at), i)["n_lines"]), F.lit(0), lambda a, c: a + c)
    return df.select("doc_id", n.cast("bigint").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_removed_lines"), F.when(F.col(name).isNull(), F.col("text")).otherwise(_kept(name, at)).alias("kept_text"))


def remove_repeated(docs: DataFrame) -> DataFrame:
    """docs with the repeated chunks cut from text and n_chars (where there is such a column) counted anew; documents that lose all of their text go."""
    df, name, at = _with_cuts(docs)
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(_kept(name, at))
    df = df.withColumn("text", text).where(F.col(name).isNull() | (F.length(F.btrim("text", F.lit(WHITE))) > 0))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)
