"""Graphs, matrices and vectors derived from the star-schema tables, each with its SQL text."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

#: added to part keys so that both sides of the supplier-part graph share one id space
PART_BASE = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COO matrix (row supplier, col part, value number of line items)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.count("*").cast("int").alias("value"))


def supplier_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of the supplier-part graph, distinct (src, dst)."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") + PART_BASE).alias("p")).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("p").alias("dst")), F.struct(F.col("p").alias("src"), F.col("s").alias("dst")))).alias("e")).select("e.*")


def customer_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier, distinct (src, dst)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COO matrix (row customer nation, col supplier nation, value line items)."""
    o, li, c, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier"))
    # the large pair first collapses to (customer, supplier), so that the dimension joins see far fewer rows
    pairs = o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    joined = pairs.join(c, pairs.o_custkey == c.c_custkey).join(s, pairs.l_suppkey == s.s_suppkey)
    return joined.groupBy(F.col("c_nationkey").cast("bigint").alias("row"), F.col("s_nationkey").cast("bigint").alias("col")).agg(F.sum("n").cast("int").alias("value"))


def region_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse COO matrix (row nation, col nation of the same region, value suppliers of col, balance sum of their balances)."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").cast("int").alias("value"), F.sum("s_acctbal").alias("balance"))
    other = n.select(F.col("n_nationkey").alias("col"), "n_regionkey")
    return n.join(other, "n_regionkey").join(s, F.col("col") == s.s_nationkey).select(F.col("n_nationkey").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "value", "balance")


def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seconds): times between a user's consecutive events."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(((at - F.lag(at).over(w)) / F.lit(1e6)).alias("seconds")).where("seconds IS NOT NULL")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page to href, distinct (src string, dst string)."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst")).distinct()


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COO matrix (row event type, col the same user's next event type, value count)."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("event_type").alias("row"), F.lead("event_type").over(w).alias("col")).where("col IS NOT NULL").groupBy("row", "col").agg(F.count("*").cast("int").alias("value"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector of customer balances (idx, value)."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("value"))


def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense symmetric Gram matrix of the embedding columns (row, col, value): the products of the 64 columns summed over all vectors.

    Each task sums whole batches of vectors to one matrix, so a vector is never blown up to its products. Null vectors are skipped.
    """

    def run(batches):
        total = None
        for batch in batches:
            vectors = batch.column(0).drop_null()
            if len(vectors):
                x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
                total = x.T @ x + (0.0 if total is None else total)
        if total is not None:
            at = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["row", "col", "value"])

    sums = table(spark, sf_dir, "embeddings").select("embedding").mapInArrow(run, "row bigint, col bigint, value double")
    return sums.groupBy("row", "col").agg(F.sum("value").alias("value"))


SQL = {
    "pairs": "SELECT l_suppkey AS row, l_partkey AS col, CAST(count(*) AS INT) AS value FROM lineitem GROUP BY ALL",
    "sp_edges": f"SELECT DISTINCT l_suppkey AS src, l_partkey + {PART_BASE} AS dst FROM lineitem UNION ALL SELECT DISTINCT l_partkey + {PART_BASE} AS src, l_suppkey AS dst FROM lineitem",
    "cs_edges": "SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "trade": "SELECT CAST(c_nationkey AS BIGINT) AS row, CAST(s_nationkey AS BIGINT) AS col, CAST(count(*) AS INT) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "sparse": "SELECT CAST(a.n_nationkey AS BIGINT) AS row, CAST(b.n_nationkey AS BIGINT) AS col, CAST(count(*) AS INT) AS value, sum(s_acctbal) AS balance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey GROUP BY ALL",
    "gaps": "SELECT (epoch_us(CAST(ts AS TIMESTAMP)) - lag(epoch_us(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS seconds FROM events",
    "links": "SELECT DISTINCT 'page:' || CAST(page_id AS VARCHAR) AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages",
    "transitions": "SELECT row, col, CAST(count(*) AS INT) AS value FROM (SELECT event_type AS row, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS col FROM events) WHERE col IS NOT NULL GROUP BY ALL",
    "balances": "SELECT c_custkey AS idx, c_acctbal AS value FROM customer",
    "gram": "SELECT i AS row, j AS col, sum(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE)) AS value FROM embeddings, range(64) a(i), range(64) b(j) GROUP BY ALL",
}
