"""Iterative plans: PageRank and the power method as joins and aggregations in a driver loop."""

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.plans import lineage
from meshloom.plans.lineage import cut, free


#: out-edges of a vertex that one task holds
HUB = 1 << 20


@dataclass
class Ranking:
    """ranks(idx, value), iterations done, the last error, whether it fell to eps, seconds in all and of each step."""

    ranks: DataFrame
    iterations: int
    error: float
    converged: bool
    seconds: float
    step_seconds: list[float] = field(default_factory=list)


@dataclass
class Eigen:
    vector: DataFrame
    eigenvalue: float
    iterations: int
    error: float
    converged: bool
    seconds: float


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("idx")).distinct()


def dealt(edges: DataFrame, vertices: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(idx, salt, dst, degree, parts) and the number of vertices: distinct edges from idx, and for each vertex a row to itself that alone has a degree; dealt by (idx, salt).

    The edges of a vertex are parted over `parts` salts, so that no task holds more than `HUB` of them. Edges are dealt and written once; the steps of a loop move vectors only.
    """
    e = cut(edges.select("src", "dst").distinct())
    ends = F.explode(F.array(F.struct(F.col("src").alias("idx"), F.lit(1).alias("n")), F.struct(F.col("dst").alias("idx"), F.lit(0).alias("n"))))
    degrees = e.select(ends.alias("x")).groupBy("x.idx").agg(F.sum("x.n").alias("degree"))
    own = degrees if vertices is None else vertices.select("idx").join(degrees, "idx", "left").select("idx", F.coalesce("degree", F.lit(0)).alias("degree"))
    own = cut(own.select("idx", "degree", F.ceil(F.greatest(F.col("degree"), F.lit(1)) / F.lit(HUB)).cast("int").alias("parts")))
    # at most one in HUB edges
    hubs = own.where("parts > 1").select(F.col("idx").alias("hub"), F.col("parts").alias("k"))
    salted = e.join(F.broadcast(hubs), e["src"] == hubs["hub"], "left") if hubs.limit(1).count() else e.withColumn("k", F.lit(None).cast("int"))
    none = F.lit(None)
    rows = salted.select(F.col("src").alias("idx"), F.coalesce(F.pmod(F.xxhash64("dst"), F.col("k")).cast("int"), F.lit(0)).alias("salt"), "dst", none.cast("bigint").alias("degree"), none.cast("int").alias("parts"))
    placed = lineage.dealt(rows.unionByName(own.select("idx", F.lit(0).alias("salt"), F.col("idx").alias("dst"), "degree", "parts")), "idx", "salt")
    n = own.count()
    free(e)
    free(own)
    return placed, n


def start(graph: DataFrame, n: int) -> DataFrame:
    """(idx, value, degree, parts): 1/n at each vertex."""
    return graph.where("parts IS NOT NULL").select("idx", F.lit(1.0 / n).alias("value"), "degree", "parts")


def step(graph: DataFrame, q: DataFrame, n: int, beta: float) -> DataFrame:
    """(idx, y, old, degree, parts): one damped step from q, whose values sum to 1, before scaling: beta times the shares that reach a vertex, plus (1 - beta) / n; old is q's value.

    Mass of vertices without out-edges is lost here and comes back by the scaling, in proportion to the new ranks.
    """
    share = F.try_divide(F.col("value"), F.col("degree"))
    sent = q.select(F.col("idx").alias("i"), "value", share.alias("share"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"))
    moved = graph.join(sent, (graph["idx"] == sent["i"]) & (graph["salt"] == sent["s"]))
    edge = F.col("parts").isNull()
    got = moved.groupBy("dst").agg(
        F.coalesce(F.sum(F.when(edge, F.col("share"))), F.lit(0.0)).alias("y"), F.max(F.when(~edge, F.col("value"))).alias("old"), F.max("degree").alias("degree"), F.max("parts").alias("parts")
    )
    # an end that is none of the given vertices has no row of its own
    return got.where("parts IS NOT NULL").select(F.col("dst").alias("idx"), (F.lit(beta) * F.col("y") + F.lit((1.0 - beta) / n)).alias("y"), "old", "degree", "parts")


def _advance(graph: DataFrame, q: DataFrame, n: int, beta: float) -> tuple[DataFrame, DataFrame]:
    """The scaled vector after a step, and the table that it reads."""
    y = cut(step(graph, q, n, beta))
    total = y.agg(F.sum("y")).head()[0]
    if not total:
        raise ValueError("no edge carries mass: all ranks are 0")
    return y.select("idx", (F.col("y") / F.lit(total)).alias("value"), "old", "degree", "parts"), y


def _graph(edges: DataFrame, vertices: DataFrame | None) -> tuple[DataFrame, int]:
    graph, n = dealt(edges, vertices)
    if not n:
        raise ValueError("a graph needs a vertex")
    return graph, n


def pagerank_fixed(edges: DataFrame, iterations: int, beta: float = 1.0, vertices: DataFrame | None = None) -> DataFrame:
    """(idx, value) after so many steps. Each step joins a vector to the dealt edges, sums by destination and is written; the vector of the step before is freed."""
    graph, n = _graph(edges, vertices)
    q, last = start(graph, n), None
    for _ in range(iterations):
        q, y = _advance(graph, q, n, beta)
        if last is not None:
            free(last)
        last = y
    return q.select("idx", "value")


def pagerank(edges: DataFrame, beta: float = 1.0, eps: float = 1e-11, max_iter: int = 10_000, vertices: DataFrame | None = None) -> Ranking:
    """Until the L1 change is at most eps, some rank is exactly 1, or max_iter steps are done (converged is False then, as on periodic graphs at beta = 1).

    Edges are made distinct; self loops count; vertices default to the ends of edges. Raises ValueError without vertices,
    or where all mass is lost. A step's vector holds the one before, so its error is an aggregate over one table.
    """
    began = time.perf_counter()
    graph, n = _graph(edges, vertices)
    q, last = start(graph, n), None
    error, one, took = float("inf"), n == 1, []
    while error > eps and not one and len(took) < max_iter:
        at = time.perf_counter()
        q, y = _advance(graph, q, n, beta)
        error, one = q.agg(F.sum(F.abs(F.col("value") - F.col("old"))), F.bool_or(F.col("value") == 1.0)).head()
        if last is not None:
            free(last)
        last = y
        took.append(time.perf_counter() - at)
    return Ranking(q.select("idx", "value"), len(took), error, error <= eps or one, time.perf_counter() - began, took)


def pagerank_transposed(transposed: DataFrame, **more) -> Ranking:
    """From rows (row destination, col source) of the transposed matrix."""
    return pagerank(transposed.select(F.col("col").alias("src"), F.col("row").alias("dst")), **more)


def _norm(norm: str):
    return F.sqrt(F.sum(F.col("value") * F.col("value"))) if norm == "l2" else F.sum(F.abs(F.col("value")))


def _placed(m: DataFrame, n: int) -> DataFrame:
    """m with a row without value on the diagonal, so that each product has all n rows and carries the vector before; dealt by column and written once."""
    spark = m.sparkSession
    own = spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(None).cast("double").alias("value"))
    some = m.where("value IS NOT NULL").select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value"))
    return lineage.dealt(some.unionByName(own), "col")


def _product(m: DataFrame, x: DataFrame) -> DataFrame:
    """(idx, value, old) of `_placed` m times x(idx, value)."""
    sent = x.select(F.col("idx").alias("col"), F.col("value").alias("x"))
    return m.join(sent, "col").groupBy(F.col("row").alias("idx")).agg(F.coalesce(F.sum(F.col("value") * F.col("x")), F.lit(0.0)).alias("value"), F.max(F.when(F.col("value").isNull(), F.col("x"))).alias("old"))


def _powers(m: DataFrame, n: int, norm: str, single: bool, x: DataFrame | None) -> Iterator[tuple[DataFrame, float]]:
    """(idx, value, old) and the norm of the product, step by step; single rounds each entry to 32 bits."""
    m = _placed(m, n)
    x = x if x is not None else m.sparkSession.range(n).select(F.col("id").alias("idx"), F.lit(1.0 / n).alias("value"))
    last = None
    while True:
        y = cut(_product(m, x))
        size = y.agg(_norm(norm)).head()[0]
        if last is not None:
            free(last)
        if not size:
            raise ValueError("the product is 0: no dominant eigenvector")
        value = F.col("value") / F.lit(size)
        x, last = y.select("idx", (value.cast("float").cast("double") if single else value).alias("value"), "old"), y
        yield x, size


def power_fixed(m: DataFrame, n: int, iterations: int, norm: str = "l2") -> DataFrame:
    """(idx, value, eigenvalue) after so many steps from 1/n."""
    for _, (x, size) in zip(range(iterations), _powers(m, n, norm, False, None)):
        got = x.select("idx", "value", F.lit(size).alias("eigenvalue"))
    return got


def power_method(m: DataFrame, n: int, norm: str = "l2", eps: float = 1e-9, max_iter: int = 100_000, x0: DataFrame | None = None, single: bool = False) -> Eigen:
    """Dominant eigenvector of m by y = m x, x = y / |y| from 1/n (or x0) until |x - y| is at most eps in the same norm.

    single is the variant in 32 bits (for an eps of about 1e-5): matrix and vector are rounded to floats, sums are not.
    """
    began = time.perf_counter()
    if single:
        m = m.select("row", "col", F.col("value").cast("float").cast("double").alias("value"))
    x, size, done, error = x0, 0.0, 0, float("inf")
    if max_iter > 0:
        for x, size in _powers(m, n, norm, single, x0):
            error = x.select((F.col("value") - F.col("old")).alias("value")).agg(_norm(norm)).head()[0]
            done += 1
            if error <= eps or done >= max_iter:
                break
    return Eigen(x.select("idx", "value"), size, done, error, error <= eps, time.perf_counter() - began)


def top_k(ranks: DataFrame, k: int) -> DataFrame:
    """The k highest ranks, ties by index (an extension)."""
    return ranks.orderBy(F.desc("value"), "idx").limit(k)


def dangling(edges: DataFrame) -> DataFrame:
    """Vertices without out-edges."""
    return vertices_of(edges).join(edges.select(F.col("src").alias("idx")), "idx", "left_anti")
