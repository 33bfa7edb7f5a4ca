"""Mixing sources to target weights by temperature, realised as budgeted permutations of blocks.

**Weights.** Source i has share p_i of all tokens (words). Its weight is p_i^t / sum p_j^t. At t = 1 that is its share, at t = 0 all sources weigh the same. The
exponent t is found by bisection: the largest at which the weights' entropy reaches a target, or the smallest at which no source repeats more
than a limit. **Budgets.** A source's budget is its weight times the total, which is given, or else the least at which no source needs less than one
whole pass; so nothing is lost by default. **Blocks.** A source's documents are dealt into blocks by a hash of their id. It gets as many whole passes as its
budget holds; for the rest, its blocks are taken in a seeded random order, and within the block at the budget's edge its documents in such an order, while they
fit. Prefix sums run over blocks, and over documents of one block only, so a source with a third of all rows is no task of its own.

Only the sums of powers that the bisection needs reach the driver: of up to `SOURCES` sources from their token counts, of more from an aggregate for each step.

Edge cases: null or empty sources are sources like others; null and empty texts have no tokens and ride along with whole passes; equal hashes (ties) are ordered by id; rows that repeat a
document count each; an empty table gives an empty result; extra columns are not read, whatever their names. A very long text is one document of many tokens: it fits a budget whole or not at all.
"""

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshloom.llm.joins import if_small
from meshloom.llm.text import words
from meshloom.plans.lineage import cut

#: documents of a block on average, and sources whose token counts the driver holds for the bisection
BLOCK, SOURCES = 256, 100_000
#: default: no source is passed over more than four times
REPEATS = 4.0


#: of an exponent t: sum of (n / top)^t over the sources with n > 0 tokens, and sum of (n / top)^t * ln (n / top)^t
Moments = Callable[[float], tuple[float, float]]


def moments_of(counts: Iterable[int]) -> Moments:
    some = [n for n in counts if n]
    top = max(some, default=1)

    def moments(t: float) -> tuple[float, float]:
        return math.fsum((n / top) ** t for n in some), math.fsum((n / top) ** t * t * math.log(n / top) for n in some)

    return moments


def moments_by_aggregate(sums: DataFrame) -> Moments:
    """The same of sums(n), for more sources than the driver should hold."""
    some = sums.where("n > 0")
    top = some.agg(F.max("n")).head()[0] or 1

    def moments(t: float) -> tuple[float, float]:
        x = F.pow(F.col("n") / F.lit(top), F.lit(t))
        got = some.agg(F.sum(x), F.sum(x * F.log(x))).head()
        return got[0] or 0.0, got[1] or 0.0

    return moments


def entropy(moments: Moments, t: float) -> float:
    """Of the weights at t."""
    z, zl = moments(t)
    return math.log(z) - zl / z if z else 0.0


def rate(moments: Moments, t: float, total: float | None, top: float) -> float:
    """How often the largest source is passed over; another of n tokens is (n / top)^(t - 1) times as often. By default it is passed once, and no source less."""
    z, _ = moments(t)
    return 1.0 if total is None or not z else total / (z * top)


def exponent(moments: Moments, least: float, top: float, target_entropy: float | None = None, max_passes: float | None = None, total: float | None = None, steps: int = 60) -> float:
    """By bisection over [0, 1]: the largest t whose entropy is at least the target, or the smallest t without more passes than the limit (1 if even shares pass it).

    least and top are the tokens of the smallest and the largest source that has any.
    """
    if target_entropy is not None:
        good = lambda t: entropy(moments, t) >= target_entropy
        low, high = 0.0, 1.0
        if good(high):
            return high
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low
    limit = REPEATS if max_passes is None else max_passes
    good = lambda t: rate(moments, t, total, top) * (least / top) ** (t - 1) <= limit
    low, high = 0.0, 1.0
    if good(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def draw(seed: int, *keys: Column) -> Column:
    """60 bits of MD5 of the seed and the keys; other engines have the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def copies(docs: DataFrame, target_entropy: float | None = None, max_passes: float | None = None, total: float | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, block, copies) for each row of docs: how often the mix holds it."""
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("n_tokens"))
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"))
    sums = cut(sums)
    n_sources, least, top = sums.agg(F.count("*"), F.min(F.when(F.col("n") > 0, F.col("n"))), F.max("n")).head()
    top = top or 1
    moments = moments_of(r[0] for r in sums.select("n").collect()) if n_sources <= SOURCES else moments_by_aggregate(sums)
    t = exponent(moments, least or 1, top, target_entropy, max_passes, total)
    often = F.lit(rate(moments, t, total, top)) * F.pow(F.col("n") / F.lit(top), F.lit(t - 1))
    # rounded, so that a pass that is whole but for the last bits is whole
    k = F.round(F.when(F.col("n") > 0, often).otherwise(F.lit(1.0)), 9)
    plan = sums.select(F.col("source").alias("s0"), F.floor(k).cast("int").alias("whole"), F.round((k - F.floor(k)) * F.col("n"), 6).alias("rest"), F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("rows") / F.lit(BLOCK))).alias("blocks"))
    joined = sized.join(if_small(cut(plan)), sized["source"].eqNullSafe(F.col("s0")))
    dealt = cut(joined.select(*sized.columns, "whole", "rest", (draw(seed, F.col("doc_id")) % F.col("blocks")).cast("int").alias("block")))
    order = draw(seed + 1, F.col("source"), F.col("block"))
    blocks = dealt.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("size")).withColumn("order", order)
    # a source has one block for 256 documents; its running sum is over ranges of the order first, then within a range
    blocks = blocks.withColumn("range", F.shiftright("order", 50))
    ahead = blocks.groupBy("source", "range").agg(F.sum("size").alias("s")).select(F.col("source").alias("s0"), F.col("range").alias("r0"), F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.sum("size").over(Window.partitionBy("source", "range").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.withColumn("within", F.coalesce(within, F.lit(0))).join(ahead, F.col("source").eqNullSafe(F.col("s0")) & (F.col("range") == F.col("r0")))
    before = F.col("ahead") + F.col("within")
    state = placed.select(F.col("source").alias("s1"), F.col("block").alias("b1"), before.alias("before"), F.when(F.col("rest") <= 0, -1).when(before + F.col("size") <= F.col("rest"), 1).when(before < F.col("rest"), 0).otherwise(-1).alias("state"))
    with_state = cut(dealt.join(state, F.col("source").eqNullSafe(F.col("s1")) & (F.col("block") == F.col("b1"))).drop("s1", "b1"))
    edge = with_state.where("state = 0")
    run = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy(draw(seed + 2, F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("more", F.when(F.col("before") + run <= F.col("rest"), 1).otherwise(0))
    rest = with_state.where("state <> 0").withColumn("more", F.greatest("state", F.lit(0)))
    return edge.unionByName(rest).select("doc_id", "source", "n_tokens", "block", (F.col("whole") + F.col("more")).cast("int").alias("copies"))


def mix(docs: DataFrame, target_entropy: float | None = None, max_passes: float | None = None, total: float | None = None, seed: int = 0) -> DataFrame:
    """`copies` of the documents that the mix holds at least once."""
    return copies(docs, target_entropy, max_passes, total, seed).where("copies > 0")
