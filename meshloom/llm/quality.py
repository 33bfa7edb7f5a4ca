"""Quality rules whose cutoffs are chosen on labelled documents with a bound on false rejections.

**Guarantee.** For every stratum (language), the chance that the rules together reject a good document of that stratum is at most `alpha`, and these statements hold for
all strata at once with confidence 1 - `delta`. **Path.** One half of the labelled documents, by a hash of their id, proposes: for each stratum and rule the cutoff of a fixed
grid with the largest share of rejected bad documents less that of good ones, among those that reject at most alpha / rules of the good ones; the mildest of equals; a rule without gain is not
used. **Holdout.** The other half decides. Step i of the path rejects what is above the i-th cutoff of the grid by any rule, where a rule stops at the cutoff proposed for
it; so each step rejects all that the one before does. With k of n good documents of the holdout rejected, a step passes if P(Bin(n, alpha) <= k) <= delta / strata, which is the
Clopper-Pearson upper bound at most alpha. Steps are tested from the mildest on and testing stops at the first failure, so that the path costs no further correction, and strata
are corrected for by Bonferroni. The last step that passed holds. Where none passes, as with few labels, no rule rejects.

Edge cases: null and empty texts have no words (and fail the base rule); null language is a stratum of its own; labels of null quality are
ignored, a document labelled twice counts as bad if either label says so; if one id has several texts, its label is that of each; rows that repeat a document count each; equal gains
(ties) go to the milder cutoff; empty tables give empty results, and without labels only the base rule rejects; columns besides the named ones are not looked at and
carried along whatever their names. A very long text is one row of arrays: memory is a few dozen times its words.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshloom.llm.joins import if_small, small
from meshloom.llm.text import WHITE, fresh, let, words
from meshloom.plans.lineage import cut

ALPHA, DELTA = 0.02, 0.05
#: from the mildest cutoff to the strictest; a rule rejects values above its cutoff
GRID = [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01]
#: ratios: numerator and denominator
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "shouts": ("n_shouts", "n_words")}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SPAN = 5


def repeated(w: Column) -> Column:
    """Words in windows of five that occur twice or more in the array."""
    at = F.sequence(F.lit(0), F.size(w) - SPAN)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SPAN)]))

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["k"] == x["k"], F.lit(False))
        places = F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(SPAN), F.coalesce(F.get(p, j + 1) - x, F.lit(SPAN)))), F.lit(0), lambda a, x: a + x))

    exact = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(SPAN)]).alias("k"), i.alias("i"))))
    # equal windows have equal hashes: where all hashes differ, nothing repeats, and the exact comparison is needless
    return F.when(F.size(w) <= SPAN, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(exact, covered))))


def _count(text: Column, chars: str) -> Column:
    pattern = "[" + "".join("\\" + c for c in chars) + "]"
    return F.when(text.rlike(pattern), F.length(text) - F.length(F.translate(text, chars, ""))).otherwise(F.lit(0))


def features(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The kept columns and the counts that rules use, a row for each row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    by_word = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), repeated(w).alias("r")))
    got = docs.select(*keep, by_word.alias("w"), lines.alias("l"), _count(text, "#*$%&|<>").alias("n_symbols"), _count(text, "!").alias("n_shouts"))
    long = lambda c: F.col(c).cast("bigint")
    return got.select(*keep, long("w.n").alias("n_words"), long("w.c").alias("word_chars"), long("n_symbols").alias("n_symbols"), long("l.d").alias("n_dup_lines"), long("w.r").alias("n_repeat_words"), long("l.n").alias("n_lines"), long("n_shouts").alias("n_shouts"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _value(rule: str) -> Column:
    a, b = RULES[rule]
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), summed exactly from logarithms of the terms; 1 from the mean on, where no test can pass."""
    odds = math.log(alpha) - math.log1p(-alpha)
    first = n * F.lit(math.log1p(-alpha))
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))

    def add(s, j):
        term = s["term"] + F.log((n - j + 1) / j) + F.lit(odds)
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    some = F.aggregate(F.sequence(F.lit(1).cast("bigint"), k), start, add, lambda s: s["sum"])
    return F.when(k >= n * F.lit(alpha), F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(some)


def _step(rule: str) -> Column:
    """The place in the grid of the first cutoff that the value is above, or the grid's length."""
    return F.lit(len(GRID)) - sum((F.when(_value(rule) > c, 1).otherwise(0) for c in GRID[1:]), F.when(_value(rule) > GRID[0], 1).otherwise(0))


def _upto(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step, n_good, n_bad, k_good, k_bad) for each step of the grid, from (keys, step, good, bad): documents in all and those rejected."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("step")
    sums = counts.groupBy(*keys).agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    here = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    at = sums.select("*", steps).join(counts, [*keys, "step"], "left")
    return at.select(*keys, "step", "n_good", "n_bad", F.coalesce(F.sum("good").over(here), F.lit(0)).alias("k_good"), F.coalesce(F.sum("bad").over(here), F.lit(0)).alias("k_bad"))


def _proposed(counts: DataFrame, alpha: float) -> DataFrame:
    """(stratum, and for each rule the step at which it stops, -1 if it is not used) from (stratum, rule, step, good, bad) of the half that proposes."""
    good = F.coalesce(F.try_divide(F.col("k_good"), F.col("n_good")), F.lit(0.0))
    gain = F.round(F.coalesce(F.try_divide(F.col("k_bad"), F.col("n_bad")), F.lit(0.0)) - good, 9)
    allowed = _upto(counts, ["stratum", "rule"]).where(F.col("k_good") * len(RULES) <= F.lit(alpha) * F.col("n_good")).withColumn("gain", gain).where("gain > 0")
    best = allowed.groupBy("stratum", "rule").agg(F.max_by("step", F.struct("gain", (-F.col("step")).alias("mild"))).alias("stop"))
    wide = best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("stop"))
    return wide.select("stratum", *[F.coalesce(r, F.lit(-1)).alias(r) for r in RULES])


def calibrate(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, and for each rule its cutoff or null) from rows of features with doc_id, lang and quality (1 good, 0 bad).

    One pass finds the steps of the labelled documents; everything after works on counts by stratum and step.
    """
    first_half = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8"
    rows = cut(labelled.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.coalesce("lang", F.lit("")).alias("stratum"), "quality", first_half.alias("half"), *[_step(r).alias(r) for r in RULES]))
    sums = (F.sum("quality").cast("bigint").alias("good"), F.sum(1 - F.col("quality")).cast("bigint").alias("bad"))
    by_rule = rows.where("half").select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])).alias("s"))
    stops = cut(_proposed(cut(by_rule.groupBy("stratum", "s.rule", "s.step").agg(*sums)), alpha)).withColumnsRenamed({r: f"stop_{r}" for r in RULES})
    strata = max(1, rows.select("stratum").distinct().count())

    # the first step of the path that rejects a document of the holdout
    joint = F.least(*[F.when(F.col(r) <= F.col(f"stop_{r}"), F.col(r)).otherwise(F.lit(len(GRID))) for r in RULES])
    holdout = rows.where("NOT half").join(if_small(stops), "stratum").groupBy("stratum", joint.alias("step")).agg(*sums)
    tested = _upto(cut(holdout), ["stratum"]).withColumn("fails", F.when(tail(F.col("n_good"), F.col("k_good"), alpha) <= F.lit(delta / strata), 0).otherwise(1))
    here = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    last = tested.withColumn("failures", F.sum("fails").over(here)).where("failures = 0").groupBy("stratum").agg(F.max("step").alias("last"))
    cutoff = lambda r: F.when(F.col(f"stop_{r}") >= 0, F.get(F.array(*[F.lit(c) for c in GRID]), F.least("last", f"stop_{r}")))
    return last.join(stops, "stratum").select("stratum", *[cutoff(r).alias(r) for r in RULES])


def labels_of(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def verdict(feats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    mine = cut(cutoffs).select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in RULES])
    joined = feats.withColumn("_at", F.coalesce("lang", F.lit(""))).join(if_small(mine), F.col("_at") == F.col("_stratum"), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(_value(r) > F.col(f"_{r}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_at", "_stratum", *[f"_{r}" for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Features and verdicts of all documents: texts are read once, their counts kept in shared storage."""
    feats = cut(features(docs))
    cutoffs = calibrate(feats.join(labels_of(labels), "doc_id"), alpha, delta)
    return verdict(feats, cutoffs)


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the rules keep, with their columns. Texts are not shuffled: those with labels are read for the cutoffs, and all for the verdict."""
    known = cut(labels_of(labels))
    own = docs.select("doc_id", "text", "lang")
    # labels that can travel pick their documents first; else the features of all documents, which are narrow, go to the labels
    some = own.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi") if small(known) else own
    cutoffs = calibrate(features(some).join(known, "doc_id"), alpha, delta)
    whole = fresh(docs, "whole_row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), "text", "lang")
    return verdict(features(packed, keep=(whole, "lang")), cutoffs).where("kept").select(*[F.col(whole)[c].alias(c) for c in docs.columns])
