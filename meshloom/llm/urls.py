"""Filter lists over URLs by cascades of Bloom filters: exact membership of keys without joining the URLs to a list.

**Cascade.** Level 1 encodes the listed keys. Level 2 encodes those other keys of the corpus that level 1 takes for listed, level 3 the listed
keys that level 2 takes for others, and so on until nothing is mistaken. A key is judged by the first level that does not hold it: unlisted at
an odd level, listed at an even one; one that all levels hold is of the kind that the last level encodes. As the levels are built over all keys that
the corpus has, the answer is exact for each of them. Level 1 has 32 bits for each listed key and 8,192 at least, so that it mistakes about one in 40,000 of the corpus's keys, or for short
lists next to none; later levels have 9. A list of more than `SLICE` keys is parted by a hash of the key into slices with a cascade each. Levels are one-row tables that
the plan reads as scalar subqueries: 8 MB for each slice's first level, so executors hold 4 bytes for each listed key, however many URLs there are.

A URL's keys are its host's suffixes, from the whole host to the last label, each with the beginnings of its path that are as long as a
listed path. The longest listed key wins, of equal ones that with the longer host.

Edge cases: null URLs, empty ones and those without `://` have empty host and path and match no rule; an empty rule list allows all, an empty table of pages gives an empty result; repeated
pages each get a row; rules with null parts are ignored; a host and path that is both allowed and blocked (a tie) is blocked; extra columns are only carried along if `keep` names
them, and must not be called host, path, rule, verdict, _rid or _k then. A very long URL has a key for each label of its host and each listed path length.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.text import ascii_lower
from meshloom.plans.lineage import cut

#: hash functions of each level, bits for each key of the first and of later levels, least bits
HASHES, FIRST_BITS, BITS, LEAST_BITS = 6, 32, 9, 8192
#: keys of a cascade; a longer list is parted
SLICE = 2_000_000
#: path lengths that are looked at one by one
MANY = 100

#: one-row tables (bits array<bigint>) with their numbers of bits
Levels = list[tuple[DataFrame, int]]


def _bit(key: Column, level: int, i: int, m: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(m).cast("bigint"))


def encode(keys: DataFrame, level: int, n: int) -> tuple[DataFrame, int]:
    """The level's words of 64 bits, in one row, and its number of bits; its size is that of n keys."""
    m = max(LEAST_BITS, math.ceil(n * (FIRST_BITS if level == 1 else BITS) / 64) * 64)
    bits = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, i, m) for i in range(HASHES)])).alias("b"))
    some = bits.select(F.floor(F.col("b") / 64).alias("at"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("w"))
    zero = keys.sparkSession.range(m // 64).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("w"))
    words = some.unionByName(zero).groupBy("at").agg(F.bit_or("w").alias("w"))
    return cut(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("bits"))), m


def holds(level: tuple[DataFrame, int], number: int, key: Column) -> Column:
    table, m = level
    bits = table.scalar()
    test = F.lit(True)
    for i in range(HASHES):
        b = _bit(key, number, i, m)
        test = test & (F.getbit(F.get(bits, F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1)
    return test


def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("slice")), F.lit(slices).cast("bigint"))


def build(listed: DataFrame, universe: DataFrame) -> list[Levels]:
    """The levels of each slice for listed(key) over universe(key), in which keys may repeat."""
    keys = cut(listed.select("key").distinct())
    total = keys.count()
    slices = math.ceil(total / SLICE)
    out = []
    for j in range(slices):
        mine = _slice(F.col("key"), slices) == j
        own = cut(keys.where(mine)) if slices > 1 else keys
        n = own.count()
        levels = [encode(own, 1, n)]
        # only what level 1 mistakes is gathered
        other = cut(universe.select("key").where(mine & holds(levels[0], 1, F.col("key"))).distinct().join(own, "key", "left_anti"))
        while n := other.count():
            number = len(levels) + 1
            levels.append(encode(other, number, n))
            own, other = other, cut(own.where(holds(levels[-1], number, F.col("key"))))
        out.append(levels)
    return out


def member(cascades: list[Levels], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    found = F.lit(False)
    for j, levels in enumerate(cascades):
        answer = F.lit(len(levels) % 2 == 1)
        for number in range(len(levels), 0, -1):
            answer = F.when(~holds(levels[number - 1], number, key), F.lit(number % 2 == 0)).otherwise(answer)
        found = found | (answer & (_slice(key, len(cascades)) == j))
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or without `://`."""
    u = F.coalesce(url, F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Structs (n, host_length, key) of all keys, the longest first; lengths are those of listed paths, in order."""
    labels = F.split(host, "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if len(lengths) > MANY:  # all beginnings up to the longest: those of other lengths are not listed
        upto = F.least(F.length(path), F.lit(lengths[-1]))
        starts = F.when(upto > 0, F.transform(F.sequence(F.lit(1), upto), lambda n: path.substr(F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    else:
        starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]).cast("array<string>"), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.struct(F.length(F.concat(h, p)).alias("n"), F.length(h).alias("host_length"), F.concat(h, p).alias("key")))))
    return F.sort_array(pairs, asc=False)


def apply_rules(pages: DataFrame, rules: DataFrame, url_column: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns, host, path, rule (host and path of the longest rule that fits, or null) and verdict (its own, else allow) of each row.

    rules(host, path, verdict); a path must not be empty. Two cascades: which keys are rules, and which rules block.
    """
    clean = rules.where("host IS NOT NULL AND path <> '' AND verdict IN ('allow', 'block')").select(F.concat(ascii_lower(F.col("host")), F.col("path")).alias("key"), F.length("path").alias("n"), "verdict")
    clean = cut(clean)
    # at most as many as the longest listed path has characters
    lengths = sorted(r["n"] for r in clean.select("n").distinct().collect())
    host, path = host_and_path(F.col(url_column))
    parsed = pages.select(*keep, host.alias("host"), path.alias("path"))
    if not lengths:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    # a row for each page and one for each of its keys that is listed; the tests are plain expressions, compiled with the rest
    number = parsed.withColumn("_rid", F.monotonically_increasing_id())
    keys = keys_of(F.col("host"), F.col("path"), lengths)
    none = F.lit(None).cast("struct<n: int, host_length: int, key: string>")
    flat = number.select("*", F.explode(F.concat(F.array(none), keys)).alias("_k"))
    listed = build(clean, flat.where("_k IS NOT NULL").select("_k.key"))
    blocked = build(clean.where("verdict = 'block'"), clean)
    best = flat.where(F.col("_k").isNull() | member(listed, F.col("_k.key"))).groupBy("_rid", *keep, "host", "path").agg(F.max("_k").alias("_k"))
    rule = best.select(*keep, "host", "path", F.col("_k.key").alias("rule"))
    return rule.select("*", F.when(F.col("rule").isNotNull() & member(blocked, F.col("rule")), "block").otherwise("allow").alias("verdict"))
