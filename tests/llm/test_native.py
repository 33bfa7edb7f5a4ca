"""Edge cases and brute-force versions of the operators that stay in the JVM, and of mixing."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from meshloom.llm import decontam, joins, lines, mixing, quality, urls
from meshloom.llm.queries import RULES

LOWER = {c: c + 32 for c in range(65, 91)}


def alnum(t):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER)) if w]


def contamination(docs, items):
    wins = {}
    for i, t in items:
        w = alnum(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 12)):
                wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = set()
    for d, t in docs:
        w = alnum(t)
        hit, found = set(), set()
        if d is not None:
            for n in {len(x) for x in wins}:
                for k in range(len(w) - n + 1):
                    if (x := tuple(w[k : k + n])) in wins:
                        hit |= set(range(k, k + n))
                        found |= wins[x]
        out.add((d, len(w), len(hit), ",".join(sorted(map(str, found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def rows(df):
    return {(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in df.collect()}


@pytest.mark.parametrize("limit", [0, joins.BROADCAST_BYTES])
def test_contamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 5, 12, 13, 14, 30]))) for i in range(12)] + [(20, None), (21, "?!"), (22, ""), (None, text(13)), (23, "É été 13"), (24, "the the the the the the the the the the the the the the")]
    docs = [(i, f"{text(rng.randint(0, 60))}. {rng.choice(items)[1] or ''}-{text(rng.randint(0, 200))}".upper()) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "été 13 É été 13"), (103, "the " * 40), (103, "the " * 40), (104, items[5][1]), (104, f"a b {items[6][1]}"), (None, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS term", "'x' AS w", "2 AS pos", "3 AS n_hit")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS doc_id")
    assert rows(decontam.contamination(d, b)) == contamination(docs, items)
    clean = decontam.clean(d, b)
    assert clean.columns == d.columns
    bad = {x[0] for x in contamination(docs, items) if x[4] and x[0] != 104}
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == sorted((i or 0, t or "") for i, t in docs if i not in bad and (i != 104 or not next(iter(contamination([(i, t)], items)))[4]))


def test_contamination_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontam.contamination(d, b)) == {(1, 3, 0, "", False)} and decontam.contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta y gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "gamma alpha beta")], "item_id long, text string")
    assert {(r.item_id, r.doc_id) for r in decontam.proximity_matches(d, b, slop=6).collect()} == {(7, 1)}


def judged(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2] if best else None, best[3] if best else "allow")


def test_rules_equal_brute_force(spark):
    rng = random.Random(3)
    many = [(".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))), rng.choice(["/", "/x/", "/x/y", "/z"]), rng.choice(["allow", "block"])) for _ in range(40)]
    many = [(h, p, dict(((a, b), v) for a, b, v in many)[h, p]) for h, p in sorted({(a, b) for a, b, _ in many})]
    pages = [f"{rng.choice(['http', 'https'])}://{'.'.join(rng.choice('abcd') for _ in range(rng.randint(1, 4)))}{rng.choice(['', '/', '/x', '/x/', '/x/y/w', '/z?q', '?/x/', '#/z'])}" for _ in range(3000)]
    pages += [None, "", "no scheme", "://", "http://WWW.Example.COM/en/a", "https://net/fr/", "http://a.net/fr/x?y", "http://example.com/en", "x://y\n.net/es/://z", "http://münchen.com/ß"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string").selectExpr("*", "1 AS key", "2 AS rule", "3 AS host")
    for rules in (RULES, many, []):
        got = urls.apply_rules(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
        assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {(i, *judged(u, rules)) for i, u in enumerate(pages)}


@pytest.mark.parametrize("slices", [1, 3])
def test_cascade_is_exact(spark, monkeypatch, slices):
    from pyspark.sql import functions as F

    monkeypatch.setattr(urls, "FIRST_BITS", 9)
    monkeypatch.setattr(urls, "LEAST_BITS", 64)
    universe = spark.range(20000).selectExpr("CAST(id AS STRING) AS key")
    listed = universe.where("key % 7 = 0")
    monkeypatch.setattr(urls, "SLICE", 3000 // slices)
    cascades = urls.build(listed, universe)
    assert len(cascades) == slices and all(len(levels) > 2 for levels in cascades)
    wrong = universe.where(urls.member(cascades, F.col("key")) != (F.col("key").cast("int") % 7 == 0))
    assert wrong.count() == 0


def test_many_path_lengths_and_no_pages(spark, monkeypatch):
    rules = [("a.com", "/" + "x" * i, "block") for i in range(0, 40, 3)]
    pages = [(i, f"http://www.a.com/{'x' * i}") for i in range(0, 50, 7)] + [(99, "http://a.com")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    for many in (100, 5):
        monkeypatch.setattr(urls, "MANY", many)
        assert {(x.page_id, x.host, x.path, x.rule, x.verdict) for x in urls.apply_rules(df, r).collect()} == {(i, *judged(u, rules)) for i, u in pages}
    assert urls.apply_rules(df.limit(0), r).count() == 0


def repeats(t):
    w = [x.decode() for x in (t or "").encode().split()]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    ls = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(ls) - len(set(ls)), len(hit))


def test_features_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x " * 500, "É ### <b>|é\x0bü\n\n  \nq\nq\n" * 3, "one two three four five six " * 3 + "|" * 5]
    texts += [" ".join(rng.choice("abc") + rng.choice(["", "\n", "$"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").selectExpr("*", "1 AS w", "2 AS l", "3 AS n_words")
    got = {r.doc_id: tuple(r[c] for c in quality.BASE) for r in quality.features(df).collect()}
    assert got == {i: repeats(t) for i, t in enumerate(texts)}


def test_tail_is_binomial(spark):
    from pyspark.sql import functions as F

    for n, k, a in ((500, 0, 0.01), (1000, 4, 0.01), (3000, 20, 0.01), (10, 3, 0.5)):
        want = sum(math.comb(n, j) * a**j * (1 - a) ** (n - j) for j in range(k + 1)) if k < n * a else 1.0
        got = spark.range(1).select(quality.tail(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), a)).head()[0]
        assert got == pytest.approx(want, rel=1e-9)


def plan(rows, alpha=quality.ALPHA, delta=quality.DELTA):
    """Cutoffs of (doc_id, lang, quality, values by rule) in plain Python."""
    strata = {lang or "" for _, lang, _, _ in rows}
    out = {}
    for s in strata:
        own = [r for r in rows if (r[1] or "") == s]
        half = [r for r in own if hashlib.md5(str(r[0]).encode()).hexdigest()[0] < "8"]
        hold = [r for r in own if r not in half]
        good, bad = [r for r in half if r[2]], [r for r in half if not r[2]]
        stops = {}
        for rule in quality.RULES:
            best = (0, None)
            for i, c in enumerate(quality.GRID):
                k = sum(r[3][rule] > c for r in good)
                gain = round(sum(r[3][rule] > c for r in bad) / max(1, len(bad)) - k / max(1, len(good)), 9)
                if k * len(quality.RULES) <= alpha * len(good) and gain > best[0]:
                    best = (gain, i)
            if best[1] is not None:
                stops[rule] = best[1]
        last = None
        n = sum(r[2] for r in hold)
        for i in range(len(quality.GRID) if stops else 0):
            k = sum(any(r[3][rule] > quality.GRID[min(i, j)] for rule, j in stops.items()) for r in hold if r[2])
            if k >= n * alpha or sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) > delta / len(strata):
                break
            last = i
        if last is not None:
            out[s] = {rule: quality.GRID[min(last, stops[rule])] if rule in stops else None for rule in quality.RULES}
    return out


def test_cutoffs_equal_brute_force_and_keep_the_bound(spark):
    """Bad documents shout and hold symbols; good ones rarely; a small stratum proves nothing and rejects nothing."""
    rng = random.Random(6)
    rows = []
    for lang, n_good, n_bad, shout in (("en", 3000, 300, 0.002), ("fr", 60, 20, 0.0), (None, 2000, 200, 0.0), ("de", 2500, 300, 0.05)):
        for q, n in ((1, n_good), (0, n_bad)):
            for _ in range(n):
                loud = rng.random() < (shout if q else 0.7)
                values = {r: 0.0 for r in quality.RULES} | {"shouts": rng.choice([3, 7, 30]) / 100 if loud else 0.0, "symbols": rng.choice([0, 4, 20, 45]) / 500 if not q or rng.random() < 0.001 else 0.0}
                rows.append((len(rows), lang, q, values))
    df = spark.createDataFrame([(i, lang, q, round(v["shouts"] * 100), round(v["symbols"] * 500)) for i, lang, q, v in rows], "doc_id long, lang string, quality int, n_shouts long, n_symbols long").selectExpr("*", "100L AS n_words", "500L AS word_chars", "0L AS n_dup_lines", "10L AS n_lines", "0L AS n_repeat_words")
    got = {r.stratum: {rule: r[rule] for rule in quality.RULES} for r in quality.calibrate(df).collect()}
    assert got == plan(rows)
    assert set(got) >= {"en", ""} and "fr" not in got and got["en"]["shouts"] and got["en"]["symbols"]
    for s, cutoffs in got.items():
        own = [r for r in rows if (r[1] or "") == s and r[2]]
        assert sum(any(c is not None and r[3][rule] > c for rule, c in cutoffs.items()) for r in own) <= quality.ALPHA * len(own)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "a " * 40, "en"), (2, "a " * 40, "en"), (None, "b c d e f g h i j k l", "en")], "doc_id long, text string, lang string").selectExpr("*", "'s' AS kept", "1 AS whole_row")
    labels = spark.createDataFrame([(2, None), (2, 1), (None, 1)], "doc_id long, quality int").selectExpr("*", "0 AS toxic")
    got = [(r.doc_id, r.base_failed, r.kept) for r in quality.judge(docs, labels).collect()]
    assert sorted(got, key=str) == sorted([(1, True, False), (2, True, False), (2, True, False), (None, False, True)], key=str)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [None]
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_line_edges(spark):
    block = "\n".join(f"line {i} of a passage" for i in range(40))
    docs = [(1, f"alpha\n{block}\nomega"), (2, f"{block}"), (3, f"x\ny\n{block}\nz"), (4, None), (5, ""), (6, "\n\n\n\n\n"), (7, "\n\n\n\n\n"), (None, block), (2, f"{block}"), (8, "same line"), (9, "same line")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 AS n_chars", "'q' AS cut_chunks", "1 AS h", "2 AS body")
    out = lines.remove_repeated(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[1] == [docs[0][1]] and got[8] == got[9] == ["same line"] and got[None] == [block] and got[4] == [None] and got[5] == [""] and got[6] == got[7] == ["\n\n\n\n\n"]
    assert len("".join(got[3])) < 0.5 * len(docs[2][1]) and got[3][0].startswith("x\n") and got[3][0].endswith("z")
    assert all(len(t) < 0.5 * len(block) for t in got.get(2, []))
    assert lines.remove_repeated(df.limit(0)).count() == 0
    report = {(r.doc_id, r.n_lines, r.n_removed_lines) for r in lines.dedup_report(df).collect()}
    assert (4, 0, 0) in report and (5, 0, 0) in report and (1, 42, 0) in report


def passes(tokens, t, total=None):
    """How often each source is passed over at an exponent, in plain Python."""
    top = max(tokens.values())
    raw = {s: (n / top) ** t for s, n in tokens.items() if n}
    z = math.fsum(raw.values())
    per = {s: w / z / tokens[s] for s, w in raw.items()}
    scale = total if total is not None else 1 / min(per.values())
    return {s: per[s] * scale if n else 1.0 for s, n in tokens.items()}


def exponent(tokens, **more):
    some = [n for n in tokens.values() if n]
    return mixing.exponent(mixing.moments_of(tokens.values()), min(some, default=1), max(some, default=1), **more)


def test_exponent_meets_its_target():
    tokens = {"a": 10_000, "b": 1000, "c": 100, "d": 0}
    got = passes(tokens, exponent(tokens, max_passes=4.0))
    assert max(got.values()) == pytest.approx(4.0) and min(v for k, v in got.items() if k != "d") == pytest.approx(1.0)
    moments = mixing.moments_of(tokens.values())
    for target in (0.5, 0.9, 1.05):
        t = exponent(tokens, target_entropy=target)
        w = [n**t for n in (10_000, 1000, 100)]
        assert mixing.entropy(moments, t) == pytest.approx(target) == -math.fsum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert exponent({"a": 5}) == 0.0 and exponent({}) == 0.0


@pytest.mark.parametrize(("more", "sources"), [({}, 10), ({"max_passes": 2.5}, 0), ({"target_entropy": 1.0}, 10), ({"total": 5000.0}, 10), ({"total": 90_000.0, "max_passes": 3.0}, 10)])
def test_budgets_are_met(spark, more, sources, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "SOURCES", sources)
    rng = random.Random(4)
    docs = [(i, rng.choice(["hot"] * 6 + ["b", "c", None, ""]), rng.randint(0, 30)) for i in range(900)]
    df = spark.createDataFrame([(i, "w " * n if n else None, s) for i, s, n in docs], "doc_id long, text string, source string").selectExpr("*", "1 AS n", "2 AS block", "3 AS rest")
    got = mixing.copies(df, **more).collect()
    tokens = Counter()
    for _, s, n in docs:
        tokens[s] += n
    often = passes(tokens, exponent(tokens, **more), more.get("total"))
    assert len(got) == len(docs)
    for s in tokens:
        own = [r for r in got if r.source == s]
        whole = int(round(often[s], 9))
        assert {r.copies for r in own} <= {whole, whole + 1}
        used, budget = sum(r.copies * r.n_tokens for r in own), often[s] * tokens[s]
        assert used <= budget + 1e-3 and used > budget - 31 * 2
    again = mixing.copies(df.repartition(5), **more).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in got}


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, None, None)], "doc_id long, text string, source string")
    assert sorted((str(r.doc_id), r.copies) for r in mixing.copies(df).collect()) == [("1", 1), ("1", 1), ("None", 1)]
    assert mixing.mix(df.limit(0)).count() == 0
