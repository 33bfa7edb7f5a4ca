"""The registered queries of this subpackage; each runs its operator over whole tables."""

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: words of a text for the ASCII white space of this module
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op4_overlap_tokens(spark, sf_dir):
    """Tokens of every document by the word vocabulary."""
    import public_tokenizers

    from meshloom.llm.tokens import count_tokens

    got = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.withColumn("over_limit", F.col("n_tokens") > 2048)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _rules_sql() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    host = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"
    return f"""WITH r(h, p, v) AS (VALUES {values}), u AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
    d AS (SELECT DISTINCT host, path FROM u),
    f AS (SELECT host, path, arg_max(struct_pack(rule := h || p, verdict := v), length(h) * 1000 + length(p) * 1000 + length(h)) AS best FROM d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
    SELECT page_id, u.host, u.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN f ON u.host = f.host AND u.path = f.path"""


@query(_rules_sql())
def op6_url_cascade(spark, sf_dir):
    """Rules over every page's URL."""
    from meshloom.llm.urls import apply_rules

    return apply_rules(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def _near_sql() -> str:
    w = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {w} AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM d WHERE len(w) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
    reach(v, u) AS (SELECT doc_id, doc_id FROM documents UNION SELECT v, b FROM reach JOIN e ON a = u)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(u) AS c FROM reach GROUP BY v) USING (doc_id)"""


@query(_near_sql())
def op7_superminhash(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    from meshloom.llm.neardup import groups

    return groups(read(spark, sf_dir, "documents"))


def _lines_sql(docs: str = "documents") -> str:
    h = "CAST(('0x' || substr(md5(line), 1, 7)) AS BIGINT)"
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) - 1 AS last FROM {docs} WHERE text <> ''),
    h AS (SELECT *, ({h} + 31 * coalesce(lag({h}) OVER w, 0) + 961 * coalesce(lag({h}, 2) OVER w, 0)) % 2147483647 AS r FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    b AS (SELECT *, CASE WHEN i = last OR i > 0 AND i < last - 1 AND r < lag(r) OVER w AND r <= lead(r) OVER w THEN 1 ELSE 0 END AS stop FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    c AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM b),
    k AS (SELECT doc_id, pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY ALL),
    m AS (SELECT *, n >= 2 AND length(trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0 AND row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) > 1 AS gone FROM k)"""


def _lines_report_sql() -> str:
    return f"""{_lines_sql()} SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(r, 0) AS n_removed_lines, sha256(coalesce(t, '')) AS kept_sha256 FROM (SELECT doc_id FROM documents) LEFT JOIN
    (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS r, string_agg(body, chr(10) ORDER BY pos) FILTER (NOT gone) AS t FROM m GROUP BY doc_id) USING (doc_id)"""


@query(_lines_report_sql())
def op8_line_chunks(spark, sf_dir):
    """Lines cut from each document, and a digest of what stays (null: of the empty text)."""
    from meshloom.llm.lines import dedup_report

    got = dedup_report(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _contamination_sql() -> str:
    def words(table, key):
        return f"SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {table}"

    return f"""WITH d AS MATERIALIZED ({words('documents', 'doc_id')}), b AS MATERIALIZED ({words('benchmark', 'item_id')}),
    wb AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 12), ' '))) AS k FROM b WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM wb),
    wd AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS k FROM d, sizes WHERE len(w) >= n),
    m AS MATERIALIZED (SELECT doc_id, i, wd.n, item_id FROM wd JOIN wb ON wd.k = wb.k AND wd.n = wb.n),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query(_contamination_sql())
def op9_positional_index(spark, sf_dir):
    """Benchmark windows in every document."""
    from meshloom.llm.decontam import contamination

    got = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def _quality_sql(docs: str = "documents") -> str:
    """CTEs: f has the counts, bad the documents that a calibrated rule rejects."""
    from meshloom.llm import quality as q

    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    count = lambda chars: f"CAST(length(t) - length(translate(t, '{chars}', '')) AS BIGINT)"
    grid = ", ".join(f"({i}, CAST({c} AS DOUBLE))" for i, c in enumerate(q.GRID))
    rules = " UNION ALL ".join(f"SELECT *, '{r}' AS rule, coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0) AS x FROM f" for r, (a, b) in q.RULES.items())
    tail = f"CASE WHEN k_good >= n_good * CAST({q.ALPHA} AS DOUBLE) THEN 1.0 ELSE list_sum(list_transform(range(0, k_good + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({q.ALPHA}) + (n_good - j) * ln(1 - {q.ALPHA})))) END"
    return f"""WITH t AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {docs}),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS k FROM t WHERE len(w) >= 5)) WHERE c > 1) GROUP BY doc_id),
    ls AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: length(trim(x, {white})) > 0) AS l FROM t),
    f AS MATERIALIZED (SELECT t.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {count('#*$%&|<>')} AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, {count('!')} AS n_shouts FROM t JOIN ls USING (doc_id) LEFT JOIN rep USING (doc_id)),
    v AS MATERIALIZED ({rules}), g(step, cutoff) AS (VALUES {grid}),
    y AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
    lab AS MATERIALIZED (SELECT v.*, quality, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS half FROM v JOIN y USING (doc_id) WHERE quality IN (0, 1)),
    z AS (SELECT stratum, rule, step, sum(quality) AS n_good, sum(1 - quality) AS n_bad, sum(CASE WHEN x > cutoff THEN quality ELSE 0 END) AS k_good, sum(CASE WHEN x > cutoff THEN 1 - quality ELSE 0 END) AS k_bad FROM lab, g WHERE half GROUP BY ALL),
    stops AS MATERIALIZED (SELECT stratum, rule, arg_max(step, struct_pack(g := round(gain, 9), m := -step)) AS stop FROM (SELECT *, coalesce(k_bad / nullif(n_bad, 0), 0) - coalesce(k_good / nullif(n_good, 0), 0) AS gain FROM z WHERE k_good * {len(q.RULES)} <= CAST({q.ALPHA} AS DOUBLE) * n_good) WHERE round(gain, 9) > 0 GROUP BY ALL),
    cuts AS MATERIALIZED (SELECT stratum, rule, g.step, c.cutoff FROM stops, g JOIN g c ON c.step = least(g.step, stop)),
    hit AS (SELECT DISTINCT doc_id, step FROM lab JOIN cuts USING (stratum, rule) WHERE NOT half AND x > cuts.cutoff),
    hold AS (SELECT DISTINCT doc_id, stratum, quality FROM lab WHERE NOT half),
    k AS (SELECT h.stratum, g.step, CAST(sum(quality) AS BIGINT) AS n_good, CAST(sum(CASE WHEN hit.doc_id IS NOT NULL THEN quality ELSE 0 END) AS BIGINT) AS k_good FROM hold h CROSS JOIN g LEFT JOIN hit ON hit.doc_id = h.doc_id AND hit.step = g.step WHERE h.stratum IN (SELECT stratum FROM stops) GROUP BY ALL),
    passed AS (SELECT *, sum(CASE WHEN {tail} <= CAST({q.DELTA} AS DOUBLE) / (SELECT count(DISTINCT stratum) FROM lab) THEN 0 ELSE 1 END) OVER (PARTITION BY stratum ORDER BY step) AS failures FROM k),
    held AS (SELECT stratum, max(step) AS step FROM passed WHERE failures = 0 GROUP BY stratum),
    bad AS (SELECT DISTINCT doc_id FROM v JOIN held USING (stratum) JOIN cuts USING (stratum, rule, step) WHERE x > cuts.cutoff)"""


QUALITY_KEPT = "NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad)"


def _quality_report_sql() -> str:
    return f"{_quality_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {QUALITY_KEPT} AS kept FROM f"


@query(_quality_report_sql())
def op10_risk_thresholds(spark, sf_dir):
    """Counts and verdict of every document."""
    from meshloom.llm.quality import BASE, judge

    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept")


def _mix_sql() -> str:
    """The exponent in closed form: at the limit, the smallest source is passed over exactly four times."""
    draw = lambda *keys: f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 15) AS BIGINT)"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS n_tokens FROM documents),
    s AS (SELECT source, sum(n_tokens) AS n, count(*) AS docs FROM d GROUP BY source),
    e AS (SELECT max(n) AS top, greatest(0, 1 - ln(4) / nullif(ln(max(n) / min(n)), 0)) AS t FROM s WHERE n > 0),
    a AS (SELECT source, n, docs, round(power(top / n, 1 - coalesce(t, 0)), 9) AS k FROM s, e),
    p AS MATERIALIZED (SELECT source, CAST(floor(k) AS INT) AS whole, round((k - floor(k)) * n, 6) AS rest, greatest(1, docs // 256) AS blocks FROM a),
    x AS MATERIALIZED (SELECT d.*, whole, rest, CAST({draw("'0'", "CAST(doc_id AS VARCHAR)")} % blocks AS INT) AS block FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
    b AS (SELECT source, block, sum(n_tokens) AS size, {draw("'1'", "source", "CAST(block AS VARCHAR)")} AS o FROM x GROUP BY source, block),
    c AS (SELECT source, block, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
    r AS (SELECT x.*, size, before, sum(n_tokens) OVER (PARTITION BY x.source, x.block ORDER BY {draw("'2'", "CAST(doc_id AS VARCHAR)")}, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM x JOIN c ON x.source IS NOT DISTINCT FROM c.source AND x.block = c.block)
    SELECT doc_id, source, n_tokens, block, CAST(whole + CASE WHEN rest <= 0 THEN 0 WHEN before + size <= rest THEN 1 WHEN before < rest AND before + run <= rest THEN 1 ELSE 0 END AS INT) AS copies FROM r"""


@query(_mix_sql())
def op1_temperature_mix(spark, sf_dir):
    """How often the mix holds each document, at the smallest temperature exponent that repeats no source more than four times."""
    from meshloom.llm.mixing import copies

    return copies(read(spark, sf_dir, "documents"))


@query()
def op2_crf_language(spark, sf_dir):
    """The language of every document, learned from those whose checksum is not 2 modulo 4."""
    from meshloom.llm.langid import predict, train

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    return predict(docs.drop("lang"), train(docs.where("NOT held_out")), ("doc_id", "held_out"))


def _repeats_sql() -> str:
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
    k AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(list_slice(w, i, i + 49), ' ')))) AS k FROM d WHERE len(w) >= 50),
    f AS (SELECT k, min(doc_id) AS f FROM k GROUP BY k),
    g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (k) WHERE f < doc_id),
    r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
    t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM x ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query(_repeats_sql())
def op3_de_bruijn(spark, sf_dir):
    """What is left of each document without passages of 50 words that an earlier one has."""
    from meshloom.llm.substrings import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


@query()
def op5_ppm_score(spark, sf_dir):
    """Scores of every document, learned from those whose checksum is not 2 modulo 7."""
    from meshloom.llm.ppm import score

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(read(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out")))
