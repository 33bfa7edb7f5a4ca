"""Registered graph and matrix queries with their SQL. Each takes (spark, sf_dir) and runs over whole tables."""

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions import scalars
from meshloom.functions.hashing import uniform_sql
from meshloom.operators import blocks, brain, generate, linalg, matrix
from meshloom.plans import lineage, rank
from meshloom.sources import brain_json, vectors
from meshloom.sources import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split("\n"))
        return f

    return add


def rounded(df: DataFrame, digits: int = 10, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns or ("value",)})


N = 25  # nations
S = t.SQL


# structure of the supplier-part matrix


@query(S["pairs"])
def coo_edges(spark, d):
    return t.supplier_part_pairs(spark, d)


@query(f"SELECT col AS row, row AS col, value FROM ({S['pairs']})")
def edge_transpose(spark, d):
    return matrix.transpose(t.supplier_part_pairs(spark, d))


@query(f"SELECT row AS idx, count(*) AS nnz FROM ({S['pairs']}) GROUP BY row")
def nnz_rows(spark, d):
    return matrix.nnz_rows(t.supplier_part_pairs(spark, d))


@query(f"SELECT col AS idx, count(*) AS nnz FROM ({S['pairs']}) GROUP BY col")
def nnz_columns(spark, d):
    return matrix.nnz_columns(t.supplier_part_pairs(spark, d))


@query(f"SELECT i AS idx, count(row) AS nnz FROM range({N}) r(i) LEFT JOIN ({S['trade']}) ON row = i GROUP BY i")
def nnz_rows_all(spark, d):
    return matrix.nnz_rows(t.nation_trade(spark, d), N)


@query(f"SELECT count(*) AS nnz FROM ({S['trade']}) WHERE row = 7")
def nnz_one_row(spark, d):
    return matrix.nnz_row(t.nation_trade(spark, d), 7)


@query(f"SELECT count(*) AS nnz FROM ({S['pairs']})")
def total_nnz(spark, d):
    return t.supplier_part_pairs(spark, d).agg(F.count("*").alias("nnz"))


@query(f"SELECT count(*) AS nnz, round(count(*) * 100.0 / ((SELECT count(*) FROM supplier) * (SELECT count(*) FROM part)), 10) AS pct FROM ({S['pairs']})")
def density(spark, d):
    n, m = t.table(spark, d, "supplier").count(), t.table(spark, d, "part").count()
    return rounded(matrix.density(t.supplier_part_pairs(spark, d), n, m), 10, "pct")


@query(f"SELECT row // 10 AS block_row, col // 100 AS block_col, count(*) AS nnz FROM ({S['pairs']}) GROUP BY ALL")
def nnz_per_block(spark, d):
    return blocks.nnz_per_block(t.supplier_part_pairs(spark, d), 10, 100)


@query(f"SELECT i AS row, CAST(coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY i) AS BIGINT) AS \"end\" FROM (SELECT i, count(row) AS n FROM range({N}) r(i) LEFT JOIN ({S['trade']}) ON row = i GROUP BY i)")
def csr_row_ptr(spark, d):
    return matrix.row_pointers(t.nation_trade(spark, d), N)


@query(f"SELECT row, array_to_string(list(col ORDER BY col), ',') AS cols, array_to_string(list(value ORDER BY col), ',') AS vals FROM ({S['trade']}) GROUP BY row")
def csr_arrays(spark, d):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return matrix.csr_arrays(t.nation_trade(spark, d)).select("row", join("cols"), join("vals"))


def _probes(spark):
    return spark.range(30).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(-1).cast("bigint"), F.lit(26).cast("bigint"))).alias("col"))


PROBES = "SELECT i AS row, j AS col FROM range(30) a(i), range(-1, 27) b(j)"
OUTSIDE = f"p.row < 0 OR p.row >= {N} OR p.col < 0 OR p.col >= {N}"
SPARSE = f"SELECT row, col, value FROM ({S['sparse']})"


def _sparse(spark, d, value: str = "value") -> DataFrame:
    return t.region_suppliers(spark, d).select("row", "col", F.col(value).alias("value"))


@query(f"SELECT p.row, p.col, CASE WHEN {OUTSIDE} THEN -1 ELSE coalesce(m.value, 0) END AS value FROM ({PROBES}) p LEFT JOIN ({SPARSE}) m ON m.row = p.row AND m.col = p.col")
def csr_lookup(spark, d):
    return matrix.lookup(_sparse(spark, d), _probes(spark), N, N)


@query(f"SELECT p.row, p.col, CASE WHEN {OUTSIDE} THEN -1 WHEN m.value IS NULL THEN 0 ELSE 1 END AS value FROM ({PROBES}) p LEFT JOIN ({SPARSE}) m ON m.row = p.row AND m.col = p.col")
def coo_lookup(spark, d):
    return matrix.lookup(_sparse(spark, d), _probes(spark), N, N, found_as_one=True)


@query(f"SELECT p.row, p.col, CASE WHEN {OUTSIDE} THEN -1.0 ELSE coalesce(round(m.balance, 2), 0.0) END AS value FROM ({PROBES}) p LEFT JOIN ({S['sparse']}) m ON m.row = p.row AND m.col = p.col")
def csr_lookup_double(spark, d):
    return rounded(matrix.lookup(_sparse(spark, d, "balance"), _probes(spark), N, N), 2)


@query(f"SELECT i AS row, j AS col, coalesce(value, 0) AS value FROM range({N}) a(i) CROSS JOIN range({N}) b(j) LEFT JOIN ({SPARSE}) ON row = i AND col = j")
def csr_to_dense(spark, d):
    return matrix.coo_to_dense(_sparse(spark, d), N, N)


@query(SPARSE)
def dense_to_coo(spark, d):
    return matrix.dense_to_coo(csr_to_dense(spark, d))


@query(f"SELECT {N * N} - count(*) AS zeros FROM ({SPARSE})")
def count_zeros(spark, d):
    return matrix.count_zeros(csr_to_dense(spark, d))


@query(f"SELECT i AS row, string_agg(CAST(coalesce(value, 0) AS VARCHAR), ' ' ORDER BY j) AS text FROM range({N}) a(i) CROSS JOIN range({N}) b(j) LEFT JOIN ({SPARSE}) ON row = i AND col = j GROUP BY i")
def matrix_preview(spark, d):
    return matrix.preview(_sparse(spark, d), N)


@query(S["transitions"])
def event_transition_matrix(spark, d):
    return t.event_transitions(spark, d)


# sums, normalisation, products


@query(f"SELECT col AS idx, CAST(sum(value) AS BIGINT) AS total FROM ({S['pairs']}) GROUP BY col")
def column_sum(spark, d):
    return matrix.column_sum(t.supplier_part_pairs(spark, d))


@query(f"SELECT row, col, round(value / sum(value) OVER (PARTITION BY col), 12) AS value FROM ({S['pairs']})")
def normalize_columns(spark, d):
    return rounded(linalg.normalize_columns(t.supplier_part_pairs(spark, d)), 12)


@query(f"SELECT row, col, round(value / count(*) OVER (PARTITION BY col), 12) AS value FROM ({S['pairs']})")
def normalize_columns_binary(spark, d):
    return rounded(linalg.normalize_columns_binary(t.supplier_part_pairs(spark, d)), 12)


@query(f"SELECT row, col, round(1 / count(*) OVER (PARTITION BY row), 12) AS value FROM ({S['pairs']})")
def normalize_rows(spark, d):
    return rounded(linalg.normalize_rows_binary(t.supplier_part_pairs(spark, d)), 12)


@query(f"SELECT row, col, round(value / (10.0 + abs(s_acctbal)), 12) AS value FROM ({S['pairs']}) JOIN supplier ON s_suppkey = row")
def normalize_rows_given(spark, d):
    totals = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), (F.lit(10.0) + F.abs("s_acctbal")).alias("total"))
    return rounded(linalg.normalize_rows_given(t.supplier_part_pairs(spark, d), totals), 12)


@query(f"SELECT row AS idx, round(sum(value * (1.0 / (1 + col))), 10) AS value FROM ({S['pairs']}) GROUP BY row")
def matvec_sparse(spark, d):
    parts = t.table(spark, d, "part").select(F.col("p_partkey").alias("idx"), (F.lit(1.0) / (1 + F.col("p_partkey"))).alias("value"))
    return rounded(linalg.matvec(t.supplier_part_pairs(spark, d), parts))


@query(f"SELECT row AS idx, round(sum(value * (col + 1.0)), 6) AS value FROM ({S['gram']}) GROUP BY row")
def matvec_dense(spark, d):
    x = spark.range(64).select(F.col("id").alias("idx"), (F.col("id") + 1.0).alias("value"))
    return rounded(linalg.matvec(t.gram(spark, d), x, 64), 6)


@query("SELECT vec_id AS idx, round(list_sum(list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * (i + 1))), 6) AS value FROM embeddings")
def matvec_arrays(spark, d):
    e = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("vals"))
    return rounded(linalg.matvec_arrays(e, [i + 1.0 for i in range(64)]), 6)


PUSHED = f"WITH e AS ({S['cs_edges']}) SELECT dst AS idx, round(sum((1.0 / (1 + e.src)) / n), 12) AS value FROM e JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) g ON g.src = e.src GROUP BY dst"


@query(PUSHED)
def matvec_push(spark, d):
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), (F.lit(1.0) / (1 + F.col("c_custkey"))).alias("value"))
    return rounded(linalg.push(t.customer_supplier_edges(spark, d), c), 12)


@query(PUSHED)
def matvec_pull(spark, d):
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), (F.lit(1.0) / (1 + F.col("c_custkey"))).alias("value"))
    return rounded(linalg.pull(t.customer_supplier_edges(spark, d).select(F.col("dst").alias("row"), F.col("src").alias("col")), c), 12)


@query("SELECT round(sum(c_acctbal), 2) AS signed, round(sum(abs(c_acctbal)), 2) AS l1, round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS l2, bool_or(c_acctbal = 1.0) AS has_one FROM customer")
def vector_norms(spark, d):
    v = F.col("value")
    return t.balances(spark, d).agg(F.round(scalars.signed_sum(v), 2).alias("signed"), F.round(scalars.l1_norm(v), 2).alias("l1"), F.round(scalars.l2_norm(v), 4).alias("l2"), scalars.has_one(v).alias("has_one"))


@query("SELECT round(sum(abs(coalesce(c_acctbal, 0) - coalesce(s_acctbal, 0))), 2) AS error FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def l1_error(spark, d):
    s = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("value"))
    return rounded(scalars.l1_error(t.balances(spark, d), s), 2, "error")


@query("SELECT c_custkey AS idx, c_acctbal AS value FROM customer WHERE c_custkey < 2 OR c_custkey = (SELECT max(c_custkey) FROM customer)")
def vector_preview(spark, d):
    b = t.balances(spark, d)
    return matrix.vector_preview(b, max(65, b.agg(F.max("idx")).head()[0] + 1))


@query("SELECT c_custkey AS idx, c_acctbal AS value FROM customer ORDER BY c_custkey")
def vector_gathered(spark, d):
    return matrix.gathered(t.balances(spark, d))


# sources and sinks


def _written(spark, write, read) -> DataFrame:
    """What read(path) gives after write(path), in a folder of its own that goes afterwards."""
    path = f"{lineage.shared_folder(spark)}/written-{uuid.uuid4().hex}"
    write(path)
    got = lineage.cut(read(path))
    lineage.delete(spark, path)
    return got


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_acctbal AS value FROM customer")
def vector_text(spark, d):
    """Balances written as a text vector and read back."""
    return _written(spark, lambda path: vectors.write_vector(t.balances(spark, d), path), lambda path: vectors.read_vector(spark, path))


#: a configuration of two parts: name, id, share of connections to the other side, distribution, ids, types (name, ids, connections)
MODEL = [("stem", 0, 0.2, [0.8, 0.2], 20, [("x", 15, 2), ("y", 5, 4)]), ("leaf", 1, 0.1, [0.5, 0.5], 10, [("z", 10, 1)])]


def _json_model(spark, tables) -> DataFrame:
    config = [{"namePart": a, "id": i, "connectionOpposite": o, "distribution": p, "nbTypeNeuron": len(k), "nbNeuron": n, "typeNeuron": [{"name": x, "nbNeuron": c, "nbConnection": m} for x, c, m in k]} for a, i, o, p, n, k in MODEL]
    return _written(spark, lambda path: spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(path), lambda path: tables(brain_json.read_brain(spark, path)))


def _model_sql() -> dict[str, str]:
    """The model's tables from its configuration, two sides of each part."""
    parts = "(VALUES " + ", ".join(f"({i}, {n}, CAST({o} AS DOUBLE))" for _, i, o, _, n, _ in MODEL) + ") p(id, n, o)"
    kinds = "(VALUES " + ", ".join(f"({i}, {j}, {c}, {m})" for _, i, _, _, _, k in MODEL for j, (_, c, m) in enumerate(k)) + ") k(id, type, c, m)"
    dist = "(VALUES " + ", ".join(f"({i}, {j}, CAST({x} AS DOUBLE))" for _, i, _, p, _, _ in MODEL for j, x in enumerate(p)) + ") d(id, dst, x)"
    k = len(MODEL)
    return {
        "parts": f"SELECT CAST(s * {k} + id AS INT) AS part, CAST(sum(n / 2) OVER (ORDER BY s, id) - n / 2 AS BIGINT) AS lo, CAST(sum(n / 2) OVER (ORDER BY s, id) AS BIGINT) AS hi FROM range(2) r(s), {parts}",
        "types": f"SELECT CAST(s * {k} + p.id AS INT) AS part, CAST(type AS INT) AS type, round(CAST(sum(c) OVER w - c AS DOUBLE) / n, 10) AS cum_lo, round(CAST(sum(c) OVER w AS DOUBLE) / n, 10) AS cum_hi FROM range(2) r(s), {parts} JOIN {kinds} ON k.id = p.id WINDOW w AS (PARTITION BY s, p.id ORDER BY type)",
        "probs": f"SELECT CAST(a.s * {k} + p.id AS INT) AS src_part, CAST(type AS INT) AS src_type, CAST(b.s * {k} + dst AS INT) AS dst_part, round(CASE WHEN a.s = b.s THEN 1 - o ELSE o END * x * m / {sum(m[4] for m in MODEL)}, 12) AS p FROM range(2) a(s), range(2) b(s), {parts} JOIN {kinds} ON k.id = p.id JOIN {dist} ON d.id = p.id",
    }


@query(_model_sql()["parts"])
def json_model_parts(spark, d):
    return _json_model(spark, lambda b: b.parts)


@query(_model_sql()["types"])
def json_model_types(spark, d):
    return rounded(_json_model(spark, lambda b: b.types), 10, "cum_lo", "cum_hi")


@query(_model_sql()["probs"])
def json_model_probs(spark, d):
    return rounded(_json_model(spark, lambda b: b.probs), 12, "p")


# ranking


def ranked_sql(edges: str, k: int, beta: float, vertices: str = "SELECT DISTINCT unnest([src, dst]) AS idx FROM e0", digits: int = 10) -> str:
    parts = [f"e0 AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({edges}))", f"v AS MATERIALIZED ({vertices})", "w AS MATERIALIZED (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM e0)", "q0 AS (SELECT idx, CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM v) AS value FROM v)"]
    for i in range(k):
        parts += [
            f"y{i} AS MATERIALIZED (SELECT v.idx, {beta} * coalesce(m.y, 0) + (1 - CAST({beta} AS DOUBLE)) / (SELECT count(*) FROM v) AS y FROM v LEFT JOIN (SELECT dst, sum(w * value) AS y FROM w JOIN q{i} ON w.src = q{i}.idx GROUP BY dst) m ON m.dst = v.idx)",
            f"q{i + 1} AS MATERIALIZED (SELECT idx, y / (SELECT sum(y) FROM y{i}) AS value FROM y{i})",
        ]
    return f"WITH {', '.join(parts)} SELECT idx, round(value, {digits}) AS value FROM q{k}"


@query(ranked_sql(S["sp_edges"], 1, 0.85))
def pagerank_step(spark, d):
    return rounded(rank.pagerank_fixed(t.supplier_part_edges(spark, d), 1, 0.85))


@query(ranked_sql(S["sp_edges"], 5, 0.85))
def pagerank_k5(spark, d):
    return rounded(rank.pagerank_fixed(t.supplier_part_edges(spark, d), 5, 0.85))


@query(ranked_sql(S["trade"].replace("AS row", "AS src").replace("AS col", "AS dst"), 5, 1.0))
def pagerank_undamped_k5(spark, d):
    return rounded(rank.pagerank_fixed(t.nation_trade(spark, d).select(F.col("row").alias("src"), F.col("col").alias("dst")), 5, 1.0))


@query(ranked_sql(f"SELECT dst AS src, src AS dst FROM ({S['cs_edges']})", 5, 0.85))
def pagerank_transposed_k5(spark, d):
    e = t.customer_supplier_edges(spark, d)
    # ids of customers and suppliers share one space here, as in a square adjacency matrix
    return rounded(rank.pagerank_fixed(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 5, 0.85))


@query(ranked_sql(f"SELECT dst AS src, src AS dst FROM ({S['cs_edges']})", 5, 0.85))
def pagerank_transposed(spark, d):
    """From the transposed matrix itself: rows are destinations, columns sources."""
    e = t.customer_supplier_edges(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"))
    return rounded(rank.pagerank_transposed(e, beta=0.85, max_iter=5).ranks)


@query(ranked_sql(S["links"], 5, 0.85))
def pagerank_pages_k5(spark, d):
    return rounded(rank.pagerank_fixed(t.page_links(spark, d), 5, 0.85))


@query(ranked_sql(S["sp_edges"], 5, 0.85) + " ORDER BY value DESC, idx LIMIT 20")
def pagerank_topk(spark, d):
    return rank.top_k(rounded(rank.pagerank_fixed(t.supplier_part_edges(spark, d), 5, 0.85)), 20)


@query(ranked_sql(S["trade"].replace("AS row", "AS src").replace("AS col", "AS dst"), 60, 0.85, digits=9))
def pagerank_converged(spark, d):
    e = t.nation_trade(spark, d).select(F.col("row").alias("src"), F.col("col").alias("dst"))
    return rounded(rank.pagerank(e, beta=0.85, eps=1e-11).ranks, 9)


@query(f"WITH e AS ({S['links']}) SELECT DISTINCT idx FROM (SELECT unnest([src, dst]) AS idx FROM e) WHERE idx NOT IN (SELECT src FROM e)")
def dangling_vertices(spark, d):
    return rank.dangling(t.page_links(spark, d))


def power_sql(m: str, n: int, k: int, norm: str, digits: int = 9, single: bool = False) -> str:
    size = "sqrt(sum(value * value))" if norm == "l2" else "sum(abs(value))"
    parts = [f"m AS MATERIALIZED ({m})", f"x0 AS (SELECT i AS idx, CAST(1.0 AS DOUBLE) / {n} AS value FROM range({n}) r(i))"]
    for i in range(k):
        parts += [
            f"y{i} AS MATERIALIZED (SELECT x.idx, coalesce(p.v, 0) AS value FROM x0 x LEFT JOIN (SELECT m.row AS idx, sum(m.value * z.value) AS v FROM m JOIN x{i} z ON m.col = z.idx GROUP BY m.row) p ON p.idx = x.idx)",
            f"x{i + 1} AS MATERIALIZED (SELECT idx, {'CAST(CAST(' if single else ''}value / (SELECT {size} FROM y{i}){' AS FLOAT) AS DOUBLE)' if single else ''} AS value, (SELECT {size} FROM y{i}) AS eigenvalue FROM y{i})",
        ]
    return f"WITH {', '.join(parts)} SELECT idx, round(value, {digits}) AS value, round(eigenvalue, 5) AS eigenvalue FROM x{k}"


@query(power_sql(S["trade"], N, 6, "l2"))
def power_l2_k6(spark, d):
    return rounded(rounded(rank.power_fixed(t.nation_trade(spark, d), N, 6), 9), 5, "eigenvalue")


@query(power_sql(S["gram"], 64, 6, "l1", 8))
def power_l1_k6(spark, d):
    return rounded(rounded(rank.power_fixed(t.gram(spark, d), 64, 6, "l1"), 8), 5, "eigenvalue")


@query(power_sql(S["trade"], N, 30, "l1", 5, single=True).replace("round(eigenvalue, 5)", "round(eigenvalue, 1)"))
def power_single(spark, d):
    """In 32 bits, until the step is at most 1e-5."""
    got = rank.power_method(t.nation_trade(spark, d), N, "l1", eps=1e-5, single=True)
    return rounded(got.vector, 5).select("idx", "value", F.round(F.lit(got.eigenvalue), 1).alias("eigenvalue"))


@query(f"WITH x AS MATERIALIZED ({power_sql(S['trade'], N, 40, 'l2', 12)}) SELECT round(max(eigenvalue), 4) AS eigenvalue, true AS small FROM x")
def eigen_residual(spark, d):
    trade = t.nation_trade(spark, d)
    got = rank.power_method(trade, N)
    return linalg.residual(trade, got.vector).select(F.round("eigenvalue", 4).alias("eigenvalue"), (F.col("residual") < 1e-8).alias("small"))


# the model of typed vertices


def rows_sql(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(str, r)) + ')' for r in rows)}) r({names}))"


def model_sql(n: int) -> dict[str, str]:
    at = [i * n // 8 for i in range(8)]
    dbl = lambda x: f"CAST({x} AS DOUBLE)"
    return {
        "parts": rows_sql([(i, a, (at + [n])[i + 1]) for i, a in enumerate(at)], "part, lo, hi"),
        "types": rows_sql([(i, k, dbl(c[k - 1] if k else 0), dbl(c[k])) for i, c in enumerate(brain.TYPE_SHARES) for k in range(len(c))], "part, type, cum_lo, cum_hi"),
        "probs": rows_sql([(i, k, j, dbl(p)) for i, rows in enumerate(brain.CONNECTIONS) for k, row in enumerate(rows) for j, p in enumerate(row)], "src_part, src_type, dst_part, p"),
    }


def neurons_sql(n: int) -> str:
    m = model_sql(n)
    return f"SELECT i AS id, p.part, y.type FROM (SELECT i, {uniform_sql('type0', 'i')} AS u FROM range({n}) r(i)) JOIN {m['parts']} p ON i >= p.lo AND i < p.hi JOIN {m['types']} y ON y.part = p.part AND (u > cum_lo AND u <= cum_hi OR u = 0 AND y.type = 0)"


def edges_sql(n: int) -> str:
    m = model_sql(n)
    return f"WITH n AS MATERIALIZED ({neurons_sql(n)}), e AS (SELECT s.id AS src, d.id AS dst, p.p FROM n s CROSS JOIN n d JOIN {m['probs']} p ON p.src_part = s.part AND p.src_type = s.type AND p.dst_part = d.part WHERE s.id <> d.id) SELECT src, dst, 1 AS value FROM e WHERE {uniform_sql('edge0', 'src', 'dst')} > 1 - p"


M = model_sql(128)


@query(f"SELECT part, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM {M['parts']}")
def brain_parts(spark, d):
    return brain.hard_brain(spark, 128).parts


@query(f"SELECT part, CAST(hi - lo AS BIGINT) AS size FROM {M['parts']}")
def brain_part_sizes(spark, d):
    return brain.part_sizes(brain.hard_brain(spark, 128))


@query(f"SELECT i AS id, part FROM range(140) r(i) JOIN {M['parts']} ON i >= lo AND (i < hi OR part = 7)")
def brain_part_lookup(spark, d):
    return brain.part_of(brain.hard_brain(spark, 128), spark.range(140))


@query(neurons_sql(128))
def brain_types(spark, d):
    return brain.neuron_types(brain.hard_brain(spark, 128))


@query(f"SELECT src_part AS part, src_type AS type, round(sum(16 * p) * 100 / 128, 10) AS pct FROM {M['probs']} GROUP BY ALL")
def brain_expected_pct(spark, d):
    return rounded(brain.expected_percentage(brain.hard_brain(spark, 128)), 10, "pct")


@query(f"SELECT src_part, src_type, dst_part, round(p * 0.01, 12) AS p FROM {M['probs']}")
def brain_scaled(spark, d):
    return rounded(brain.hard_brain(spark, 128, "0.35").probs, 12, "p")


@query(f"SELECT src_part, src_type, dst_part, round(p * 0.1, 12) AS p FROM {M['probs']}")
def brain_scaled_tenth(spark, d):
    return rounded(brain.hard_brain(spark, 128, "3.5").probs, 12, "p")


@query(f"SELECT src_part, src_type, dst_part, round(p * 0.001, 12) AS p FROM {M['probs']}")
def brain_scaled_thousandth(spark, d):
    return rounded(brain.hard_brain(spark, 128, "0.035").probs, 12, "p")


@query(f"SELECT part, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, src_type, dst_part, p FROM {M['parts']} JOIN {M['probs']} ON src_part = part")
def brain_tables(spark, d):
    """The model written as tables and loaded again."""
    def load(path):
        b = brain_json.load_brain(spark, path)
        return b.parts.join(b.probs, F.col("part") == F.col("src_part")).select("part", "lo", "hi", "src_type", "dst_part", "p")

    return _written(spark, lambda path: brain_json.write_brain(brain.hard_brain(spark, 128), path), load)


@query(f"SELECT t.part, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, t.type, t.cum_hi, s.p FROM {M['types']} t JOIN {M['parts']} r ON r.part = t.part JOIN (SELECT src_part, src_type, string_agg(printf('%.2f', p), ',' ORDER BY dst_part) AS p FROM {M['probs']} GROUP BY ALL) s ON src_part = t.part AND src_type = t.type")
def brain_recap(spark, d):
    return brain.recap(brain.hard_brain(spark, 128)).withColumn("p", F.array_join(F.transform("p", lambda x: F.format_string("%.2f", x)), ","))


@query(f"SELECT round(sum(s * p * 16) / 8 / 128, 8) AS density, round(12.0 * 128 * 128 * sum(s * p * 16) / 8 / 128, 2) AS matrix_bytes, round(12.0 * 128 * 128 * sum(s * p * 16) / 8 / 128 / 4, 2) AS rank_bytes, CAST(512 AS BIGINT) AS type_bytes FROM {M['probs']} JOIN (SELECT part, type, cum_hi - cum_lo AS s FROM {M['types']}) t ON part = src_part AND type = src_type")
def brain_memory(spark, d):
    return rounded(rounded(brain.memory_estimate(brain.hard_brain(spark, 128), 4), 8, "density"), 2, "matrix_bytes", "rank_bytes")


@query(edges_sql(128))
def brain_edges_128(spark, d):
    return generate.brain_edges(brain.hard_brain(spark, 128))


@query(f"SELECT dst AS row, src AS col, value FROM ({edges_sql(128)})")
def brain_edges_t_128(spark, d):
    return generate.brain_edges_transposed(brain.hard_brain(spark, 128))


@query(f"WITH k AS ({neurons_sql(128)}), g AS ({edges_sql(128)}), x AS (SELECT src_part, src_type, sum(16 * p) * 100 / 128 AS pct FROM {M['probs']} GROUP BY ALL) SELECT id, part, type, coalesce(n, 0) AS connections, round(coalesce(n, 0) * 100.0 / 128, 8) AS obtained, round(pct, 8) AS expected FROM k LEFT JOIN (SELECT src, count(*) AS n FROM g GROUP BY src) ON src = id JOIN x ON src_part = part AND src_type = type")
def brain_degree_report(spark, d):
    b = brain.hard_brain(spark, 128)
    degree = generate.brain_edges(b).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    got = brain.neuron_types(b).join(degree, "id", "left").join(brain.expected_percentage(b), ["part", "type"])
    n = F.coalesce("n", F.lit(0))
    return got.select("id", "part", "type", n.alias("connections"), F.round(n * 100.0 / F.lit(128.0), 8).alias("obtained"), F.round("pct", 8).alias("expected"))


@query(ranked_sql(edges_sql(128), 5, 0.85, "SELECT i AS idx FROM range(128) r(i)"))
def brain_pagerank_k5(spark, d):
    return rounded(rank.pagerank_fixed(generate.brain_edges(brain.hard_brain(spark, 128)), 5, 0.85, spark.range(128).withColumnRenamed("id", "idx")))


UNIFORM = f"SELECT i AS row, j AS col, 1 AS value FROM range(100) a(i), range(100) b(j) WHERE i <> j AND {uniform_sql('uniform0', 'i', 'j')} > 75 / 100.0"


@query(UNIFORM)
def uniform_edges(spark, d):
    return generate.uniform_edges(spark, 100, 75)


@query(f"SELECT row, col, value FROM ({UNIFORM}) QUALIFY row_number() OVER (ORDER BY row, col) <= 100 * 100 * 25 // 100")
def uniform_edges_truncated(spark, d):
    return generate.uniform_edges(spark, 100, 75, truncate=True)


@query(f"SELECT i AS row, j AS col, 1 AS value FROM range(100) a(i), range(100) b(j) WHERE i <> j AND {uniform_sql('block0', 'i', 'j')} > (CASE WHEN i < 50 THEN 75 ELSE 40 END) / 100.0")
def block_density_edges(spark, d):
    return generate.block_uniform_edges(spark.createDataFrame([(0, 75), (1, 40)], "block BIGINT, zero_pct INT"), 100)


@query(f"SELECT i AS row, j AS col, CASE WHEN i = j OR {uniform_sql('dense0', 'i', 'j')} < 75 / 100.0 THEN 0 ELSE 1 END AS value FROM range(64) a(i), range(64) b(j)")
def dense_binary_64(spark, d):
    return generate.dense_binary(spark, 64, 75, clear_diagonal=True)


@query(f"SELECT i AS row, j AS col, CASE WHEN {uniform_sql('dense0', 'i', 'j')} < 75 / 100.0 THEN 0 ELSE 1 END AS value FROM range(64) a(i), range(64) b(j)")
def dense_binary_diagonal(spark, d):
    """The diagonal is drawn like any cell."""
    return generate.dense_binary(spark, 64, 75)


@query(f"SELECT i AS row, j AS col, CASE WHEN {uniform_sql('zero0', 'i', 'j')} >= 0.5 THEN floor({uniform_sql('value0', 'i', 'j')} * 1000) / 10.0 ELSE CAST(0 AS DOUBLE) END AS value FROM range(64) a(i), range(64) b(j)")
def dense_decimal_64(spark, d):
    return generate.dense_decimal(spark, 64)


P1, P2, K = generate.PRNG_1, generate.PRNG_2, generate.MASK
POWERS = "1, 2, 4, 8, 16, 32"


@query(f"SELECT i AS row, j AS col, round(CASE WHEN j - i IN ({POWERS}) THEN ((2 * i - j) * {P2} + i * {P1}) % 101 WHEN i - j IN ({POWERS}) THEN ((2 * i - j) * {P2} + i * {P1}) % 101 ELSE CAST(((i * i * {P1} + j * j * {P2}) & {K}) AS DOUBLE) / {K} / 64 END, 14) AS value FROM range(64) a(i), range(64) b(j)")
def det_matrix_64(spark, d):
    return rounded(generate.deterministic_dense(spark, 64), 14)


@query("SELECT i AS row, CAST(ntile(7) OVER (ORDER BY i) - 1 AS INT) AS worker FROM range(100) r(i)")
def row_distribution(spark, d):
    return blocks.row_distribution(spark, 100, 7)


def layout_sql(r: int, c: int, n: int, transposed: bool) -> str:
    import math

    g = math.gcd(r, c)
    rb, cb, dl, dc = r // g, c // g, n // r, n // c
    own = rb if transposed else cb
    base = f"SELECT CAST(i AS INT) AS rank, CAST(i // {c} AS INT) AS indl, CAST(i % {c} AS INT) AS indc, CAST({dl} AS BIGINT) AS dim_l, CAST({dc} AS BIGINT) AS dim_c, i // {c} * {dl} AS start_row, (i // {c} + 1) * {dl} - 1 AS end_row, i % {c} * {dc} AS start_col, (i % {c} + 1) * {dc} - 1 AS end_col FROM range({r * c}) g(i)"
    if transposed:
        more = f"CAST(floor(indc / ({c} / {r})) AS INT) AS redistribution_root, CAST({rb * dl} AS BIGINT) AS local_result_size, CAST(indl // {rb} AS INT) AS calculation_group, CAST(indl % {rb} AS INT) AS indl_in_group, indc AS indc_in_group, CAST(indc % {cb} * {r} + indl AS INT) AS need_group, dim_c * (indc % {cb}) AS start_col_in_group, dim_l * (indl % {rb}) AS start_row_in_group, CAST(indl % {rb} * {own} + indc AS INT) AS group_rank"
    else:
        more = f"CAST(floor(indl / ({r} / {c})) AS INT) AS redistribution_root, CAST({cb * dc} AS BIGINT) AS local_result_size, CAST(indc // {cb} AS INT) AS calculation_group, indl AS indl_in_group, CAST(indc % {cb} AS INT) AS indc_in_group, CAST(indl % {rb} * {c} + indc AS INT) AS need_group, dim_c * (indc % {cb}) AS start_col_in_group, dim_l * (indl % {rb}) AS start_row_in_group, CAST(indc % {cb} + indl * {own} AS INT) AS group_rank"
    return f"SELECT *, {more} FROM ({base})"


@query(layout_sql(4, 2, 64, False))
def block_layout_adj(spark, d):
    return blocks.ranking_layout(spark, 4, 2, 64)


@query(layout_sql(6, 4, 48, True))
def block_layout_transposed(spark, d):
    return blocks.ranking_layout(spark, 6, 4, 48, transposed=True)


@query(f"SELECT src, min(dst) AS first_dst, max(dst) AS last_dst, count(*) AS degree FROM ({S['cs_edges']}) GROUP BY src")
def edge_vertex_range_report(spark, d):
    return t.customer_supplier_edges(spark, d).groupBy("src").agg(F.min("dst").alias("first_dst"), F.max("dst").alias("last_dst"), F.count("*").alias("degree"))


@query("SELECT i AS id FROM range(128) r(i) WHERE i % 32 = 0")
def neuron_sample(spark, d):
    return generate.neuron_sample(128, spark, 64)


@query(f"SELECT min(seconds) AS least, max(seconds) AS most, round(avg(seconds), 6) AS mean FROM ({S['gaps']}) WHERE seconds IS NOT NULL")
def run_times(spark, d):
    """Of the times between users' events; `Ranking.step_seconds` holds those of a ranking's own steps."""
    return rounded(blocks.run_times(t.event_gaps(spark, d)), 6, "mean")


@query("SELECT n, workers, max(p) AS fitting FROM range(90, 110) a(n), (VALUES (7), (12), (64)) w(workers), range(1, 65) r(p) WHERE p <= workers AND n % p = 0 GROUP BY ALL")
def fitting_workers(spark, d):
    """The most workers that divide the rows evenly; a report over 60 pairs of numbers."""
    rows = [(n, w, blocks.fitting_workers(n, w)) for n in range(90, 110) for w in (7, 12, 64)]
    return spark.createDataFrame(rows, "n long, workers int, fitting long")
