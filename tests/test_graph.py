"""Golden, property and edge-case tests of graphs, matrices and rankings."""

import json
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import scalars
from meshloom.operators import blocks, brain, generate, linalg, matrix
from meshloom.plans import rank
from meshloom.sources import brain_json, vectors


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def ranks(r):
    return {x.idx: x.value for x in r.ranks.collect()}


def coo(spark, rows):
    return spark.createDataFrame(rows, "row long, col long, value int")


def test_undamped_limit(spark):
    got = rank.pagerank(edges(spark, [(1, 2), (2, 3), (3, 1), (1, 3)]), eps=1e-5)
    assert got.converged and ranks(got) == pytest.approx({1: 0.4, 2: 0.2, 3: 0.4}, abs=1e-4)


def test_cycle_is_a_fixed_point(spark):
    got = rank.pagerank(edges(spark, [(0, 1), (1, 2), (2, 0)]))
    assert got.iterations == 1 and got.error == pytest.approx(0)


def test_periodic_graph_does_not_converge(spark):
    got = rank.pagerank(edges(spark, [(0, i) for i in (1, 2, 3)] + [(i, 0) for i in (1, 2, 3)]), max_iter=4)
    assert not got.converged and got.iterations == 4 and ranks(got)[0] == pytest.approx(0.25)


def test_dangling_mass_is_rescaled(spark):
    got = rank.pagerank(edges(spark, [(1, 0), (2, 0), (0, 1)]), beta=0.85, eps=1e-3)
    assert sum(ranks(got).values()) == pytest.approx(1)
    assert [r.idx for r in rank.dangling(edges(spark, [(1, 0), (2, 0)])).collect()] == [0]


def test_isolated_vertex(spark):
    e, v = edges(spark, [(0, 1), (1, 0)]), spark.range(3).withColumnRenamed("id", "idx")
    assert ranks(rank.pagerank(e, vertices=v, max_iter=2))[2] == 0
    assert ranks(rank.pagerank(e, beta=0.85, vertices=v, max_iter=5))[2] > 0


def test_single_vertex_and_empty(spark):
    one = rank.pagerank(edges(spark, []), vertices=spark.range(1).withColumnRenamed("id", "idx"))
    assert one.iterations == 0 and one.converged and ranks(one) == {0: 1.0}
    with pytest.raises(ValueError):
        rank.pagerank(edges(spark, []))


def test_damping_matters_and_ids_do_not(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(200)]
    a, b = rank.pagerank_fixed(edges(spark, pairs), 3, 0.85), rank.pagerank_fixed(edges(spark, pairs), 3, 1.0)
    assert scalars.l1_error(a, b).head()[0] > 1e-3
    moved = rank.pagerank_fixed(edges(spark, [(97 - s, 97 - d) for s, d in pairs]), 3, 0.85).select((97 - F.col("idx")).alias("idx"), "value")
    assert scalars.l1_error(a, moved).head()[0] < 1e-12
    t = edges(spark, pairs).select(F.col("dst").alias("row"), F.col("src").alias("col"))
    assert scalars.l1_error(rank.pagerank(edges(spark, pairs), beta=0.85, max_iter=3).ranks, rank.pagerank_transposed(t, beta=0.85, max_iter=3).ranks).head()[0] < 1e-12


def dense(n):
    """The published formula in plain integers."""
    a = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            a[i, j] = ((i * i * generate.PRNG_1 + j * j * generate.PRNG_2) & 0x7FFFFFFF) / 0x7FFFFFFF / n
        k = 1
        while k < n:
            for j, x in ((i + k, i - k), (i - k, i + k)):
                if 0 <= j < n:
                    a[i, j] = math.fmod(x * generate.PRNG_2 + i * generate.PRNG_1, 101)
            k *= 2
    return a


def test_power_method_on_the_deterministic_matrix(spark):
    n = 64
    a, x, steps = dense(n), np.full(n, 1 / n), 0
    while True:
        y = a @ x
        size = np.linalg.norm(y)
        y /= size
        steps += 1
        gap, x = np.linalg.norm(x - y), y
        if gap <= 1e-4 or steps == 12:
            break
    m = generate.deterministic_dense(spark, n)
    got = rank.power_method(m, n, eps=1e-4, max_iter=12)
    v = np.array([r.value for r in got.vector.orderBy("idx").collect()])
    assert got.iterations == steps and got.eigenvalue == pytest.approx(size, rel=1e-12) and np.abs(v - x).max() < 1e-12


def test_masked_products_of_a_large_index(spark):
    """The engine's cells equal those of unbounded integers."""
    at = [(2**33 + 5, 7), (7, 2**33 + 5), (2**40 + 3, 2**41 + 9), (12345, 99999)]
    got = spark.createDataFrame(at, "row long, col long").select("row", "col", generate.deterministic_value(F.col("row"), F.col("col"), 10).alias("v"))
    for r in got.collect():
        assert r.v == ((r.row * r.row * generate.PRNG_1 + r.col * r.col * generate.PRNG_2) & 0x7FFFFFFF) / 0x7FFFFFFF / 10


def test_golden_run_of_2048(spark):
    """The last steps of the run in the engine: it ends in step 240, at the known eigenvalue."""
    n = 2048
    i = np.arange(n, dtype=np.uint64)
    a = ((np.add.outer(i * i * np.uint64(generate.PRNG_1), i * i * np.uint64(generate.PRNG_2))) & np.uint64(0x7FFFFFFF)).astype(float) / 0x7FFFFFFF / n
    i = np.arange(n)
    k = 1
    while k < n:
        up, down = i[: n - k], i[k:]
        a[up, up + k] = np.fmod((up - k) * generate.PRNG_2 + up * generate.PRNG_1, 101)
        a[down, down - k] = np.fmod((down + k) * generate.PRNG_2 + down * generate.PRNG_1, 101)
        k *= 2
    x = np.full(n, 1 / n)
    for _ in range(238):
        y = a @ x
        x = y / np.linalg.norm(y)
    x0 = spark.createDataFrame(list(enumerate(x.tolist())), "idx long, value double")
    got = rank.power_method(generate.deterministic_dense(spark, n), n, eps=1e-9, x0=x0)
    assert 238 + got.iterations == 240 and got.converged and got.eigenvalue == pytest.approx(927.80323253, abs=1e-8)
    v = {r.idx: r.value for r in got.vector.where("idx IN (0, 7)").collect()}
    assert v[0] == pytest.approx(0.00063495238720221911, abs=1e-12) and v[7] == pytest.approx(-0.0013954662744532641, abs=1e-12)


def test_truncation_keeps_the_first_entries(spark):
    cells = [(r.row, r.col) for r in generate.uniform_edges(spark, 100, 75).orderBy("row", "col").collect()]
    kept = [(r.row, r.col) for r in generate.uniform_edges(spark, 100, 75, truncate=True).orderBy("row", "col").collect()]
    assert len(cells) > 2500 and kept == cells[:2500]


def test_hub_is_dealt_over_salts(spark, monkeypatch):
    pairs = [(0, i) for i in range(1, 60)] + [(i, 0) for i in range(1, 60, 2)] + [(3, 4), (5, 3)]
    want = ranks(rank.pagerank(edges(spark, pairs), beta=0.85, max_iter=4))
    monkeypatch.setattr(rank, "HUB", 7)
    got = rank.pagerank(edges(spark, pairs), beta=0.85, max_iter=4)
    assert ranks(got) == pytest.approx(want) and len(got.step_seconds) == 4
    graph, n = rank.dealt(edges(spark, pairs))
    assert n == 60 and graph.groupBy("idx", "salt").count().agg(F.max("count")).head()[0] < 30
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = rank.step(graph, rank.start(graph, n), n, 0.85)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(i#" in plan and "hashpartitioning(idx#" not in plan  # only the vector moves to the edges


def test_folders(spark):
    from meshloom.plans import lineage

    df = lineage.cut(spark.range(3))
    at = lineage.stored_at(df).removeprefix("file:")
    with lineage.scratch(spark):
        inner = lineage.stored_at(lineage.cut(df)).removeprefix("file:")
        assert Path(inner).exists()
    assert not Path(inner).exists() and df.count() == 3
    lineage.free(df)
    assert not Path(at).exists()


@pytest.mark.parametrize("rows", [[], [(1, 2, 5)], [(0, 0, 1), (0, 3, 2), (2, 1, 3)], [(3, 3, 1)], [(1, 0, 1), (1, 1, 1), (3, 2, 4)]])
def test_pointers_and_round_trip(spark, rows):
    m = coo(spark, rows)
    ptr = {r.row: (r.start, r.end) for r in matrix.row_pointers(m, 4).collect()}
    want, at = {}, 0
    for i in range(4):
        k = sum(r[0] == i for r in rows)
        want[i], at = (at, at + k), at + k
    assert ptr == want
    back = matrix.dense_to_coo(matrix.coo_to_dense(m, 4, 4))
    assert sorted(map(tuple, back.select("row", "col", "value").collect())) == sorted(rows)
    assert matrix.count_zeros(matrix.coo_to_dense(m, 4, 4)).head()[0] == 16 - len(rows)


def test_model_rows_must_fit(spark):
    with pytest.raises(ValueError):
        brain.Brain.from_rows(spark, 8, [1, 4], [[1], [1]], [[[0.5, 0.5]], [[0.5, 0.5]]])


def test_lookup(spark):
    m = coo(spark, [(0, 1, 7)])
    probes = spark.createDataFrame([(0, 1), (1, 1), (-1, 0), (0, 4)], "row long, col long")
    assert {(r.row, r.col): r.value for r in matrix.lookup(m, probes, 4, 4).collect()} == {(0, 1): 7, (1, 1): 0, (-1, 0): -1, (0, 4): -1}
    assert matrix.lookup(m, probes, 4, 4, found_as_one=True).where("row = 0 AND col = 1").head().value == 1


def test_brain_statistics(spark):
    b = brain.hard_brain(spark, 256)
    e = generate.brain_edges(b).cache()
    n, expected = e.count(), 0.3496875 * 256 * 256
    assert abs(n - expected) < 4 * math.sqrt(256 * 256 * 0.25)
    assert e.where("src = dst").count() == 0
    kinds = brain.neuron_types(b)
    bad = e.join(kinds.selectExpr("id AS src", "part AS sp", "type AS st"), "src").join(kinds.selectExpr("id AS dst", "part AS dp"), "dst").where("sp = 3 AND st = 1 AND dp = 7")
    assert bad.count() == 0 and kinds.count() == 256
    got = {(r.part, r.type): r.pct for r in brain.expected_percentage(b).collect()}
    assert got == pytest.approx({(0, 0): 38.75, (0, 1): 13.75, (1, 0): 38.75, (2, 0): 40, (2, 1): 14.375, (3, 0): 40, (3, 1): 41.875, (3, 2): 14.375, (4, 0): 38.75, (5, 0): 40.625, (6, 0): 35.625, (7, 0): 14.375, (7, 1): 35.625})
    with pytest.raises(ValueError):
        brain.hard_brain(spark, 12)


def test_json_model(spark, tmp_path):
    config = [
        {"namePart": "a", "id": 0, "connectionOpposite": 0.2, "distribution": [0.8, 0.2], "nbTypeNeuron": 1, "nbNeuron": 10, "typeNeuron": [{"name": "x", "nbNeuron": 10, "nbConnection": 2}]},
        {"namePart": "b", "id": 1, "connectionOpposite": 0.1, "distribution": [0.5, 0.5], "nbTypeNeuron": 1, "nbNeuron": 5, "typeNeuron": [{"name": "y", "nbNeuron": 5, "nbConnection": 1, "neurotransmitter": "z"}]},
    ]
    (tmp_path / "c.json").write_text(json.dumps(config))
    b = brain_json.read_brain(spark, str(tmp_path / "c.json"))
    assert b.n == 15 and sorted(map(tuple, b.parts.collect())) == [(0, 0, 5), (1, 5, 7), (2, 7, 12), (3, 12, 15)]
    p = {(r.src_part, r.dst_part): r.p for r in b.probs.collect()}
    assert p[0, 0] == pytest.approx(0.8 * 0.8 * 2 / 15) and p[0, 2] == pytest.approx(0.2 * 0.8 * 2 / 15) and p[2, 0] == pytest.approx(0.2 * 0.8 * 2 / 15) and len(p) == 16
    assert {tuple(r) for r in b.types.collect()} == {(i, 0, 0.0, 1.0) for i in range(4)}
    brain_json.write_brain(b, str(tmp_path / "m"))
    again = brain_json.load_brain(spark, str(tmp_path / "m"))
    assert again.n == 15 and again.probs.exceptAll(b.probs).count() == 0


def test_vector_text_round_trip(spark, tmp_path):
    values = [1 / 3, -2.5e-300, 0.1, 1e17, 0.0] * 40
    v = spark.createDataFrame(list(enumerate(values)), "idx long, value double")
    vectors.write_vector(v.repartition(5), str(tmp_path / "v"))
    assert [r.value for r in vectors.read_vector(spark, str(tmp_path / "v")).orderBy("idx").collect()] == values
    (tmp_path / "bad.txt").write_text("3\n1.0\n2.0\n")
    with pytest.raises(ValueError):
        vectors.read_vector(spark, str(tmp_path / "bad.txt"))


def test_row_distribution_and_layout(spark):
    for n, p in ((10, 3), (12, 4), (3, 5)):
        got = [r.worker for r in blocks.row_distribution(spark, n, p).orderBy("row").collect()]
        assert got == [w for w in range(p) for _ in range(n // p + (w < n % p))]
    assert blocks.fitting_workers(12, 5) == 4
    for r, c in ((1, 1), (2, 2), (4, 2), (2, 4), (6, 4)):
        for transposed in (False, True):
            rows = blocks.ranking_layout(spark, r, c, 48, transposed).collect()
            assert len(rows) == r * c and all(x.end_row - x.start_row + 1 == 48 // r for x in rows)


def test_residual_and_norms(spark):
    m = spark.createDataFrame([(0, 0, 2.0), (1, 1, 1.0)], "row long, col long, value double")
    v = spark.createDataFrame([(0, 1.0), (1, 0.0)], "idx long, value double")
    r = linalg.residual(m, v).head()
    assert (r.eigenvalue, r.residual) == (2.0, 0.0)
    assert v.agg(scalars.has_one(F.col("value"))).head()[0] and not v.limit(0).agg(scalars.has_one(F.col("value"))).head()[0]


def test_streaming_degrees(spark, tmp_path):
    from meshloom.streaming.degrees import streaming_degrees

    edges(spark, [(1, 2), (1, 3), (2, 3)]).write.parquet(str(tmp_path / "in"))
    q = streaming_degrees(spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("deg").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.idx, r.out_degree, r.in_degree) for r in spark.table("deg").collect()} == {(1, 2, 0), (2, 1, 1), (3, 0, 2)}
