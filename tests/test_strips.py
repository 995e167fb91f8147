"""Kernels that make matrices in strips: the same numbers as the whole matrices, and no matrix in memory."""

import tracemalloc

import numpy as np
import pytest

from latticeq.functions import kernels

RNG = np.random.default_rng(3)
N, M = 37, 53
FX, FY, X, Y = RNG.normal(size=(N, 8)), RNG.normal(size=(M, 8)), RNG.normal(0, 10, (N, 3)), RNG.normal(0, 10, (M, 3))


@pytest.fixture(params=[1 << 18, 50])
def cells(request, monkeypatch):
    monkeypatch.setattr(kernels, "CELLS", request.param)


@pytest.mark.parametrize("rounds", [3, 100])
def test_marginals_of_sinkhorn(cells, rounds):
    a, b = np.full(N, 1 / N), np.full(M, 1 / M)
    plan = kernels.sinkhorn(kernels.feature_cost(FX, FY), a, b, 0.05, rounds)
    across, down = kernels.sinkhorn_marginals(FX, FY, a, b, 0.05, rounds)
    np.testing.assert_allclose(across, plan.sum(1), rtol=0, atol=1e-12)
    np.testing.assert_allclose(down, plan.sum(0), rtol=0, atol=1e-12)
    with pytest.raises(ValueError):
        kernels.sinkhorn_marginals(FX, FY, a, b, 1e-3, rounds)


def test_even_cost(cells):
    c1, c2 = kernels.distances(X) / kernels.UNIT, kernels.distances(Y) / kernels.UNIT
    cost = kernels.linear_cost(c1, c2, np.full((N, M), 1 / (N * M)))
    np.testing.assert_allclose(kernels.even_cost(X, Y), (cost.mean(), cost.max()), atol=1e-12)


@pytest.mark.parametrize("sweeps", [1, 3, 50])
def test_random_marginals(cells, sweeps):
    plan = kernels.random_coupling(N, M, np.random.default_rng(5), sweeps)
    want = abs(plan.sum(1) * N - 1).max(), abs(plan.sum(0) * M - 1).max(), plan.std() * N * M
    np.testing.assert_allclose(kernels.random_marginals(N, M, np.random.default_rng(5), sweeps), want, atol=1e-12)


def test_standardised_and_aligned(cells):
    whole, settings = kernels.standardised(FX @ FY.T), [(0.0, 1.0, 0.25), (0.5, 2.0, 0.5), (0.25, 3.0, 1.0)]
    strips = list(kernels.standardised_strips(FX, FY))
    np.testing.assert_allclose(np.concatenate(strips), whole, atol=1e-12)
    found = kernels.local_scores((row for strip in strips for row in strip), M, settings)
    np.testing.assert_allclose(found, [kernels.smith_waterman(whole, *x) for x in settings], atol=1e-9)


def test_product_statistics(cells):
    for temperature in (0.1, 0.001):
        np.testing.assert_allclose(kernels.product_statistics(FX, FY, temperature), kernels.similarity_statistics(FX @ FY.T, temperature), atol=1e-12)


def test_no_matrix_is_held():
    n = 1200
    x, v = RNG.normal(0, 10, (n, 3)), RNG.normal(size=(n, 64))
    wp, ws = kernels.patch_encoder_weights(64, 8, 8, layers=2), kernels.sequence_encoder_weights(64, 8, 8, layers=1)
    even, mask = np.full(n, 1 / n), np.ones((1, n), bool)
    for limit, run in (
        (20, lambda: kernels.even_cost(x, x)),
        (20, lambda: kernels.sinkhorn_marginals(v, v[::-1], even, even, 0.05, 3)),
        (20, lambda: kernels.random_marginals(n, n, np.random.default_rng(0))),
        (20, lambda: kernels.local_scores((row for strip in kernels.standardised_strips(v, v) for row in strip), n, [(0.0, 1.0, 0.5)])),
        (20, lambda: kernels.product_statistics(v, v)),
        (20, lambda: kernels.align_structures(x, x + 1)),
        (160, lambda: kernels.patch_encoder(v[None, :600], x[None, :600], mask[:, :600], wp, layers=2)),  # 460 MB for all edges
        (70, lambda: kernels.sequence_encoder(v[None], mask, ws, heads=8, layers=1)),  # 92 MB for one array of all heads
    ):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < limit, peak


def test_cells_of_residues_without_a_vector(spark, monkeypatch):
    """Cells, z-scores and means in strips are those of the joined long form; a residue without a vector has null cells and counts nowhere."""
    from pyspark.sql import functions as F

    from latticeq.functions import exprs, udfs
    from latticeq.operators import geometry

    vecs = {1: [[1.0, 2.0], None, [0.5, -1.0], [3.0, 1.0]], 2: [[0.0, 1.0], [2.0, 2.0], [1.0, None]], 3: [None]}
    pairs = spark.createDataFrame([(q, t, vecs[q], vecs[t]) for q in vecs for t in vecs if q < t], "query bigint, target bigint, a array<array<double>>, b array<array<double>>")
    long = spark.createDataFrame([(k, i, v) for k, own in vecs.items() for i, v in enumerate(own)], "id bigint, idx bigint, vec array<double>").withColumn("u", exprs.unit(F.col("vec")))
    a, b = (long.select(F.col("id").alias(name), F.col("idx").alias(at), F.col("u").alias(f"u{at}")) for name, at in (("query", "i"), ("target", "j")))
    plain = a.join(b, F.col("query") < F.col("target")).select("query", "target", "i", "j", F.round(exprs.dot(F.col("ui"), F.col("uj")), 6).alias("s"))

    def rows(df):
        return sorted(tuple(-9.0 if x is None else round(x, 6) for x in row) for row in df.collect())

    assert rows(udfs.similarity_cells(pairs)) == rows(plain)
    assert rows(udfs.similarity_cells(pairs, "z", standard=5)) == rows(geometry.standardised(plain).select("query", "target", "i", "j", F.round("z", 5)))
    assert rows(udfs.similarity_means(pairs).select("query", "target", *udfs.MEANS)) == rows(geometry.similarity_statistics(plain).select("query", "target", *udfs.MEANS))


def test_cells_are_not_joined(spark, tmp_path):
    """No matrix goes through a shuffle: rows of N12, N13, N15 and R22 leave the task that makes them, and only N11's means do."""
    import __spark_entry__

    for name in ("N11_similarity_statistics", "N12_similarity_matrix", "N13_standardised", "N15_mixed_matrix", "R22_dense_clamp"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan[: plan.index("MapInArrow")] and "Window" not in plan[: plan.index("MapInArrow")], name


@pytest.mark.parametrize("columns", [16384, 64])
def test_nearest_in_runs_of_targets(columns, monkeypatch):
    """The k best in double precision, with ties by id, whatever runs targets pass in; rows near a tie in single precision are not lost."""
    import pyarrow as pa

    from latticeq.operators import search

    monkeypatch.setattr(search, "COLUMNS", columns)
    vec = RNG.normal(size=(3000, 8))
    vec[1000:1300] = vec[7] + RNG.normal(0, 1e-4, (300, 8))  # scores that differ in their last places
    vec[2000:2100] = vec[11]  # ties
    vec[5] = np.nan
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    ids = RNG.permutation(3000)
    queries, k = np.array([5, 7, 11, 1005, 2050, 40]), 20
    found = pa.concat_tables(search._nearest_of(pa.chunked_array([ids]), ids, vec, queries, np.arange(3000), k))
    scores, want = np.round(np.clip(vec[queries] @ vec.T, -1, 1), 6), []
    for row, q in enumerate(queries):
        best = sorted((j for j in range(3000) if j != q and scores[row, j] >= -1), key=lambda j: (-scores[row, j], ids[j]))[:k]
        want += [(int(ids[q]), int(ids[j]), float(scores[row, j])) for j in best]
    assert list(zip(*(found.column(c).to_pylist() for c in ("query", "target", "score")), strict=True)) == want
