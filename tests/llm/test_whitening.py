import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeq.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(vectors, k=16):
    """Whole numbers, covariance and components of the distinct vectors, all at once."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + whitening.SHIFT
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    y = (fit * n - sums) / n
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return n, ((x * n - sums) ** 2).sum(1), ((x * n - sums) / n) @ turn / np.sqrt(values), values / (y**2).sum() * n


def test_query_equals_plain_linear_algebra(spark):
    found = queries.op11_embedding_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, whitened, explained = plain(np.stack(rows["embedding"]))
    assert len(found) == 16 * len(rows) and set(found["n"]) == {n}
    got = found["whitened"].to_numpy().reshape(-1, 16)
    assert np.abs(got * np.sign((got * whitened).sum(0)) - whitened).max() < 1e-9
    assert (found["deviation"].to_numpy().reshape(-1, 16) == deviation[:, None]).all()
    assert np.allclose(found["explained"].to_numpy().reshape(-1, 16), explained, rtol=1e-10)
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-10


@pytest.mark.parametrize("dim, spread", [(5, 1.0), (40, 1.0), (200, 0.97), (200, 1.0)])
def test_iteration_finds_the_leading_components(dim, spread):
    random = np.random.default_rng(dim)
    turn = np.linalg.qr(random.standard_normal((dim, dim)))[0]
    values = spread ** np.arange(dim) * np.linspace(2, 1, dim)
    matrix = turn * values @ turn.T
    passes = []
    found, vectors, count = whitening.leading(lambda q: passes.append(q.shape[1]) or matrix @ q, dim, 16)
    k = min(16, dim)
    assert np.allclose(found, values[:k], rtol=1e-12) and np.abs(np.abs((vectors * turn[:, :k]).sum(0)) - 1).max() < 1e-10
    assert count == len(passes) and max(passes) <= dim


def test_nulls_copies_and_other_lengths(spark):
    random = np.random.default_rng(1)
    good = [[float(v) for v in random.standard_normal(4)] for _ in range(30)]
    bad = [None, [1.0, None, 2.0, 3.0], [math.nan, 1.0, 2.0, 3.0], [math.inf, 0.0, 0.0, 0.0], [], [1.0, 2.0]]
    rows = [(k, v, k * 10) for k, v in enumerate(good)] + [(k, good[0], -1) for k in range(100, 160)] + [(None, good[1], None)] + [(900 + k, v, 0) for k, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, v array<float>, x long").withColumnsRenamed({}).withColumn("row", F.lit("kept")).withColumn("out", F.col("vec_id"))
    model = whitening.fit_whitening(table, "v", 3)
    n, deviation, whitened, _ = plain(np.array(good, np.float32), 3)
    found = whitening.whiten(table, model, "v")
    assert model.n == n == 30 and found.columns == ["vec_id", "v", "x", "row", "out", "deviation", "whitened"]
    got = {(r.vec_id, r.x): r for r in found.collect()}
    assert len(got) == 91 and {r.row for r in got.values()} == {"kept"} and all(r.out == r.vec_id for r in got.values())
    assert [got[k, k * 10].deviation for k in range(30)] == list(deviation)
    w = np.array([got[k, k * 10].whitened for k in range(30)])
    assert np.abs(w * np.sign((w * whitened).sum(0)) - whitened).max() < 1e-9
    assert got[120, -1].whitened == got[0, 0].whitened


def test_empty_tables_and_vectors_without_variance(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.fit_whitening(empty) is None and whitening.whiten(empty, None).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(same)
    assert model.n == 1 and len(model.values) == 0
    assert [tuple(r) for r in whitening.whiten(same, model).select("deviation", "whitened").collect()] == [(0, [])] * 2
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)], "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(line)
    assert len(model.values) == 1 and model.explained[0] == pytest.approx(1, abs=1e-12) and model.identity_error < 1e-10


def test_deviations_beyond_a_long(spark):
    rows = [(k, [1e9 * k, 1.0]) for k in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whitening.whiten(table, whitening.fit_whitening(table)).collect()
    plainly = [sum((3 * v - s) ** 2 for v, s in zip((64 * 10**9 * k, 64), (64 * 3 * 10**9, 192), strict=True)) for k in range(3)]
    assert [r.deviation for r in found] == [v if v < 2**63 else None for v in plainly]
