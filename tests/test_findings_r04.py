"""Findings of the fourth review, each in a small form that failed before."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_runs_are_grouped_by_their_holders(spark, monkeypatch):
    """runs of letters are shuffled by shares, what is kept is a row for each set of holders, and both say what the plain form says."""
    from latticeq.operators import clustering

    rng = random.Random(5)
    base = ["".join(rng.choice("abéж") for _ in range(300)) for _ in range(4)]
    own = [base[0], base[0][:280], base[1] + base[0][100:200], base[2], base[2][5:] + base[1][:50], base[3], "ab", ""]
    texts = spark.createDataFrame([(k, s, len(s)) for k, s in enumerate(own)], "number bigint, sequence string, n int")
    name, plain = clustering._shared_runs(texts.select(F.col("number").alias("id"), "sequence", "n"), 12, clustering.Window.partitionBy("key").orderBy(F.col("id").desc()))
    want: dict[tuple, int] = {}
    for row in plain.groupBy("key").agg(F.sort_array(F.collect_list("id"), False).alias("h")).collect():
        want[tuple(row.h)] = want.get(tuple(row.h), 0) + 1
    spark.sql(f"DROP TABLE {name}")
    for share, letters in ((1 << 22, 1 << 20), (100, 350)):
        monkeypatch.setattr(clustering, "SHARE", share)
        monkeypatch.setattr(clustering, "LETTERS", letters)
        rows = clustering._holders(texts, 12, sum(map(len, own))).collect()
        found: dict[tuple, int] = {}
        for row in rows:
            found[tuple(row.holders)] = found.get(tuple(row.holders), 0) + row.weight
        assert found == want
        if share > 100:
            assert len(rows) <= len(want) * spark.sparkContext.defaultParallelism < sum(want.values()) / 2  # runs of a passage are one row of a task
    assert len(want) > 3


def test_later_rounds_from_holders():
    """leaders of earlier rounds, and what joined a longer one, leave a run in the order of the rounds."""
    from latticeq.operators import clustering

    keys, numbers = np.array([7, 7, 7, 7, 9, 9, 3], np.uint64), np.array([1, 5, 3, 5, 2, 4, 0], np.int32)
    (batch,) = clustering._lists(keys, numbers)
    assert sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) == [([4, 2], 1), ([5, 3, 1], 1)]


@pytest.mark.parametrize("k", [1, 2, 3, 6, 12, 13])
def test_hashes_of_runs(k):
    from latticeq.operators import clustering

    rng = random.Random(k)
    texts = ["".join(rng.choice("ab\U0001f600") for _ in range(n)) for n in (0, 40, k - 1, k, 200, 1)]
    h, owner = clustering._hashes(texts, k)
    runs = [(i, x[at : at + k]) for i, x in enumerate(texts) for at in range(len(x) - k + 1)]
    assert owner.tolist() == [i for i, _ in runs]
    assert len({*zip(h.tolist(), (x for _, x in runs), strict=True)}) == len({*h.tolist()}) == len({x for _, x in runs})


def test_structures_are_not_copied_for_each_pair(spark, tmp_path):
    """No shuffle is between structures and the rows made of their pairs, which would carry a structure for each of them."""
    import __spark_entry__

    for name in ("N11_similarity_statistics", "N12_similarity_matrix", "N13_standardised", "N15_mixed_matrix", "R22_dense_clamp", "X6_distances", "X9_radial_basis"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan, name


def test_matrices_that_are_solved_at_once_are_few(spark, monkeypatch):
    """strips of a step, those of the step before and a shuffle lie on disk together, so at most 2 GB of them, or those of one coupling."""
    from latticeq.operators import couplings

    waves = []
    monkeypatch.setattr(couplings, "_solved", lambda spark, rows, strips: waves.append(strips.sizes) or [(0.0, 0.0)] * len(strips.sizes))
    pairs = spark.range(20).withColumn("x", F.array_repeat(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), 2900)).withColumn("y", F.col("x"))
    found = couplings.coupled(pairs, ["id"], lambda row: iter([("a", {"x": row["x"], "y": row["y"]})]))
    assert len(found) == 20 and sum(map(len, waves)) == 20
    assert max(3 * 8 * sum(n * m for n, m in sizes) for sizes in waves) < 2e9


def test_pairs_are_aligned_from_parts(spark, monkeypatch):
    """What is shuffled for a pair are parts of its sides, and scores are those of whole matrices; a side without a matrix has no score."""
    from latticeq.functions import udfs

    monkeypatch.setattr(udfs, "PART", 7)
    rng = np.random.default_rng(2)
    sides = {k: rng.normal(size=(n, 5)) for k, n in (("a", 20), ("b", 7), ("c", 33))}
    rows = [(k, v.astype(np.float32).astype(float).tolist(), (v * v).tolist()) for k, v in sides.items()] + [("d", None, [[1.0] * 5])]
    own = spark.createDataFrame(rows, "id string, one array<array<double>>, two array<array<double>>")
    parts = udfs.parts(own, "one", "two")
    assert {(r.id, r.part) for r in parts.collect()} == {("a", 0), ("a", 1), ("a", 2), ("b", 0), *(("c", k) for k in range(5)), ("d", 0)}
    pairs = spark.createDataFrame([(q, t) for q in "abcd" for t in "abcd" if q != t], "query string, target string")
    settings = [(0.25, 1.0, 0.5), (0.0, 2.0, 1.0)]
    named = [own.select(F.col("id").alias(side), *(F.col(v).alias(f"{side}_{v}") for v in ("one", "two"))) for side in ("query", "target")]
    want = udfs.alignment_grid(pairs.join(named[0], "query").join(named[1], "target"), settings, [("query_one", "target_one"), ("query_two", "target_two")])
    found = udfs.part_grid(pairs, parts, settings, ["one", "two"])
    keys = ["query", "target", "shift"]
    assert found.orderBy(*keys).collect() == want.orderBy(*keys).collect() and found.count() == 12
