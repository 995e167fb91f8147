"""What the third review found in results."""

from latticeq.sources import sinks


def test_pack_with_names_that_rows_share(spark, tmp_path):
    rows = [("b", 2), ("a", 1), ("b", 1), ("c", 5), ("b", 3)]
    sinks.write_shards(spark.createDataFrame(rows, "name string, x int"), str(tmp_path / "p"), "name", 2, unique=False)
    assert sorted(tuple(r) for r in sinks.read_shards(spark, str(tmp_path / "p"), ["b"]).collect()) == [("b", 1), ("b", 2), ("b", 3)]
    placed = sorted((r.place, r.shard, r.name, r.x) for r in sinks.read_shards(spark, str(tmp_path / "p"), places=True).collect())
    assert [x[2:] for x in placed] == [("a", 1), ("b", 1), ("b", 2), ("b", 3), ("c", 5)]


def test_patches_of_copies_are_made_in_strips(spark, monkeypatch):
    """Many points in one place: ties by index, and no join of all pairs of points in the plan."""
    import numpy as np
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from latticeq.operators import geometry

    places = np.random.default_rng(2).normal(0, 10, (40, 3))
    rows = [(k % 2, 3 * (k // 2), *(float(x) for x in places[k % 40 if k < 160 else 7])) for k in range(200)]
    points = spark.createDataFrame(rows, "id bigint, idx bigint, x double, y double, z double")
    monkeypatch.setattr(geometry, "ASKED", 32)
    own = geometry.patches(points, 9)
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    order = Window.partitionBy("id", "i").orderBy(F.col("i") != F.col("j"), "distance", "j")
    want = geometry.pair_distances(points).withColumn("place", F.row_number().over(order)).where("place <= 9")
    assert {tuple(r) for r in own.collect()} == {tuple(r) for r in want.collect()}


def test_equal_values_have_no_spread(spark):
    """Means joined from parts of 49 rows miss 1 by their rounding, as 49 * (1 / 49) does, so the spread of equal values is not 0."""
    from pyspark.sql import functions as F

    from latticeq.operators import metrics

    rows = spark.createDataFrame([(k, float(k % 7), 1.0) for k in range(4 * 49)], "k int, p double, t double").repartitionByRange(4, "k")
    assert rows.agg(F.stddev_pop("t")).first()[0] > 0
    found = rows.agg(metrics.pearson(F.col("p"), F.col("t")).alias("one"), metrics.pearson(F.lit(1.0), F.col("p")).alias("other"), metrics.variance(F.col("t")).alias("v"), metrics.pearson(F.col("p"), -F.col("p")).alias("whole")).first()
    assert (found.one, found.other, found.v, round(found.whole, 9)) == (None, None, 0.0, -1.0)
    assert metrics.regression(rows, "p", "t", spearman=False).first().r2 is None


def test_matrix_scores_move_residues_by_bounded_blocks(spark):
    """Small strips of a matrix do not make small blocks: at 120,000 residues, each moved 938 times a side before."""
    import numpy as np

    from latticeq.functions import kernels
    from latticeq.operators import search

    for total in (2_000, 120_000, 720_000):
        assert -(-total // search.block_side(total, 1 << 16)) <= max(search.PARALLEL, -(-total // search.RESIDUES))
    rng = np.random.default_rng(4)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(7, 5)), rng.normal(size=(12, 5))))
    found = kernels.run_statistics(a, b, np.array([0, 1, 6]))
    for k, part in enumerate((b[:1], b[1:6], b[6:])):
        np.testing.assert_allclose(found[:, k], kernels.product_statistics(a, part)[[0, 2, 1, 3, 4]], atol=1e-12)
    names = {f"s{k}": rng.normal(size=(40 + k, 5)) for k in range(3)}
    table = spark.createDataFrame([(k, v.tolist()) for k, v in names.items()], "id string, vecs array<array<double>>")
    plain, strips = ({(r.query, r.target): tuple(r)[2:] for r in search.matrix_scores(table, cells=1 << 16, temperature=t).collect()} for t in (0.01, 0.0099999999))
    assert all(np.allclose(plain[k], strips[k], atol=2e-6) for k in plain) and len(plain) == len(strips) == 6


def test_distances_of_a_long_structure_are_dealt_to_tasks(spark, monkeypatch):
    """No join on the structure, whose key would hold all its pairs; missing coordinates give null, those that are no numbers do not."""
    import math

    from latticeq.operators import geometry

    places = [(1.0, 2.0, 3.0), (4.0, 6.0, 3.0), (None, 0.0, 0.0), (float("nan"), 0.0, 0.0), (1.0, 2.0, 4.0)]
    points = spark.createDataFrame([(7, 2 * k, *p) for k, p in enumerate(places)] + [(8, 5, 0.0, 0.0, 0.0)], "id bigint, idx bigint, x double, y double, z double")
    monkeypatch.setattr(geometry, "PAIRED", 2)

    def far(a, b):
        return None if None in a + b else math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b)))

    want = {(7, 2 * i, 2 * j): far(p, q) for i, p in enumerate(places) for j, q in enumerate(places)} | {(8, 5, 5): 0.0}
    own = geometry.pair_distances(points)
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert repr(sorted({(r.id, r.i, r.j): r.distance for r in own.collect()}.items())) == repr(sorted(want.items()))
    later = geometry.pair_distances(points, digits=1, later=True).collect()
    assert repr(sorted((r.id, r.i, r.j, r.distance) for r in later)) == repr(sorted((*k, v if v is None else round(v, 1)) for k, v in want.items() if k[1] < k[2]))
    codes = {(r.id, r.i, r.j): r.code for r in geometry.pair_distances(points, centres=3, most=4.0).collect()}
    assert codes.keys() == want.keys() and codes[7, 0, 4] == [None] * 3 and codes[7, 0, 2] == [math.exp(-(((5.0 - k * 2) / 2) ** 2)) for k in range(3)]


def test_pairs_of_a_large_group_are_dealt_to_tasks(spark, monkeypatch):
    """No join on the group, whose key would hold all its pairs."""
    from latticeq.operators import joins

    monkeypatch.setattr(joins, "PAIRED", 2)
    nodes = [("a", "p"), ("a", "q"), ("a", "q"), ("a", None), ("a", "r"), (None, "p"), (None, "q"), ("b", "p"), ("c", None)]
    own = joins.node_pairs(spark.createDataFrame(nodes, "g string, v string"), "g", "v")
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    want = [(g, v, w) for g, v in nodes for h, w in nodes if g is not None and g == h and None not in (v, w) and v != w]
    assert sorted(tuple(r) for r in own.collect()) == sorted(want) and own.columns == ["g", "i", "j"]


def test_cosines_of_all_pairs_come_in_blocks(spark, monkeypatch):
    """Scores are as the plain expression has them, with nulls, other lengths and ids of another type."""
    from pyspark.sql import functions as F

    from latticeq.functions import exprs
    from latticeq.operators import search

    monkeypatch.setattr(search, "ASKING", 2)
    monkeypatch.setattr(search, "ANSWERING", 3)
    vecs = [[1.0, 2.0, -1.0], [0.5, 0.0, 3.0], None, [1.0, None, 2.0], [2.0, 1.0], [], [-4.0, 0.1, 0.2], [1e-9, -1.0, 0.0]]
    table = spark.createDataFrame([(f"v{k}", v) for k, v in enumerate(vecs)], "id string, vec array<double>")
    own = search.cosine_pairs(table.where("id < 'v5'"), table)
    a, b = (table.select(F.col("id").alias(n), exprs.unit(F.col("vec")).alias(s)) for n, s in (("query", "a"), ("target", "b")))
    plain = a.where("query < 'v5'").crossJoin(b).select("query", "target", F.round(exprs.dot(F.col("a"), F.col("b")), 6).alias("score"))
    assert sorted(map(repr, own.collect())) == sorted(map(repr, plain.collect()))
    assert "MapInArrow" in own._jdf.queryExecution().optimizedPlan().toString()


def test_patches_of_items_are_made_in_strips(spark):
    """As a sort of all points for every residue has them: ties by number, points without coordinates first."""
    from pyspark.sql import functions as F

    from latticeq.functions import exprs
    from latticeq.operators import loader

    points = [[float(k % 3), float(k % 5), 1.0] for k in range(20)] + [None, [1.0, None, 2.0], [float("nan"), 0.0, 0.0]]
    rows = [("a", "b", points, points[:4], [(3, 0), (3, 1), (19, 3), (0, 2), (20, 2), (22, 1)]), ("c", "d", points[:2], points, [(1, 7)])]
    table = spark.createDataFrame(rows, "id1 string, id2 string, points1 array<array<double>>, points2 array<array<double>>, x array<struct<r1: bigint, r2: bigint>>")

    def plain(points, residue):
        apart = F.transform(points, lambda p, j: F.struct((j != residue).alias("other"), exprs.distance(p, F.get(points, residue.cast("int"))).alias("d"), j.alias("j")))
        return F.transform(F.slice(F.sort_array(apart), 1, 9), lambda x: x["j"])

    want = table.select("id1", F.transform("x", lambda x: plain(F.col("points1"), x["r1"])).alias("patch1"), F.transform("x", lambda x: plain(F.col("points2"), x["r2"])).alias("patch2"))
    own = loader.with_patches(table, 9)
    assert sorted(map(repr, own.select("id1", "patch1", "patch2").collect())) == sorted(map(repr, want.collect()))
    assert "MapInArrow" in own._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_one_holder_are_not_written(spark, monkeypatch):
    """of sequences that share few runs, no table that is written has a row for each run."""
    import random

    from latticeq.operators import clustering

    rng = random.Random(3)
    base = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(150)) for _ in range(12)]
    written, own = [], clustering.stored
    monkeypatch.setattr(clustering, "stored", lambda df: written.append(own(df)) or written[-1])
    rows = [*enumerate(base), (50, base[3][:140]), (51, "Q" + base[4][1:])]
    found = clustering.sequence_clusters(spark.createDataFrame(rows, "id long, sequence string"), k=12)
    assert {r.member: r.representative for r in found.collect()} == {**{k: k for k in range(12)}, 50: 3, 4: 51, 51: 51}
    assert max(df.count() for df in written) <= len(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("latticeq_runs")]
    name, shared = clustering._shared_runs(spark.createDataFrame([(k, s, len(s)) for k, s in rows], "id long, sequence string, n int"), 12, clustering.Window.partitionBy("key").orderBy("n"))
    assert {r.id for r in shared.collect()} == {3, 50, 4, 51}
    spark.sql(f"DROP TABLE {name}")


def test_groups_that_come_whole_are_not_put_into_state(spark, tmp_path):
    """state is for groups that come in parts; values come out as they came."""
    import datetime

    from latticeq.streaming import incremental

    source, target, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    at = lambda hour: datetime.datetime(2024, 1, 1, hour, 0, 0, 123456)
    updated = []
    for part in ([(k, 3, None if k % 2 else f"v{k}", at(k % 3 + i)) for k in range(20) for i in range(3)] + [(50, 2, "x", at(1))], [(50, 2, None, at(5)), (51, 1, "y", at(6))]):
        spark.createDataFrame(part, "k long, size int, v string, t timestamp").coalesce(1).write.mode("append").parquet(source)
        with incremental.keyed_state(spark):
            stream = incremental.whole_groups(incremental.file_stream(spark, source), "k", "size", "t", "9h", "1 hour").writeStream
            query = stream.foreachBatch(incremental.into(target)).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
        updated.append(max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]))
    found = [tuple(r) for r in spark.read.parquet(target).drop("batch").collect()]
    whole = [(k, 3, None if k % 2 else f"v{k}", at(k % 3 + i), 1, True) for k in range(20) for i in range(3)]
    assert sorted(found, key=str) == sorted([*whole, (50, 2, "x", at(1), 2, True), (50, 2, None, at(5), 2, True), (51, 1, "y", at(6), 1, True)], key=str)
    assert max(updated) <= 6  # the rows, facts and timer of group 50


def test_files_that_need_not_be_whole_are_cut(spark):
    """a file's rows are not one task's; a query's lines stay in one file, in order."""
    from pyspark.sql import functions as F

    from latticeq.plans import files

    own = spark.range(6000).select(F.lit("0").alias("part"), (F.col("id") % 300).alias("q"), F.concat_ws("\t", (F.col("id") % 300).cast("string"), F.col("id").cast("string"), F.lit("1")).alias("line"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        where = files._written(spark, own, "part", "q", whole=False)
    finally:
        spark.conf.set(setting, before)
    rows = spark.read.format("hits").load(where)
    assert rows.select("file").distinct().count() > 1
    assert rows.count() == 6000 and rows.groupBy("query").agg(F.countDistinct("file").alias("n")).where("n > 1").isEmpty()


def test_hits_leave_once_while_targets_fit(spark, monkeypatch):
    """A query meets all targets in one task while a task holds them, however many blocks of queries there are."""
    import numpy as np

    from latticeq.operators import search

    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.random.default_rng(4).normal(size=(120, 8)))]
    own, scored, top_k = spark.createDataFrame(rows, "id long, vec array<double>"), [], search.top_k
    want = sorted(map(tuple, search.blocked_top_k(own, 5).collect()))
    monkeypatch.setattr(search, "FEWEST", 10)
    monkeypatch.setattr(search, "top_k", lambda df, k: scored.append(df) or top_k(df, k))
    assert sorted(map(tuple, search.blocked_top_k(own, 5).collect())) == want
    assert scored[0].count() == 120 * 5
    monkeypatch.setattr(search, "MOST", 15)  # two gatherings of four such blocks
    assert sorted(map(tuple, search.blocked_top_k(own, 5).collect())) == want
    monkeypatch.setattr(search, "MOST", 10)
    assert sorted(map(tuple, search.blocked_top_k(own, 5).collect())) == want and scored[2].count() == 3 * 120 * 5
