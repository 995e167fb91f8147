import math

import numpy as np
from pyspark.sql import functions as F

from latticeq.operators import audits, ids, joins, metrics, sampling
from latticeq.sources import sinks, text


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_ids(spark):
    pairs = spark.createDataFrame([(0, " a ", "b"), (1, "b", "nan"), (2, "", "c"), (3, None, "a")], "row long, x string, y string")
    assert rows(ids.distinct_ids(pairs, ["x", "y"]), "id") == [("a",), ("b",), ("c",)]
    assert ids.scan_extent(pairs, "row").first()[:] == (4, 3) and ids.scan_extent(pairs.limit(0), "row").first()[:] == (0, None)
    assert (("b", 1)) in rows(ids.first_seen(pairs, "row", ["x", "y"]), "id", "first_seen")
    members = spark.createDataFrame([("m", "r1", 1), ("m", "r2", 2), ("n", "r1", 3)], "member string, rep string, line int")
    assert rows(ids.cluster_map(members, "member", "rep", "line"), "member", "rep") == [("m", "r2"), ("n", "r1")]
    values = spark.createDataFrame([(1, "", 0), (1, "v", 1), (1, "w", 2), (2, None, 0)], "k int, v string, o int")
    assert rows(ids.first_value(values, "k", "v", ["o"], True), "k", "v") == [(1, "v")]
    assert rows(ids.first_value(values, "k", "v", ["o"], False), "k", "v") == [(1, ""), (2, None)]
    wanted = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    assert rows(ids.missing(wanted, wanted.where("id = 2"), "id"), "id") == [(1,), (None,)]
    assert rows(ids.present_in_all("id", wanted, wanted.where("id = 1")), "id") == [(1,)]
    assert ids.next_shard(wanted.limit(0), "id").first()[0] == 0 and ids.next_shard(wanted, "id").first()[0] == 3
    status = ids.status((F.col("id") > 1, "large"), (F.col("id").isNull(), "none"), otherwise="small")
    assert sorted(r.s for r in wanted.select(status.alias("s")).collect()) == ["large", "none", "small", "small"]


def test_joins(spark):
    one = spark.createDataFrame([(1,), (2,), (2,), (5,)], "id int")
    other = spark.createDataFrame([(2,), (3,), (4,)], "id int")
    assert {r.kind: r.n for r in joins.coverage(one, other, "id").collect()} == {"present": 1, "missing": 2, "extra": 2}
    assert {r.kind: r.n for r in joins.coverage(one.limit(0), other.limit(0), "id").collect()} == {"present": 0, "missing": 0, "extra": 0}
    counts = spark.createDataFrame([(2, 7)], "id int, n int")
    assert rows(joins.reindexed(other, counts, "id", "n"), "id", "n") == [(2, 7), (3, 0), (4, 0)]
    both = joins.by_method({"a": counts, "b": counts.withColumn("id", F.lit(9))}, "id", "n")
    assert rows(both, "id", "a", "b") == [(2, 7, 0), (9, 0, 7)]
    nodes = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "g int, v string")
    assert rows(joins.node_pairs(nodes, "g", "v"), "i", "j") == [("p", "q"), ("q", "p")]
    known = spark.createDataFrame([(1, 5, 2), (1, 6, 1)], "k int, v int, o int")
    assert rows(joins.first_match(one, known, "id", "k", "v", ["o"]), "id", "v") == [(1, 6), (2, None), (2, None), (5, None)]
    cells = joins.by_distance(spark.createDataFrame([(0, 3)], "i int, p int"), spark.range(50).select(F.col("id").cast("int").alias("j")), "i", "j", "p", 32)
    assert {r.j: r.cell for r in cells.collect()} == {j: "aligned" if j == 3 else "near" if abs(j - 3) <= 32 else "far" for j in range(50)}


def test_audits(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 4.0), (5, "3.5", None)], "k int, s string, v double")
    assert rows(audits.histogram(df, "k", "k"), "k", "n") == [(1, 2), (2, 1), (5, 1)]
    assert audits.top_values(df, F.col("s"), "s", 1).first()[:] == ("a", 2)
    assert audits.distinct_counts(df, keys="k", texts="s").first()[:] == (3, 3, 4)
    assert audits.group_sizes(df, "k").first()[:] == (1, 1.0, 2, round(4 / 3, 6), 2)
    assert audits.duplicates_and_gaps(df, "k").first()[:] == (1, 5, 2)
    assert audits.ranges(df, "v", "s").first()[:] == (1.0, 4.0, 1, 3)
    assert {r.s: r.share for r in audits.shares(df, F.col("s"), "s").collect()} == {"a": 50.0, "b": 25.0, "3.5": 25.0}
    assert audits.cluster_summary(df, "k").first()[:] == (4, 3, round(4 / 3, 6))
    assert audits.failure_gate(df, F.col("k") == 5).first()[:] == (4, 1, False) and audits.failure_gate(df, F.col("k") == 7).first()[2]
    assert audits.verified(df.where("k > 1"), df.where("k > 1").withColumn("v", F.lit(4.0)), "k", "v").first()[:] == (1, 2)
    assert rows(audits.changed(df.where("k > 1"), df.where("k > 1").withColumn("v", F.lit(4.0)), "k", "v"), "k", "saved", "current") == [(5, None, 4.0)]
    assert rows(audits.unequal(df.select("k", "v"), df.where("k < 5").select(F.col("k").alias("a"), F.col("v").alias("b"))), "k", "v") == [(5, None)]
    assert math.isclose(sum(r.p for r in audits.softmax(df.where("k = 1"), "v", 1.0, "k", "p").collect()), 1)
    assert {r.v: round(r.z, 3) for r in audits.z_scores(df.where("k = 1"), "v", "k", "z").collect()} == {1.0: -1.0, 2.0: 1.0}
    assert audits.text_lengths(spark.createDataFrame([("", 0), (" ", 1), ("ab", 3), (None, 1)], "t string, n int"), "t", "n").first()[:] == (1, 1, 2)
    assert rows(audits.best_configs(df.where("v is not null"), "s", 1, a="v"), "s", "a") == [("a", 2.5)]


def test_reports_and_runs(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, float(i), float(i) + (i % 2)) for i in range(10)], "i int, m boolean, p double, t double")
    assert rows(metrics.report_block(df, "p", "t"), "name", "value") == [("bias", -0.5), ("mse", 0.5), ("n", 10.0)]
    assert {r.kind: r.n for r in metrics.validation(df.withColumn("kind", F.when(F.col("i") == 9, "alone").otherwise("many")), "p", "t", "kind").collect()} == {"overall": 10, "many": 9}
    order = spark.createDataFrame(list(enumerate([5.0, 4.0, 4.0, 6.0, 1.0])), "i int, v double")
    assert [r.best for r in metrics.best_so_far(order, "i", "v").orderBy("i").collect()] == [True, True, False, False, True]
    assert df.agg(metrics.distillation(F.col("p"), F.lit(False)).alias("x")).first().x == 0
    assert rows(sampling.offsets(df.withColumn("g", F.col("i") % 3), "g"), "g", "first") == [(0, 0), (1, 4), (2, 7)]
    assert [r.i for r in sampling.every(df, ["i"], 4, 1).orderBy("i").collect()] == [1, 5, 9]
    assert {r.i: r.block for r in sampling.blocks(df, ["i"], 4).collect()} == {i: i // 4 for i in range(10)}
    box = metrics.box_statistics(spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)], "k string, v double"), "v", ("k",)).first()
    assert (box.q1, box.q2, box.q3, box.low, box.high) == (2.0, 3.0, 4.0, 1.0, 4.0)
    time = metrics.timing_summary(spark.createDataFrame([("a", float(x)) for x in range(10)], "k string, v double"), "v", ("k",)).first()
    assert (time.n, time.median, time["mean"], time.p90, time.total) == (10, 4.5, 4.5, 8.0, 45.0)


def test_csv_columns_and_text_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 2.5), (2, None, None)], "a int, b string, c double")
    sinks.write_table(df, f"{tmp_path}/t")
    assert rows(text.csv_columns(spark, f"{tmp_path}/t", df.schema, ["c", "a"]), "a", "c") == [(1, 2.5), (2, None)]
    assert [r.line for r in sinks.text_table(df).orderBy("part", "key").collect()] == ["a  b  c", "1  x  2.5", "2  -  -"]


def _places(df, order):
    rows = df.collect()
    return [tuple(r[c] for c in order) for r in sorted(rows, key=lambda r: r["number"])], [r["number"] for r in rows]


def test_places_by_any_orderable_key(spark):
    from pyspark.sql import functions as F

    from latticeq.operators import sampling

    rows = spark.range(5000).select(
        F.col("id"), F.concat(F.lit("P"), F.lpad((F.col("id") * 7919 % 5000).cast("string"), 5, "0")).alias("name"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 31 % 900).cast("int")).alias("day"),
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("skewed"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("holes"),
    )
    for order in (["name"], ["day", "name"], ["skewed"], ["holes", "day"]):
        got, numbers = _places(sampling.numbered(rows.select("id", *order), order), order)
        plain = sorted((tuple(r) for r in rows.select(*order).collect()), key=lambda t: [(x is not None, x) for x in t])
        assert got == plain and sorted(numbers) == list(range(5000))


def test_ranges_split_a_value_of_half_of_the_rows(spark):
    from pyspark.sql import functions as F

    from latticeq.operators import sampling

    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("key"))
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        sizes = [r["count"] for r in sampling.ranged(rows, "key").groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) == 50 and max(sizes) < 2 * 20_000 / 50


def test_a_pack_survives_a_lost_index(spark, tmp_path):
    import shutil

    from latticeq.sources import sinks

    path, own = f"{tmp_path}/pack", spark.range(20).selectExpr("concat('P', lpad(id * 7, 4, '0')) name", "id v")
    sinks.write_shards(own, path, "name", 3)
    shutil.rmtree(f"{path}/manifest")  # the write broke off before its last step
    sinks.write_shards(own, path, "name", 3)
    assert sorted(map(tuple, sinks.read_shards(spark, path).collect())) == sorted(map(tuple, own.collect()))
    sinks.write_shards(own.union(own).union(own.selectExpr("concat('Q', name) name", "v")), path, "name", 2)
    found = sinks.read_shards(spark, path, places=True).collect()
    assert len(found) == 40 and {r.shard for r in found if r.name.startswith("Q")} == {3, 4}
    assert [r.v for r in sinks.read_shards(spark, path, ["P0014", "QP0133", "none"]).orderBy("name").collect()] == [2, 19]


def test_parts_and_batches_are_written_once(spark, tmp_path):
    from latticeq.sources import sinks
    from latticeq.streaming import incremental

    own = spark.range(6).selectExpr("id", "id * 2 v")
    for k in (0, 1, 1):
        sinks.append_csv(own.where(f"id % 2 = {k}"), f"{tmp_path}/csv", str(k))
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 6
    own.coalesce(1).write.parquet(f"{tmp_path}/in")
    failed = []

    def breaks(batch, number):
        incremental.into(f"{tmp_path}/out")(batch, number)
        if not failed:
            failed.append(number)
            raise RuntimeError("lost after the write")

    for _ in range(2):
        try:
            incremental.run_available(incremental.file_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/state", breaks)
        except Exception as error:
            assert "lost after the write" in str(error)
    assert failed and incremental.appended(spark, f"{tmp_path}/out").count() == 6


def _plain_top(vec, ids, k):
    u = vec / (np.sqrt((vec**2).sum(1, keepdims=True)) + 1e-9)
    scores = np.round(np.clip(u @ u.T, -1, 1), 6)
    out = set()
    for q in range(len(ids)):
        best = sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-scores[q, j], ids[j]))[:k]
        out |= {(ids[q], ids[j], scores[q, j], rank) for rank, j in enumerate(best, 1)}
    return out


def test_pruned_search_gives_the_plain_rows_and_skips_cells(spark):
    from latticeq.operators import search

    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 8)) * 5
    clustered = np.concatenate([c + rng.standard_normal((40, 8)) * 0.05 for c in centres])
    clustered[7] = clustered[8]  # a tie
    for vec, skips in ((clustered, True), (rng.standard_normal((300, 8)), False)):
        ids = [f"v{(k * 37) % 1000:03d}" for k in range(len(vec))]
        table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vec, strict=True)] + [("none", None)], "id string, vec array<double>")
        found = search.pruned_top_k(table, 5, pivots=24)
        assert {tuple(r) for r in found.hits.collect()} == _plain_top(vec, ids, 5)
        assert found.visited < found.pairs / 3 if skips else found.visited <= found.pairs
    assert search.pruned_top_k(table.limit(0), 5).hits.count() == 0


def test_matrix_scores_of_pairs_in_blocks(spark):
    from latticeq.operators import search

    rng = np.random.default_rng(6)
    sizes = [1, 1, 2, 3, 5, 8, 13, 21, 34]
    structures = {f"s{k}": rng.standard_normal((n, 6)) for k, n in enumerate(sizes)}
    rows = [(name, v.tolist()) for name, v in structures.items()] + [("empty", []), ("none", None)]
    table = spark.createDataFrame(rows, "id string, vecs array<array<double>>")
    for cells in (1, 64, 1 << 20):
        got = {(r["query"], r["target"]): (r.row_best, r.row_soft, r.col_best, r.col_soft, r.mean_all) for r in search.matrix_scores(table, F.col("id").isin("s0", "s5", "s8"), cells).collect()}
        assert got.keys() == {(q, t) for q in ("s0", "s5", "s8") for t in structures if q != t}
        for (q, t), own in got.items():
            a, b = (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9) for v in (structures[q], structures[t]))
            s = a @ b.T
            soft = lambda m: (np.exp((m - m.max(1, keepdims=True)) / 0.1) * m).sum(1) / np.exp((m - m.max(1, keepdims=True)) / 0.1).sum(1)
            assert np.allclose(own, (s.max(1).mean(), soft(s).mean(), s.max(0).mean(), soft(s.T).mean(), s.mean()), atol=1e-6)
    assert search.matrix_scores(table.limit(0)).count() == 0


def test_split_bootstrap_draws_as_a_plain_one(spark):
    from latticeq.operators import search

    rng = np.random.default_rng(3)
    diff = rng.standard_normal(700) + 0.3
    rows = spark.createDataFrame([(f"q{k}", float(x), 0.0) for k, x in enumerate(diff)], "query string, a double, b double")
    counts = np.stack([search.picked(700, at, 100, 2000, 1) for at in range(7)])
    assert (counts.sum(0) == 700).all() and np.allclose(counts.mean(1), 100, atol=2) and np.allclose(counts.var(1), 700 * (1 / 7) * (6 / 7), rtol=0.15)
    one, other = (search.split_bootstrap(x, 2000, size=100).first() for x in (rows, rows.repartition(9)))  # seven ranges
    assert one == other and one.wins_a == int((diff > 0).sum()) and abs(one.difference - diff.mean()) < 1e-6
    plain = np.array([diff[rng.integers(0, 700, 700)].mean() for _ in range(4000)])
    assert abs(one.low - np.quantile(plain, 0.025)) < 0.01 and abs(one.high - np.quantile(plain, 0.975)) < 0.01
