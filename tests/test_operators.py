import math

import pytest
from pyspark.sql import functions as F

from latticeq.functions import exprs
from latticeq.operators import alignment, geometry, metrics, runs, sampling, search
from latticeq.sources import parquet, sinks, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hash_splits(spark):
    assert one(spark, exprs.stable_bucket(F.lit("P00001"))) == 49 and one(spark, exprs.stable_bucket(F.lit("anything"))) == 72
    ids = spark.range(3000).select(F.format_string("P%05d", "id").alias("id"))
    assert {r.s for r in ids.select(exprs.split_of(exprs.stable_bucket(F.col("id"))).alias("s")).distinct().collect()} == {"train", "val", "test"}


def test_scalar_golden_values(spark):
    assert one(spark, exprs.tm_d0(F.lit(10))) == 0.5
    assert math.isclose(one(spark, exprs.tm_d0(F.lit(141))), 1.24 * 126 ** (1 / 3) - 1.8)
    assert one(spark, exprs.tm_term(F.lit(0.0), F.lit(4.0))) == 1 and one(spark, exprs.tm_term(F.lit(4.0), F.lit(4.0))) == 0.5
    assert one(spark, exprs.distance(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0)))) == 5
    assert [one(spark, exprs.calibrated(F.lit(c))) for c in (1.0, 0.0, -1.0)] == [1.0, 0.5, 0.0]
    assert one(spark, exprs.similarity(F.lit(0.0))) == 1 > one(spark, exprs.similarity(F.lit(0.01))) > one(spark, exprs.similarity(F.lit(0.02))) > 0
    numbers = [1.5, -2.0, 3.25] * 4
    code = exprs.encode_numbers(F.array(*(F.lit(x) for x in numbers)))
    assert one(spark, exprs.decode_numbers(code)) == numbers
    with pytest.raises(Exception, match="expected 12 numbers"):
        one(spark, exprs.decode_numbers(F.lit("1 2 3")))
    with pytest.raises(ValueError, match="unknown target"):
        exprs.target("other", F.lit(1), F.lit(1), F.lit(1))
    assert one(spark, exprs.method_name(F.lit("a/b/run.tsv.gz"))) == "run"
    assert one(spark, exprs.valid_id(F.lit(" NaN "))) is False and one(spark, exprs.valid_id(F.lit(None).cast("string"))) is False


def test_aligned_pairs(spark):
    df = spark.createDataFrame([(1, "AB-CD", ":::::", "A-BCD"), (2, "ABCD", ":X::", "ABCD")], "k int, a string, m string, b string")
    rows = [(r.k, r.pos, r.i, r.j) for r in alignment.aligned_pairs(df, "k", "a", "m", "b").orderBy("k", "pos").collect()]
    assert rows == [(1, 0, 0, 0), (1, 3, 2, 2), (1, 4, 3, 3), (2, 0, 0, 0), (2, 2, 2, 2), (2, 3, 3, 3)]
    pairs = alignment.aligned_pairs(df, "k", "a", "m", "b")
    runs_ = alignment.segments(pairs, "k")
    assert runs_.count() == 4 and alignment.expanded(runs_, "k").select("k", "i", "j").exceptAll(pairs.select("k", "i", "j")).count() == 0
    with pytest.raises(Exception, match="unequal lengths"):
        alignment.aligned_pairs(df.withColumn("b", F.lit("AB")), "k", "a", "m", "b").collect()
    assert {r.k: r.identity for r in alignment.identity(df, "k", "a", "b").collect()} == {1: 1.0, 2: 1.0}


def test_negatives_alternate_and_leave_the_path(spark):
    pairs = spark.range(100).select(F.lit(7).alias("k"), F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("i"), (F.col("id") + 3).cast("int").alias("j"), F.lit(110).alias("size"))
    rows = alignment.negatives(pairs.drop("k").withColumn("key", F.lit(7)), "key", "size", stride=10).collect()
    positive, negative = [r for r in rows if r.pair_type == "aligned"], sorted((r for r in rows if r.pair_type != "aligned"), key=lambda r: r.k)
    assert len(positive) == len(negative) == 10
    assert [r.pair_type for r in negative] == ["shifted", "random"] * 5
    assert all(r.pos == -1 and r.j != r.i + 3 and 0 <= r.j < 110 for r in negative)
    assert all(4 <= abs(r.j - r.i - 3) <= 32 for r in negative if r.pair_type == "shifted")


def domains(spark):
    rows = [(i, f"f{'abcd'[i // 2]}", f"s{i // 4}", "x") for i in range(8)] + [(8, "fe", "s2", "x"), (9, "ff", "s3", "y")]
    return spark.createDataFrame(rows, "id long, family string, superfamily string, fold string")


def test_sensitivity_traps(spark):
    # query 0: family mate 1, superfamily mates 2 and 3, fold mates 4..8; 9 is of another fold, 77 is unknown
    hits = [(0, 0, 1), (0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 4, 5), (0, 77, 6), (0, 3, 7), (55, 1, 1), (2, 9, 1), (2, 3, 2)]
    out = {r["query"]: r for r in search.sensitivity(spark.createDataFrame(hits, "query long, target long, rank int"), domains(spark)).collect()}
    assert (out[0].family, out[0].superfamily, out[0].fold) == (1.0, round(1 / 3, 6), round(1 / 6, 6))  # denominators one more than the members
    assert (out[2].family, out[2].superfamily) == (0.0, 0.0)  # the false positive comes first
    assert 55 not in out and out[4].family == 0.0 and 8 not in out  # unknown and ineligible queries are left out, others without hits score 0
    recall = {r["query"]: r for r in search.recall_at(spark.createDataFrame(hits, "query long, target long, rank int"), domains(spark), 7).collect()}
    assert (recall[0].family, recall[0].superfamily, recall[0].fold) == (1.0, 1.0, 0.2)


def test_blocked_search_equals_plain_search(spark):
    rng = __import__("random").Random(1)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, None)], "id long, vec array<double>")
    plain = search.top_k(search.cosine_pairs(vectors.where("id < 60"), vectors.where("id < 60")), 7)
    for blocks in (1, 4):
        got = search.blocked_top_k(vectors, 7, blocks)
        assert {tuple(r) for r in got.select("query", "target", "rank").collect()} == {tuple(r) for r in plain.select("query", "target", "rank").collect()}


def test_rerank_keeps_the_tail(spark):
    hits = spark.createDataFrame([(1, t, r, s) for r, (t, s) in enumerate([(10, 0.1), (11, 0.9), (12, 0.9), (13, 5.0)], 1)], "query long, target long, rank int, s double")
    assert [r.target for r in search.rerank(hits, "s", 3).orderBy("rank").collect()] == [11, 12, 10, 13]


def test_metrics_against_plain_numbers(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    p, t = rng.integers(0, 6, 50) / 5, rng.integers(0, 6, 50) / 5
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, t)], "p double, t double")
    row = metrics.regression(df, "p", "t").first()
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    assert math.isclose(row.spearman, np.corrcoef(rank(p), rank(t))[0, 1], abs_tol=1e-6)
    assert math.isclose(row.r2, 1 - ((p - t) ** 2).mean() / t.var(), abs_tol=1e-6)
    flat = metrics.regression(df.withColumn("t", F.lit(0.5)), "p", "t").first()
    assert flat.r2 is None and flat.pearson is None
    assert spark.createDataFrame([(1.0, 1.0, True), (2.0, 4.0, True), (99.0, 0.0, False)], "p double, t double, m boolean").agg(metrics.masked_mean(F.pow(F.col("p") - F.col("t"), 2), F.col("m"))).first()[0] == 2.0
    terms = {"fgw": F.lit(0.02), "tm": F.lit(0.5)}
    assert math.isclose(one(spark, metrics.loss_total(terms, {"fgw": 1, "tm": 0.2})), 0.12)
    assert math.isclose(one(spark, metrics.loss_total(terms, {"fgw": 1, "tm": 0.2}, {"fgw": math.log(4)})), 0.02 / 4 + math.log(4) + 0.1)
    with pytest.raises(ValueError):
        metrics.loss_total(terms, {})


def test_group_ranges_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 97).alias("k"), "id").repartition(7)
    numbers = {r.k: r.number for r in sampling.key_numbers(df, "k").collect()}
    assert numbers == {k: k for k in range(97)}
    assert {r.k for r in sampling.group_range(df, "k", 5, 10).collect()} == set(range(5, 15))
    assert {r.buffer for r in sampling.buffers(df, "k", 40).collect()} == {0, 1, 2}


def test_patches_and_cells(spark):
    points = spark.createDataFrame([("a", i, float(i), 0.0, 0.0) for i in range(5)] + [("b", 0, 1.0, 1.0, 1.0)], "id string, idx int, x double, y double, z double")
    own = {(r.id, r.i): r.patch for r in geometry.patch_arrays(points, 3).collect()}
    assert own["a", 2] == [2, 1, 3] and own["a", 0] == [0, 1, 2] and own["b", 0] == [0]
    cells = spark.createDataFrame([(1, a, b) for a in (0, 50) for b in (3, 30, 53, 200)], "id int, r1 int, r2 int")
    partners = spark.createDataFrame([(1, 0, 3), (1, 50, 53)], "id int, r1 int, r2 int")
    kinds = {(r.r1, r.r2): r.cell for r in geometry.cell_classes(cells, partners).collect()}
    assert kinds[0, 3] == "aligned" and kinds[0, 30] == "near" and kinds[0, 200] == "far" and kinds[50, 53] == "aligned"


PDB = "ATOM  {n:5d}  CA  {res} {c}{n:4d}    {x:8.3f}{x:8.3f}{x:8.3f}  1.00  0.00           C"


def pdb(tmp_path, name, *chains, models=1):
    out = []
    for model in range(models):
        out += [f"MODEL     {model + 1:4d}"] * (models > 1)
        n = 0
        for chain, names in chains:
            for res in names:
                n += 1
                out.append(PDB.format(n=n, res=res, c=chain, x=n + 100.0 * model))
            out.append("TER")
        out += ["ENDMDL"] * (models > 1)
    (tmp_path / name).write_text("\n".join([*out, "END"]))


def test_structure_files(spark, tmp_path):
    pdb(tmp_path, "mono.pdb", ("A", ["ALA"] * 5))
    pdb(tmp_path, "dimer.pdb", ("A", ["ALA"] * 3), ("B", ["GLY"] * 4))
    pdb(tmp_path, "unk.pdb", ("A", ["UNK"] * 3), ("B", ["GLY"] * 4))
    pdb(tmp_path, "models.pdb", ("A", ["TRP"] * 3), models=3)
    (tmp_path / "empty.pdb").write_text("END")
    source = text.lines(spark, f"{tmp_path}/*.pdb")
    found: dict = {}
    for r in text.structures(source).orderBy("file", "idx").collect():
        found.setdefault(r.file, []).append((r.chain, r.residue, r.x))
    assert [len(found.get(f"{n}.pdb", [])) for n in ("mono", "dimer", "unk", "models", "empty")] == [5, 3, 4, 3, 0]
    assert found["unk.pdb"][0][:2] == ("B", "G") and found["models.pdb"][-1][2] == 3.0
    assert {r.file for r in text.multi_model(source).where("multi_model").collect()} == {"models.pdb"}
    assert {(r.chain, r.length, r.place) for r in text.chain_lengths(source).where("file = 'dimer.pdb'").collect()} == {("A", 3, 0), ("B", 4, 1)}
    with pytest.raises(ValueError, match="no chain"):
        text.require_chain(source, "B")


def test_small_text_formats(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nAB\nCD\n>two\nEF\n")
    assert {(r.id, r.sequence) for r in text.fasta(text.lines(spark, f"{tmp_path}/x.fa")).collect()} == {("one", "ABCD"), ("two", "EF")}
    (tmp_path / "m.tsv").write_text("REP1\tREP1\nREP1\tP1\nalone\nREP2\tP3\nREP3\tP3\n")
    assert {(r.member, r.representative) for r in text.cluster_map(text.lines(spark, f"{tmp_path}/m.tsv")).collect()} == {("REP1", "REP1"), ("P1", "REP1"), ("P3", "REP3")}
    (tmp_path / "h.tsv").write_text("q\ta\t0.5\nq\tb\nr\ta\t1\n")
    assert [(r["query"], r.target, r.score, r["rank"]) for r in text.hits(text.lines(spark, f"{tmp_path}/h.tsv")).orderBy("query", "rank").collect()] == [("q", "a", 0.5, 1), ("q", "b", None, 2), ("r", "a", 1.0, 1)]
    over = spark.createDataFrame([("q", "a", 0.9, 1, 10, 100, 0), ("q", "b", 0.5, 1, 80, 100, 1), ("q", "c", 0.5, 1, 80, 100, 2)], "query string, target string, fident double, qstart int, qend int, qlen int, line_no int")
    assert tuple(text.closest_overlap(over).first()) == ("q", "b", 0.5)


def test_window_scan_and_resume(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": [f"r{i}" for i in range(12)], "b": list(range(12))}), f"{tmp_path}/t.parquet", row_group_size=5)
    rows = parquet.window_scan(spark, f"{tmp_path}/t.parquet", ["a"], 3, 9)
    assert [(r.row_id, r.a) for r in rows.orderBy("row_id").collect()] == [(i, f"r{i}") for i in range(3, 9)]
    done = spark.createDataFrame([(4,), (4,), (11,)], "row_id long")
    assert [r.row_id for r in parquet.resume(rows, done, "row_id").orderBy("row_id").collect()] == [3, 5, 6, 7, 8]
    many = spark.range(0, 30, 1, 3).select(F.col("id").alias("b"))
    many.write.parquet(f"{tmp_path}/many")
    assert parquet.window_scan(spark, f"{tmp_path}/many", ["b"], 5, 25).count() == 20
    with pytest.raises(ValueError, match="missing columns: c"):
        parquet.require_columns(many, ["b", "c"])


def test_window_scan_reads_only_row_groups_that_meet_the_window(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for k in range(4):
        pq.write_table(pa.table({"a": list(range(k * 90, k * 90 + 90)), "b": ["x"] * 90}), f"{tmp_path}/t/{k}.parquet" if (tmp_path / "t").mkdir(exist_ok=True) is None else "", row_group_size=10)
    path = f"{tmp_path}/t"
    assert parquet.window_parts(path, 95, 112) == [(f"{path}/1.parquet", 0, 90, 5, 10), (f"{path}/1.parquet", 1, 100, 0, 10), (f"{path}/1.parquet", 2, 110, 0, 2)]
    assert len(parquet.window_parts(path)) == 36 and parquet.window_parts(path, 400) == [] and parquet.window_parts(f"{path}/2.parquet", 0, 5) == [(f"{path}/2.parquet", 0, 0, 0, 5)]
    for low, high in ((95, 112), (0, None), (355, 999), (89, 91), (400, None)):
        expected = [(i, i) for i in range(low, 360 if high is None else min(high, 360))]
        assert sorted((r.row_id, r.a) for r in parquet.window_scan(spark, path, ["a"], low, high).collect()) == expected
        assert sorted((r.row_id, r.a) for r in parquet._scanned(spark, path, ["a"], low, high).collect()) == expected
    assert parquet.window_scan(spark, path, ["b", "a"], 1, 2).columns == ["row_id", "b", "a"]


def test_places_totals_and_quantiles_equal_plain_ones(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([0.5, 2.0, 2.0, 3.25, rng.random() * 9]), i) for i in range(400)] + [("a", None, 400), (None, 7.0, 401)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert {r.i: r.number for r in sampling.numbered(df, ["v", "i"]).collect()} == {r[2]: n for n, r in enumerate(order)}
    within = {r.i: r.n for r in sampling.numbered(df, ["v", "i"], "n", ("k",)).collect()}
    assert within == {r[2]: sum(x[0] == r[0] for x in order[: order.index(r)]) for r in rows}
    running = {r.i: (r.s, r.m) for r in sampling.running(sampling.running(df.where("v is not null"), "i", "v", "s"), "i", "v", "m", F.min).collect()}
    for k, v, i in rows:
        before = [x[1] for x in rows if x[2] < i and x[1] is not None]
        if v is not None:
            assert running[i][1] == (min(before) if before else None) and (running[i][0] is None) == (not before) and (not before or math.isclose(running[i][0], sum(before)))
    import numpy as np

    for r in metrics.quantiles(df, "v", [0, 0.1, 0.5, 0.77, 1], list("pqrst"), ("k",)).where("k is not null").collect():
        own = [x[1] for x in rows if x[0] == r.k and x[1] is not None]
        assert np.allclose([r.p, r.q, r.r, r.s, r.t], np.quantile(own, [0, 0.1, 0.5, 0.77, 1]))
    assert metrics.quantiles(df.limit(0), "v", [0.5], ["m"]).count() == 0
    runs_ = spark.createDataFrame([(x, i) for i, x in enumerate("aabbbacca")], "k string, i int").repartition(3)
    assert {r.k: r.runs for r in sampling.key_runs(runs_, "k", "i").collect()} == {"a": 3, "b": 1, "c": 1}
    first = sampling.keep_first(df, ["k"], [F.col("v").desc_nulls_last() if False else -F.coalesce("v", F.lit(0.0)), "i"]).collect()
    assert {(r.k, r.i) for r in first} == {(k, min((x for x in rows if x[0] == k), key=lambda x: (-(x[1] or 0), x[2]))[2]) for k in ("a", "b", None)}


def test_packs_grow_and_are_cleared(spark, tmp_path):
    path = f"{tmp_path}/pack"
    df = spark.range(20).select(F.col("id"), (F.col("id") * 3).alias("v"))
    sinks.write_shards(df.where("id < 12"), path, "id", 3)
    assert {(r.id, r.shard, r.place) for r in spark.read.parquet(f"{path}/data").collect()} == {(i, i % 3, i // 3) for i in range(12)}
    sinks.write_shards(df.where("id >= 8"), path, "id", 2)
    assert {r.id: r.shard for r in spark.read.parquet(f"{path}/data").where("shard >= 3").collect()} == {i: 3 + (i - 12) % 2 for i in range(12, 20)}
    spark.createDataFrame([(99, 1, 7, 0)], "id long, v long, shard int, place long").write.mode("append").partitionBy("shard").parquet(f"{path}/data")  # a write that broke off
    assert sorted(map(tuple, sinks.read_shards(spark, path).collect())) == [(i, 3 * i) for i in range(20)]
    with pytest.raises(ValueError):
        sinks.write_shards(df.withColumn("v", F.lit("x")), path, "id", 2)
    (tmp_path / "pack" / "notes.txt").write_text("mine")
    assert "shard=4" in sinks.clear_pack(spark, path) and (tmp_path / "pack" / "notes.txt").exists()
    sinks.write_shards(df.withColumn("v", F.lit("x")), path, "id", 2)
    assert sinks.read_shards(spark, path).count() == 20
    with pytest.raises(ValueError):
        sinks.append_csv(df, f"{tmp_path}/csv")
        sinks.append_csv(df.withColumnRenamed("v", "w"), f"{tmp_path}/csv")


def test_sharded_runs_merge_all_or_nothing(spark, tmp_path):
    compute = lambda low, high: spark.range(low, high)
    assert runs.run_sharded(spark, 25, 4, compute, f"{tmp_path}/a").count() == 25
    with pytest.raises(FileExistsError):
        runs.run_sharded(spark, 25, 4, compute, f"{tmp_path}/a")

    def broken(low, high):
        if low:
            raise ValueError("no data")
        return spark.range(low, high)

    with pytest.raises(RuntimeError, match="1 of 2 windows failed"):
        runs.run_sharded(spark, 20, 2, broken, f"{tmp_path}/b")
    assert not sinks.exists(spark, f"{tmp_path}/b")
    assert runs.settings_warnings({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}) == ["b: made with 2, now 3"]
    assert (runs.workers(1), runs.workers(4), runs.workers(64)) == (1, 3, 8) and len(runs.timed(lambda: None, 2, 1)) == 2 and runs.seconds_a_pair(8.0, 2) == 2.0


def test_shifted_and_random_negatives(spark):
    own = spark.range(300).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(300).alias("n"))
    for r in alignment.shifted(own, ["g", "i"], "n").collect():
        assert 4 <= abs(r.shifted - r.j) <= 32 and 0 <= r.shifted < 300
    assert alignment.shifted(own.limit(1).withColumn("n", F.lit(3)), ["g", "i"], "n").first().shifted is None
    drawn = alignment.random_pairs(own.withColumn("m", F.lit(300)), own, ["g", "i"], "g", ("m", "n")).collect()
    assert len(drawn) == 300 and all(r.ri != r.rj and 0 <= r.ri < 300 and 0 <= r.rj < 300 for r in drawn) and len({r.ri for r in drawn}) > 100
    full = own.where("i < 1").withColumn("n", F.lit(1)).withColumn("m", F.lit(1))
    assert [(r.ri, r.rj) for r in alignment.random_pairs(full, full, ["g", "i"], "g", ("m", "n")).collect()] == [(0, 0)]
    rows = spark.createDataFrame([(1, "ok"), (1, "bad"), (2, "ok"), (3, None)], "k int, s string")
    assert [r.k for r in alignment.whole_pairs(rows, "k", F.col("s") != "ok").collect()] == [2]


def test_reranked_variants_choose_by_sensitivity_and_keep_tails(spark):
    rng = __import__("random").Random(2)
    centre = [[[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)] for _ in range(3)]
    own = [(k, [[x + rng.gauss(0, 0.2) for x in v] for v in centre[k % 3]]) for k in range(12)]
    residues = spark.createDataFrame(own, "id long, good array<array<double>>").withColumn("noise", F.transform("good", lambda v: F.transform(v, lambda x, k: x * 0 + F.pmod(F.xxhash64(F.col("id"), x), F.lit(100)) / 100.0)))
    hits = spark.createDataFrame([(q, t, 1.0 / (1 + r), r + 1) for q in range(12) for r, t in enumerate(x for x in range(12) if x != q)], "query long, target long, score double, rank int")
    domains = spark.createDataFrame([(k, str(k % 3), str(k % 3), "x") if k < 9 else (k, f"{k % 3}b", str(k % 3), "x") for k in range(12)], "id long, family string, superfamily string, fold string")
    out = search.rerank_variants({"list": hits}, residues, {"one": ("list", ["good"]), "two": ("list", ["good", "noise"])}, domains, [(5.0, 1.0, 1.0), (0.5, 2.0, 0.5)], [0.0, 1.0], F.col("query") < 6, 8)
    lists: dict = {}
    for r in out.collect():
        lists.setdefault((r.variant, r.query), []).append((r.rank, r.target, r.score))
    assert {v for v, _ in lists} == {"one", "two", "blend"} and all(len(x) == 11 for x in lists.values())
    old = {q: [t for t in range(12) if t != q] for q in range(12)}
    for (variant, q), rows in lists.items():
        rows.sort()
        assert [t for _, t, _ in rows[8:]] == old[q][8:] and sorted(t for _, t, _ in rows) == old[q]
        if variant == "one":
            same = [t for t in old[q][:8] if t % 3 == q % 3]
            assert {t for _, t, _ in rows[: len(same)]} == set(same)


def test_sinks_and_runs(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    for part in (df.where("id < 6"), df):
        sinks.append_new(part, f"{tmp_path}/out", "id")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    with pytest.raises(ValueError):
        sinks.append_new(df.withColumn("v", F.lit("x")), f"{tmp_path}/out", "id")
    sinks.append_manifest(spark, f"{tmp_path}/runs", stage="a", start_row=0)
    sinks.append_manifest(spark, f"{tmp_path}/runs", stage="a", start_row=50)
    assert spark.read.json(f"{tmp_path}/runs").count() == 2
    sinks.write_pack(df, f"{tmp_path}/pack", "id", 3)
    assert sinks.merge_shards(spark, [f"{tmp_path}/out", f"{tmp_path}/pack"], "id").count() == 10
    sinks.write_hits(spark.createDataFrame([(1, 2, 0.123456789, 1)], "query int, target int, score double, rank int"), f"{tmp_path}/hits")
    assert spark.read.csv(f"{tmp_path}/hits", sep="\t").first()[2] == "0.12346"
    calls: list = []
    compute = lambda: calls.append(1) or df
    for stamp in ("a", "a", "b"):
        assert runs.cached(spark, f"{tmp_path}/cache", stamp, compute).count() == 10
    assert len(calls) == 2
    order: list = []
    stages = [(n, lambda n=n: order.append(n)) for n in "abc"]
    assert runs.run_stages(stages, ["c", "a"]) == ["a", "c"] == order and runs.run_stages(stages, dry=True) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="unknown stages"):
        runs.run_stages(stages, ["z"])
    with pytest.raises(RuntimeError, match="stage b failed after a"):
        runs.run_stages([("a", lambda: None), ("b", lambda: 1 / 0), ("c", lambda: order.append("never"))])
    assert "never" not in order
    assert runs.bound("EOF") is None and runs.bound("12") == 12 and runs.row_windows(10, 3) == [(0, 4), (4, 8), (8, 10)]
    assert runs.methods(["x_family", "x_superfamily", "y_superfamily"]) == ["x", "y"]


def test_settings_are_graded_by_sensitivity(spark):
    rng = __import__("random").Random(2)
    centre = [[[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)] for _ in range(3)]
    residues = spark.createDataFrame([(f"s{k:02d}", [[x + rng.gauss(0, 0.2) for x in v] for v in centre[k % 3]]) for k in range(12)], "id string, good array<array<double>>")
    names = [f"s{k:02d}" for k in range(12)]
    hits = spark.createDataFrame([(q, t, 1.0 / (1 + r), r + 1) for q in names for r, t in enumerate(x for x in names if x != q)], "query string, target string, score double, rank int")
    domains = spark.createDataFrame([(n, str(k % 3), f"{k % 3}", "x") if k < 9 else (n, f"{k % 3}b", str(k % 3), "x") for k, n in enumerate(names)], "id string, family string, superfamily string, fold string")
    graded = search.graded_settings(hits, residues, ["good"], domains, [(5.0, 1.0, 1.0), (0.5, 2.0, 0.5)], F.col("query") < "s06", 11).orderBy("place").collect()
    assert [r.place for r in graded] == [1, 2] and (graded[0].shift, graded[0].open) == (0.5, 2.0) and graded[0].superfamily >= graded[1].superfamily
    scores = [(r.superfamily, r.family) for r in graded]
    assert scores == sorted(scores, reverse=True)
