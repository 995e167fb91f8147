import json
import logging

import pytest
from pyspark.sql import functions as F

from jobs import common, search_benchmark, sequence_intake
from tests.oracles import same_rows

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.select("id", "cluster", "sequence", "reason", "copy_of", "split", "batch").collect())))


def _grow(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, source string, text string, other int").coalesce(1).write.mode("append").parquet(folder)


LONG = "abcdefghij" * 3
FIRST = [(1, "a", LONG, 0), (2, "a", f"{LONG}!", 0), (3, "b", "buzz " + LONG, 0), (4, None, None, 0), (5, "c", "tiny", 0), (None, "c", LONG + "x", 0), (10, "b", "X" * 90, 0), (6, None, "k" * 40, 0), (6, None, "k" * 40, 0)]
SECOND = [(7, "d", LONG.upper(), 1), (8, "d", "new text of some length", 1), (9, "d", "new text of some length.", 1)]


def _intake(spark, base, **config):
    return sequence_intake.run(spark, f"{base}/in", f"{base}/out", f"{base}/mark", {"least_letters": 10, "most_letters": 80} | config)


def test_intake_of_a_growing_table(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    _grow(spark, f"{tmp_path}/in", FIRST)
    once = {(r.id, r.batch): r for r in _intake(spark, tmp_path).collect()}
    assert [once[k, 0].reason for k in ("1", "2", "3", "4", "5", None, "10")] == [None, "copy", None, "no letters", "too short", "no id", "too long"]
    assert once["2", 0].copy_of == "1" and once["3", 0].sequence == "XXXX" + LONG.upper().replace("B", "X") and once["4", 0].split == "rejected"
    before = _rows(_intake(spark, tmp_path))
    assert len(before) == len(FIRST) and sum("'k" not in x and "KKKK" in x and "None" in x for x in before) == 2  # a repeated row is a copy of itself
    assert _rows(_intake(spark, tmp_path)) == before  # nothing new
    _grow(spark, f"{tmp_path}/in", SECOND)
    after = _intake(spark, tmp_path)
    assert [x for x in _rows(after) if x.endswith(" 0)")] == before
    new = {r.id: r for r in after.where("batch = 1").collect()}
    assert new["7"].copy_of == "1" and new["8"].reason is None and new["9"].copy_of == "8" and len(new) == 3
    assert {r.split for r in new.values()} == {"rejected", once["1", 0].split if new["8"].split == once["1", 0].split else new["8"].split}
    counted = {(r.batch, r.reason): r["count"] for r in sequence_intake.ledger(spark, f"{tmp_path}/out").groupBy("batch", "reason").agg(F.sum("count").alias("count")).collect()}
    assert counted[0, "copy"] == 2 and counted[1, "copy"] == 2 and sum(counted.values()) == 12
    assert "read 9 rows" in caplog.text and "read 3 rows" in caplog.text


def test_intake_repeats_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    _grow(spark, f"{tmp_path}/in", FIRST)
    _intake(spark, tmp_path)
    _grow(spark, f"{tmp_path}/in", SECOND)

    def breaks(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(sequence_intake, "counts", breaks)  # after the batch is written, before it is marked as done
    with pytest.raises(Exception, match="lost"):
        _intake(spark, tmp_path)
    monkeypatch.undo()
    found = _rows(_intake(spark, tmp_path))
    _grow(spark, f"{tmp_path}/plain/in", FIRST)
    _intake(spark, f"{tmp_path}/plain")
    _grow(spark, f"{tmp_path}/plain/in", SECOND)
    assert found == _rows(_intake(spark, f"{tmp_path}/plain")) and len(found) == 12


def test_intake_of_an_empty_table(spark, tmp_path):
    _grow(spark, f"{tmp_path}/in", [])
    assert _intake(spark, tmp_path).count() == 0


@pytest.mark.parametrize("name", ["job1_sequence_intake", "job2_search_benchmark"])
def test_queries_equal_their_sql(spark, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    same_rows(spark, name, SF)
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_benchmark_searches_only_what_is_missing(spark, tmp_path, monkeypatch):
    config = common.settings("jobs/search_benchmark.json", search_benchmark.DEFAULTS, top=5, draws=20)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    table.where("vec_id < 200").coalesce(1).write.parquet(f"{tmp_path}/in")
    searched = []
    plain = search_benchmark.search.blocked_top_k
    monkeypatch.setattr(search_benchmark.search, "blocked_top_k", lambda *args: searched.append(1) or plain(*args))
    key = lambda df: sorted(map(str, df.collect()))
    once = key(search_benchmark.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config))
    again = key(search_benchmark.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config))
    assert once == again and len(searched) == 2
    spark.createDataFrame([("void",)], "value string").coalesce(1).write.mode("overwrite").text(f"{tmp_path}/out/lists/squares.stamp")  # as a run that broke off leaves it
    assert key(search_benchmark.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config)) == once and len(searched) == 3
    table.where("vec_id between 200 and 220").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    grown = search_benchmark.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config)
    assert len(searched) == 5 and grown.where("part = 'hits' and method = 'cosine'").count() == 221 * 5


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"top": 3}))
    assert common.settings(str(tmp_path / "c.json"), {"top": 1, "draws": 2}, draws=None) == {"top": 3, "draws": 2}
    (tmp_path / "c.json").write_text(json.dumps({"tops": 3}))
    with pytest.raises(ValueError, match="tops"):
        common.settings(str(tmp_path / "c.json"), {"top": 1})
