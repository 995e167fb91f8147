import io
import tarfile

import pytest
from pyspark.sql import functions as F

from latticeq.sources import archives
from latticeq.streaming import incremental


def test_tar_members(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as archive:
        for name, text in (("d/g1abc.ent", "one"), ("d/d2abc.ent", "two"), ("d/readme", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            archive.addfile(info, io.BytesIO(text.encode()))

    def rename(name):
        base = name.rpartition("/")[2]
        return "d" + base[1:-4] if base.endswith(".ent") else None

    members = archives.tar_members(spark, f"{tmp_path}/x.tar.gz", rename)
    assert {(r.name, r.text) for r in members.collect()} == {("d1abc", "one"), ("d2abc", "two")}
    wanted = spark.createDataFrame([("d1abc",), ("d9xyz",), ("d9xyz",)], "name string")
    assert [r.name for r in archives.missing(wanted, members).collect()] == ["d9xyz"]


def test_fetch_retries(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(key):
        import os

        if key == "none":
            return None
        if key == "broken":
            raise OSError("no route")
        seen = os.path.join(folder, key)
        if not os.path.exists(seen):
            open(seen, "w").close()
            raise archives.Busy
        return key.encode()

    ids = spark.createDataFrame([("a",), ("a",), ("none",), ("broken",), (None,)], "id string")
    out = {r.id: (r.status, r.content) for r in archives.fetched(ids, fetch, wait=0.01).collect()}
    assert out["a"] == ("ok", b"a") and out["none"] == ("missing", None) and out["broken"][0] == "failed: OSError: no route" and len(out) == 3


def test_fetch_over_http():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            code = {"/gone": 404, "/busy": 429, "/broken": 500}.get(self.path, 200)
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(self.path.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    fetch = archives.http(lambda key: f"http://127.0.0.1:{server.server_port}/{key}")
    assert fetch("a") == b"/a" and fetch("gone") is None
    with pytest.raises(archives.Busy):
        fetch("busy")
    with pytest.raises(OSError):
        fetch("broken")
    server.shutdown()


def test_runs_add_only_what_is_new(spark, tmp_path):
    source, target, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    rows = spark.range(10).select("id", (F.col("id") % 3).alias("g"))
    rows.where("id < 6").write.mode("append").parquet(source)
    for part in (None, rows.where("id >= 4"), None):
        if part is not None:
            part.write.mode("append").parquet(source)
        incremental.append_stream(incremental.file_stream(spark, source), target, state, "id")
    assert sorted(r.id for r in incremental.appended(spark, target).collect()) == list(range(10))


def test_groups_are_carried_until_whole(spark, tmp_path):
    source, target, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for part in ([(1, 3, "a"), (1, 3, None), (2, 1, "c")], [(3, 2, "d")], [(1, 3, "e"), (3, 2, "f"), (4, 5, "g")]):
        spark.createDataFrame(part, "k long, size int, v string").coalesce(1).write.mode("append").parquet(source)
        groups = incremental.carried_groups(incremental.file_stream(spark, source), "k", "size")
        incremental.run_available(groups, state, lambda batch, _: batch.write.mode("append").parquet(target))
    rows = [tuple(r) for r in spark.read.parquet(target).collect()]
    assert sorted(rows, key=str) == sorted([(2, 1, "c", 1), (1, 3, "a", 2), (1, 3, None, 2), (1, 3, "e", 2), (3, 2, "d", 2), (3, 2, "f", 2)], key=str)


def test_groups_in_keyed_state_are_whole_or_late(spark, tmp_path):
    import datetime

    source, target, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before, at = spark.conf.get(provider, None), lambda hour: datetime.datetime(2024, 1, 1, hour)
    parts = (
        [(1, 3, "a", at(0)), (1, 3, None, at(1)), (2, 1, "c", at(1)), (5, 2, "late", at(0))],
        [(3, 2, "d", at(3)), (9, 1, "z", at(9))],  # nine hours on: groups 1 and 5 have waited too long
        [(3, 2, "f", at(10)), (1, 3, "e", at(10)), (4, 5, "g", at(10))],
    )
    for part in parts:
        spark.createDataFrame(part, "k long, size int, v string, t timestamp").coalesce(1).write.mode("append").parquet(source)
        with incremental.keyed_state(spark):
            incremental.write_batches(incremental.whole_groups(incremental.file_stream(spark, source), "k", "size", "t", "6h", "1 hour"), target, state)
    found = sorted(((r.k, r.v, r.parts, r.whole) for r in incremental.appended(spark, target).collect()), key=str)
    assert found == sorted([(2, "c", 1, True), (9, "z", 1, True), (1, "a", 1, False), (1, None, 1, False), (5, "late", 1, False), (3, "d", 2, True), (3, "f", 2, True)], key=str)
    assert spark.conf.get(provider, None) == before


def test_a_run_stops_where_a_batch_ends(spark, tmp_path):
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"
    spark.range(60).repartition(6).write.parquet(source)
    seen: list = []
    each = lambda batch, number: seen.append({r.id for r in batch.collect()})
    assert incremental.stopped_after(incremental.file_stream(spark, source, 1), state, each, 2) == 2 and len(seen) == 2
    assert incremental.stopped_after(incremental.file_stream(spark, source, 1), state, each, 9) == 4
    assert sum(map(len, seen)) == 60 and set().union(*seen) == set(range(60))
    with pytest.raises(Exception, match="broken"):
        incremental.stopped_after(incremental.file_stream(spark, source, 1), f"{state}2", lambda *_: (_ for _ in ()).throw(ValueError("broken")), 3)
