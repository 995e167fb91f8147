import gzip
import io
import tarfile

import pytest

from latticeq.functions import tables
from latticeq.sources import formats
from latticeq.streaming import incremental


def _atom(n, name, chain, residue, x, kind="ATOM  ", atom=" CA "):
    return f"{kind}{n:5d} {atom} {name} {chain}{residue:4d}    {x:8.3f}{0:8.3f}{-x:8.3f}  1.00  0.00           C"


def test_residues(spark, tmp_path):
    formats.register(spark)
    lines = ["MODEL        1", _atom(1, "UNK", "A", 1, 0), _atom(2, "ALA", "A", 2, 1.5), _atom(3, "ALA", "A", 2, 9), _atom(4, "GLY", "A", 3, 2, atom=" N  "), _atom(5, "MSE", "B", 1, 3, "HETATM"), "TER", _atom(6, "TRP", "B", 2, 4), "ENDMDL", "MODEL        2", _atom(7, "ALA", "A", 2, 5)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.pdb").write_text("\n".join(lines))
    (tmp_path / "two.pdb.gz").write_bytes(gzip.compress(_atom(1, "SER", "C", 1, 7).encode()))
    (tmp_path / "_hidden").write_text(_atom(1, "SER", "C", 1, 7))
    (tmp_path / "empty.pdb").write_text("")
    read = spark.read.format("residues")
    assert sorted(map(tuple, read.load(str(tmp_path)).collect())) == [("deep/one.pdb", "A", 0, "A", 1.5, 0.0, -1.5), ("deep/one.pdb", "B", 0, "M", 3.0, 0.0, -3.0), ("deep/one.pdb", "B", 1, "W", 4.0, 0.0, -4.0), ("two.pdb.gz", "C", 0, "S", 7.0, 0.0, -7.0)]
    assert read.option("chain", "B").load(f"file://{tmp_path}/deep/one.pdb").count() == 2
    with pytest.raises(Exception, match="FileNotFound|not_there"):
        spark.read.format("residues").load(f"{tmp_path}/not_there").count()


def test_fasta_and_hits(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.fasta").write_text("lost\n>one first\nABC\n\nDE\n>\n>two\nX\r\nY\n")
    assert [tuple(r) for r in spark.read.format("fasta").load(f"{tmp_path}/f").orderBy("place").collect()] == [("a.fasta", 0, "one", "ABCDE"), ("a.fasta", 1, "", ""), ("a.fasta", 2, "two", "XY")]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "b.tsv").write_text("q\tt\t0.5\nbroken\nq\tu\tno\nq\tv\n")
    assert [tuple(r)[2:] for r in spark.read.format("hits").load(f"{tmp_path}/h").orderBy("place").collect()] == [("q", "t", 0.5), ("q", "u", None), ("q", "v", None)]


def test_archives_stream_member_by_member(spark, tmp_path):
    formats.register(spark)
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as archive:
        for k in range(50):
            data = f"text {k}".encode() * k
            info = tarfile.TarInfo(f"d/{k}.{'ent' if k % 2 else 'txt'}")
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    found = spark.read.format("members").option("suffix", ".ent").load(str(tmp_path)).collect()
    assert {r.name: bytes(r.content) for r in found} == {f"d/{k}.ent": f"text {k}".encode() * k for k in range(1, 50, 2)}


def test_streams_take_new_files_once(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "in").mkdir()

    def take():
        stream = spark.readStream.format("fasta").load(f"{tmp_path}/in").select("id", "sequence")
        incremental.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted(tuple(r) for r in incremental.appended(spark, f"{tmp_path}/out").collect())

    (tmp_path / "in" / "1.fasta").write_text(">a\nAA\n")
    assert take() == [("a", "AA")] and take() == [("a", "AA")]
    (tmp_path / "in" / "0.fasta").write_text(">b\nBB\n")
    assert take() == [("a", "AA"), ("b", "BB")]


def test_table_functions(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, "AB-CD", ":::::", "A-BCD"), (2, "ABCD", ":X::", "ABCD"), (3, None, ":", "A"), (4, "", "", "")], "id int, a string, m string, b string")
    found = spark.sql("SELECT id, t.pos, t.i, t.j FROM {rows}, LATERAL aligned_columns(a, m, b) t ORDER BY id, pos", rows=rows).collect()
    assert [tuple(r) for r in found] == [(1, 0, 0, 0), (1, 3, 2, 2), (1, 4, 3, 3), (2, 0, 0, 0), (2, 2, 2, 2), (2, 3, 3, 3)]
    with pytest.raises(Exception, match="unequal lengths"):
        spark.sql("SELECT * FROM aligned_columns('AB', ':', 'AB')").collect()
    assert [tuple(r) for r in spark.sql("SELECT * FROM expanded_run(3, 5, 2)").collect()] == [(3, 5), (4, 6)]
