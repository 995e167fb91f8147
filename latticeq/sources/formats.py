"""File formats as Spark data sources: spark.read.format("residues" | "fasta" | "hits" | "members").load(path), and streams of them.

Each file of a path is one partition. A file is read on an executor, line by line or member by member, so its size does not matter; a stream
takes the files that came since its last batch, by their time and name. `path` is a file, a folder that is searched with its subfolders, or a
comma-separated list, in any store that Arrow knows by its URI. Files are named by their path below the one that was asked for.
"""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.exprs import RESIDUES
from .text import PARENTS

#: Rows of an Arrow batch.
BATCH = 4096


@dataclass
class File(InputPartition):
    """A file of a path: where it lies and what it is called."""

    uri: str
    name: str

    def __init__(self, uri: str, name: str) -> None:
        super().__init__(uri)
        self.uri, self.name = uri, name


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _listed(paths: str) -> list[tuple[int, str, str]]:
    """Time, URI and name of every file, in the order in which a stream takes them."""
    out = []
    for path in paths.split(","):
        store, where = _store(path.strip())
        info = store.get_file_info(where)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(where, recursive=True))
        scheme = path.strip()[: len(path.strip()) - len(where)] if path.strip().endswith(where) else ""
        for x in found:
            name = x.base_name if info.type == fs.FileType.File else x.path[len(where) :].lstrip("/")
            if x.type == fs.FileType.File and not any(part.startswith(("_", ".")) for part in name.split("/")):
                out.append((x.mtime_ns or 0, scheme + x.path, name))
    return sorted(out)


def _opened(file: File) -> io.BufferedIOBase:
    store, where = _store(file.uri)
    stream = store.open_input_stream(where, compression=None)
    return gzip.GzipFile(fileobj=stream) if file.uri.endswith(".gz") else stream


def _lines(file: File) -> Iterator[str]:
    with _opened(file) as stream:
        for line in io.TextIOWrapper(io.BufferedReader(stream) if not isinstance(stream, gzip.GzipFile) else stream, errors="replace"):
            yield line.rstrip("\r\n")


def _letters() -> dict[str, str]:
    words, parents = RESIDUES.split(), PARENTS.split()
    names = dict(zip(words[::2], words[1::2], strict=True))
    return names | {a: names[b] for a, b in zip(parents[::2], parents[1::2], strict=True)}


def residues(file: File, options: dict[str, str]) -> Iterator[tuple]:
    """The alpha carbons of the first model, modified residues as those they stand for; option chain: one chain only. idx counts a chain's residues."""
    letters, wanted = _letters(), options.get("chain")
    counted: dict[str, int] = {}
    seen = set()
    for line in _lines(file):
        if line.startswith("ENDMDL"):
            return
        if line[:6] not in ("ATOM  ", "HETATM") or line[12:16].strip() != "CA":
            continue
        chain, letter, number = line[21:22], letters.get(line[17:20].strip()), line[22:27]
        if letter is None or wanted not in (None, chain) or (chain, number) in seen:
            continue
        seen.add((chain, number))
        place = []
        for at in (30, 38, 46):
            try:
                place.append(float(line[at : at + 8]))
            except ValueError:
                place.append(None)
        yield file.name, chain, counted.setdefault(chain, 0), letter, *place
        counted[chain] += 1


def entries(file: File, options: dict[str, str]) -> Iterator[tuple]:
    """The entries of a FASTA file: id, place in the file, and the joined lines."""
    name, parts, place = None, [], -1
    for line in _lines(file):
        line = line.strip()
        if line.startswith(">"):
            if name is not None:
                yield file.name, place, name, "".join(parts)
            name, parts, place = (line[1:].split() or [""])[0], [], place + 1
        elif name is not None:
            parts.append(line)
    if name is not None:
        yield file.name, place, name, "".join(parts)


def hit_lines(file: File, options: dict[str, str]) -> Iterator[tuple]:
    """The lines of a ranked list: query, target, score if there is one, and the place of the line."""
    for place, line in enumerate(_lines(file)):
        fields = line.split("\t")
        if len(fields) < 2:
            continue
        try:
            score = float(fields[2]) if len(fields) > 2 else None
        except ValueError:
            score = None
        yield file.name, place, fields[0], fields[1], score


def members(file: File, options: dict[str, str]) -> Iterator[tuple]:
    """The files in an archive, one after another as they come; option suffix: only names that end so."""
    store, where = _store(file.uri)
    with store.open_input_stream(where, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as archive:
        for member in archive:
            if member.isfile() and member.name.endswith(options.get("suffix", "")):
                yield file.name, member.name, archive.extractfile(member).read()


FORMATS = {
    "residues": (residues, "file string, chain string, idx bigint, residue string, x double, y double, z double"),
    "fasta": (entries, "file string, place bigint, id string, sequence string"),
    "hits": (hit_lines, "file string, place bigint, query string, target string, score double"),
    "members": (members, "file string, name string, content binary"),
}
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


class _Rows:
    """Reads a partition in Arrow batches."""

    def __init__(self, source: _Source) -> None:
        self.options, self.of = dict(source.options), source.name()

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        parse, fields = FORMATS[self.of]
        schema = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in fields.split(", "))])
        rows: list[tuple] = []
        held = 0
        for row in parse(partition, self.options):
            rows.append(row)
            held += sum(len(x) for x in row if isinstance(x, str | bytes))
            if len(rows) == BATCH or held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _Reader(_Rows, DataSourceReader):
    def partitions(self) -> list[File]:
        return [File(uri, name) for _, uri, name in _listed(self.options["path"])]


class _StreamReader(_Rows, DataSourceStreamReader):
    """Offsets are the time and URI of the last file taken."""

    def initialOffset(self) -> dict:
        return {"time": -1, "uri": ""}

    def latestOffset(self) -> dict:
        found = _listed(self.options["path"])
        return {"time": found[-1][0], "uri": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[File]:
        low, high = (start["time"], start["uri"]), (end["time"], end["uri"])
        return [File(uri, name) for time, uri, name in _listed(self.options["path"]) if low < (time, uri) <= high]

    def commit(self, end: dict) -> None:
        pass


class _Source(DataSource):
    def schema(self) -> StructType | str:
        return FORMATS[self.name()][1]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self)


class Residues(_Source):
    @classmethod
    def name(cls) -> str:
        return "residues"


class Fasta(_Source):
    @classmethod
    def name(cls) -> str:
        return "fasta"


class Hits(_Source):
    @classmethod
    def name(cls) -> str:
        return "hits"


class Members(_Source):
    @classmethod
    def name(cls) -> str:
        return "members"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (Residues, Fasta, Hits, Members):
        spark.dataSource.register(source)
