"""Members of tar archives, and downloads by id with retries, both on the executors."""

from __future__ import annotations

import io
import tarfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def members_of(archives: DataFrame, rename: Callable[[str], str | None]) -> DataFrame:
    """name and text of the files in archives (content) whose renamed name is not None. An archive is read by one task, member by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as archive:
                    for member in archive:
                        name = rename(member.name) if member.isfile() else None
                        if name is not None:
                            text = archive.extractfile(member).read().decode(errors="replace")
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text])], ["name", "text"])

    return archives.select("content").mapInArrow(run, "name string, text string")


def tar_members(spark: SparkSession, path: str, rename: Callable[[str], str | None]) -> DataFrame:
    """The members of the archives under a path."""
    return members_of(spark.read.format("binaryFile").load(path), rename)


def tar_of(files: DataFrame, group: str) -> DataFrame:
    """An archive (content) for each group of files (group, name, text); a group is one archive."""

    def pack(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as archive:
            for name, text in sorted(zip(table.column("name").to_pylist(), table.column("text").to_pylist(), strict=True)):
                data = text.encode()
                info = tarfile.TarInfo(name)
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
        return pa.table({"content": pa.array([out.getvalue()], pa.binary())})

    return files.select(group, "name", "text").groupBy(group).applyInArrow(pack, "content binary")


def missing(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """The wanted names (name) that no archive has."""
    return wanted.select("name").distinct().join(members.select("name"), "name", "left_anti")


class Busy(Exception):
    """Raised by a fetch that should be tried again later."""


def http(url_of: Callable[[str], str], timeout: float = 30.0) -> Callable[[str], bytes | None]:
    """A fetch over HTTP: None where there is nothing (404), Busy where the server asks to wait (429), other errors as they are."""

    def fetch(key: str) -> bytes | None:
        try:
            with urllib.request.urlopen(url_of(key), timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as error:
            if error.code == 404:
                return None
            if error.code == 429:
                raise Busy from error
            raise

    return fetch


def fetched(ids: DataFrame, fetch: Callable[[str], bytes | None], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """id, status and content for every id: 'ok', 'missing' where fetch gives None, or 'failed: ...' after the last try. Waits double after Busy."""

    def one(key: str) -> tuple[str, bytes | None]:
        pause, error = wait, ""
        for _ in range(tries):
            try:
                content = fetch(key)
                return ("missing", None) if content is None else ("ok", content)
            except Busy:
                error = "busy"
                time.sleep(pause)
                pause *= 2
            except OSError as x:
                error = f"{type(x).__name__}: {x}"[:60]
        return f"failed: {error}", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(key) for key in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in out]), pa.array([c for _, c in out], pa.binary())], ["id", "status", "content"])

    return ids.where(F.col("id").isNotNull()).select("id").distinct().mapInArrow(run, "id string, status string, content binary")
