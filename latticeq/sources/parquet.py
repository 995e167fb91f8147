"""Parquet tables whose rows are known by their place, and resuming over them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Footers that are read at a time.
FOOTERS = 32


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The table's files in the order of their names."""
    store, where = _store(path)
    if store.get_file_info(where).type == fs.FileType.File:
        return [path]
    found = [x.path for x in store.get_file_info(fs.FileSelector(where, recursive=True)) if x.type == fs.FileType.File]
    return [path.rstrip("/") + x[len(where.rstrip("/")) :] for x in sorted(found) if not x.rpartition("/")[2].startswith(("_", "."))]


def _groups(path: str) -> list[int]:
    store, where = _store(path)
    with store.open_input_file(where) as source:
        meta = pq.read_metadata(source)
        return [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]


def window_parts(path: str, start: int = 0, end: int | None = None) -> list[tuple[str, int, int, int, int]]:
    """The row groups that meet the rows [start, end): file, group, place of its first row, and the rows [low, high) of it that are wanted.

    Only footers are read, some at a time, and none behind the end of the window.
    """
    names, at, out = files_of(path), 0, []
    with ThreadPoolExecutor(FOOTERS) as pool:
        for k in range(0, len(names), FOOTERS):
            for name, groups in zip(names[k : k + FOOTERS], pool.map(_groups, names[k : k + FOOTERS]), strict=True):
                for number, rows in enumerate(groups):
                    low, high = max(start, at), at + rows if end is None else min(end, at + rows)
                    if low < high:
                        out.append((name, number, at, low - at, high - at))
                    at += rows
            if end is not None and at >= end:
                break
    return out


def window_files(path: str, start: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    """The files that meet the rows [start, end): name, and the rows [low, high) of it that are wanted."""
    out: dict[str, list[int]] = {}
    base: dict[str, int] = {}
    groups = window_parts(path, start, end)
    for name, number, first, low, high in groups:
        if name not in base:
            base[name] = first - sum(_groups(name)[:number])
        rows = out.setdefault(name, [first + low - base[name], 0])
        rows[1] = first + high - base[name]
    return [(name, low, high) for name, (low, high) in out.items()]


def window_scan(spark: SparkSession, path: str, columns: list[str], start: int = 0, end: int | None = None) -> DataFrame:
    """row_id and columns of the rows [start, end) of a table of one or more files, in the order of their names.

    The footers say which files meet the window; Spark reads these alone, and of the first and last one only the row groups that hold wanted places, as
    a filter on a row's place reaches the scan. In a store that Arrow does not know, Spark scans the table and filters by place.
    """
    if not _known(path):
        return _scanned(spark, path, columns, start, end)
    found = window_files(path, start, end)
    if not found:
        return spark.read.parquet(path).select(F.lit(0).cast("bigint").alias("row_id"), *columns).where(F.lit(False))
    place = F.col("_metadata.row_index")
    at, out, middle = start, None, []
    for k, (name, low, high) in enumerate(found):
        if 0 < k < len(found) - 1:
            middle.append((name, at))
        else:
            own = spark.read.parquet(name).where((place >= low) & (place < high)).select((place + F.lit(at - low)).alias("row_id"), *columns)
            out = own if out is None else out.unionByName(own)
        at += high - low
    if middle:
        out = out.unionByName(_placed(spark.read.parquet(*(name for name, _ in middle)), columns, middle[0][1]))
    return out


def _known(path: str) -> bool:
    """Whether Arrow knows the store of a path."""
    try:
        _store(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False
    return True


def _placed(files: DataFrame, columns: list[str], first: int) -> DataFrame:
    """row_id and columns of whole files in the order of their names, counted from `first`; places of the files come from their counts."""
    name, place = F.col("_metadata.file_path").alias("_name"), F.col("_metadata.row_index").alias("_place")
    sizes = files.select(name).groupBy("_name").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_name").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    starts = sizes.select("_name", F.coalesce(before, F.lit(0)).alias("_first"))
    own = files.select(name, place, *columns).join(F.broadcast(starts), "_name")
    return own.select((F.col("_place") + F.col("_first") + first).alias("row_id"), *columns)


def _scanned(spark: SparkSession, path: str, columns: list[str], start: int, end: int | None) -> DataFrame:
    """As window_scan, by a scan of the whole table."""
    own = _placed(spark.read.parquet(path), columns, 0).where(F.col("row_id") >= start)
    return own if end is None else own.where(F.col("row_id") < end)


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key), key, "left_anti")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, if it has all the names; else an error that lists what is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df
