"""Runs: stages in order, tables computed once, settings, and comparisons that are found by name."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import exists

#: Widths of the known residue embeddings, by the model's name.
EMBEDDING_WIDTHS = {"esm2_t12_35M": 480, "esm2_t30_150M": 640, "esm2_t33_650M": 1280, "esm2_t36_3B": 2560}


def bound(text: str | int | None) -> int | None:
    """A row number, or None for 'none', 'eof' and nothing."""
    if text is None or isinstance(text, int):
        return text
    return None if text.strip().lower() in ("", "none", "eof") else int(text)


def run_stages(stages: list[tuple[str, Callable[[], object]]], only: Iterable[str] | None = None, dry: bool = False) -> list[str]:
    """Run stages in order, all or those named; stop at the first that fails. Returns the names of what ran, or would run."""
    known = [name for name, _ in stages]
    wanted = list(known if only is None else only)
    unknown = [name for name in wanted if name not in known]
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(unknown)}; known: {', '.join(known)}")
    done = []
    for name, stage in stages:
        if name in wanted:
            if not dry:
                try:
                    stage()
                except Exception as error:
                    raise RuntimeError(f"stage {name} failed after {', '.join(done) or 'none'}") from error
            done.append(name)
    return done


def cached(spark: SparkSession, path: str, stamp: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was made from the same stamp, else computed and written anew. The stamp is void while the table is written, so a run that broke off leaves none that looks finished."""
    marker = f"{path}.stamp"
    if exists(spark, marker) and exists(spark, path) and spark.read.text(marker).first()["value"] == stamp:
        return spark.read.parquet(path)
    for done, text in ((False, "void"), (True, stamp)):
        if done:
            compute().write.mode("overwrite").parquet(path)
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(marker)
    return spark.read.parquet(path)


def files_stamp(files: DataFrame, *settings: object) -> str:
    """A digest of a table's files, their sizes and times, and of settings: what a cached result depends on."""
    facts = F.concat_ws("|", "_metadata.file_path", F.col("_metadata.file_size").cast("string"), F.unix_micros("_metadata.file_modification_time").cast("string"))
    each = files.select(facts.alias("f")).distinct().select(F.md5(F.col("f").cast("binary")).alias("h"))
    # as many sums of digests as hexadecimal numbers fit a decimal: no list of files reaches the driver
    sums = each.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)))
    return hashlib.md5(json.dumps([*map(str, sums.first()), *settings], sort_keys=True, default=str).encode()).hexdigest()


def row_windows(rows: int, shards: int) -> list[tuple[int, int]]:
    """Windows of equal size, rounded up, that cover all rows."""
    size = -(-rows // max(1, shards))
    return [(at, min(at + size, rows)) for at in range(0, rows, size)] if rows else []


def methods(columns: Iterable[str], level: str = "superfamily") -> list[str]:
    """The methods of a wide table with columns named method_level."""
    return [name.removesuffix(f"_{level}") for name in columns if name.endswith(f"_{level}")]


def method_means(wide: DataFrame, level: str = "superfamily") -> DataFrame:
    """method and mean of every method that a wide table has a column for, by the columns' names; nulls are left out."""
    found = methods(wide.columns, level)
    if not found:
        return wide.sparkSession.createDataFrame([], "method string, mean double")
    columns = wide.select(*(F.col(f"`{name}_{level}`").cast("double").alias(name) for name in found))
    return columns.unpivot([], found, "method", "value").groupBy("method").agg(F.avg("value").alias("mean"))


def one_each(df: DataFrame, key: str) -> DataFrame:
    """df, if its key is unique; else an error that names a key."""
    for row in df.groupBy(key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"{key} {row[key]!r} occurs {row['count']} times")
    return df


def run_sharded(spark: SparkSession, rows: int, shards: int, compute: Callable[[int, int], DataFrame], target: str) -> DataFrame:
    """The table at target, made from windows of rows, each written on its own.

    An existing target is an error, as a run must not go on where another one broke off. Windows that fail are named when all have been tried, and nothing is merged;
    the merged table must have as many rows as its shards.
    """
    if exists(spark, target) or exists(spark, f"{target}.shards"):
        raise FileExistsError(f"{target} or its shards are there already")
    failed, paths = [], []
    for number, (low, high) in enumerate(row_windows(rows, shards)):
        paths.append(f"{target}.shards/shard={number}")
        try:
            compute(low, high).write.parquet(paths[-1])
        except Exception as error:
            failed.append(f"[{low}, {high}): {error}")
    if failed:
        raise RuntimeError(f"{len(failed)} of {len(paths)} windows failed, nothing is merged: {'; '.join(failed)}")
    if not paths:
        compute(0, 0).write.parquet(target)
        return spark.read.parquet(target)
    merged = spark.read.parquet(*paths)
    merged.write.parquet(target)
    out = spark.read.parquet(target)
    if (n := out.count()) != (m := merged.count()):
        raise RuntimeError(f"{target} has {n} rows, its shards {m}")
    return out


def run_shards(spark: SparkSession, windows: list[tuple[int, int]], compute: Callable[[int, int], DataFrame], target: str, at_once: int = 4) -> DataFrame:
    """The table at target, made of windows of rows, several at once, and gone on with where an earlier run ended.

    Each window is a partition of target, shard=low, and is done when a marker says how many rows it has; a window without a marker is
    written anew. Jobs are submitted from threads, each to a scheduler pool of its own. Windows that fail are named when all others have
    ended; what is done stays. The table is the partitions as they lie: nothing is written a second time.
    """
    markers = f"{target}.done"
    done = {row["low"] for row in finished_shards(spark, target).collect()}  # a row for each window

    def one(window: tuple[int, int], pool: int) -> str | None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"shards-{pool}")
        low, high = window
        try:
            compute(low, high).write.mode("overwrite").parquet(f"{target}/shard={low}")
            rows = spark.read.parquet(f"{target}/shard={low}").count()
            row = spark.range(1).select(F.lit(low).cast("bigint").alias("low"), F.lit(high).cast("bigint").alias("high"), F.lit(rows).cast("bigint").alias("rows"))
            row.coalesce(1).write.mode("overwrite").parquet(f"{markers}/window={low}")
        except Exception as error:
            return f"[{low}, {high}): {error}"
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return None

    todo = [w for w in windows if w[0] not in done]
    with ThreadPoolExecutor(at_once) as pool:
        failed = [x for x in pool.map(inheritable_thread_target(one), todo, [k % at_once for k in range(len(todo))]) if x]
    if failed:
        raise RuntimeError(f"{len(failed)} of {len(windows)} windows failed, run again for these: {'; '.join(failed)}")
    out = spark.read.parquet(target).drop("shard") if windows else compute(0, 0)
    said = finished_shards(spark, target).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if windows and (n := out.count()) != said:
        raise RuntimeError(f"{target} has {n} rows, its markers say {said}")
    return out


def finished_shards(spark: SparkSession, target: str) -> DataFrame:
    """low, high and rows of the windows that are done."""
    schema = "low bigint, high bigint, rows bigint"
    return spark.read.schema(schema).parquet(f"{target}.done") if exists(spark, f"{target}.done") else spark.createDataFrame([], schema)


def settings_warnings(saved: dict, wanted: dict) -> list[str]:
    """What differs between the settings that a result was made with and those that are asked for now."""
    return [f"{name}: made with {saved[name]!r}, now {wanted[name]!r}" for name in sorted(saved.keys() & wanted.keys()) if saved[name] != wanted[name]]


def workers(cpus: int, most: int = 8) -> int:
    """How many workers read: one processor is left, and there is one worker at least."""
    return max(1, min(most, cpus - 1))


def timed(work: Callable[[], object], repeats: int = 3, warm_up: int = 1) -> list[float]:
    """Seconds of each repeat; the first ones, which warm up, are not counted."""
    out = []
    for k in range(warm_up + repeats):
        began = time.perf_counter()
        work()
        if k >= warm_up:
            out.append(time.perf_counter() - began)
    return out


def seconds_a_pair(elapsed: float, n: int) -> float:
    """The cost of one pair when n things were compared with each other."""
    return elapsed / (n * n) if n else 0.0
