"""Writers. Spark's committers make each write all or nothing; a second write of the same keys is kept out by an anti join."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, sampling


def _store(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _store(spark, path)
    return store.exists(where)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table does not have yet; the schema must fit."""
    spark = df.sparkSession
    if exists(spark, path):
        old = spark.read.parquet(path)
        if old.dtypes != df.dtypes:
            raise ValueError(f"{path} has {old.dtypes}, not {df.dtypes}")
        df = df.join(old.select(key).distinct(), key, "left_anti").select(*df.columns)
    df.write.mode("append").parquet(path)


def write_pack(df: DataFrame, path: str, key: str, shards: int) -> None:
    """A table in about `shards` files, dealt by key and sorted within, so that lookups by key skip row groups."""
    df.repartition(shards, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def append_manifest(spark: SparkSession, path: str, **fields: object) -> None:
    """One line of a run's facts, with the time it finished."""
    row = spark.range(1).select(F.lit(json.dumps(fields, default=str)).alias("facts"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("finished_at"))
    row.coalesce(1).write.mode("append").json(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """query, target and score with five decimals, each query's hits together and in rank order, compressed."""
    own = hits.repartition("query").sortWithinPartitions("query", "rank")
    own.select("query", "target", F.format_string("%.5f", "score").alias("score")).write.mode("overwrite").csv(path, sep="\t", compression="gzip")


def write_wide(tables: dict[str, DataFrame], path: str, key: str, value: str, fill: float = 0.0) -> None:
    """A tab-separated table of all keys, sorted, with a column for each method's value."""
    own = joins.by_method(tables, key, value, fill)
    own.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def merge_shards(spark: SparkSession, paths: list[str], key: str) -> DataFrame:
    """The rows of several tables, each key once, from the first table that has it."""
    out = None
    for number, path in enumerate(paths):
        own = spark.read.parquet(path).withColumn("_shard", F.lit(number))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("_row", F.struct("_shard")).groupBy(key).agg(*(F.min_by(c, "_row").alias(c) for c in out.columns if c not in (key, "_shard")))


def append_csv(df: DataFrame, path: str, part: str | None = None) -> None:
    """Append rows to a table of CSV files, each with its header; a table with other columns is an error.

    With the name of a part, the rows are that part of the table, in a folder of their own: written again after a failure, they take the place of
    what is there and are not doubled.
    """
    spark = df.sparkSession
    if exists(spark, path) and (there := [c for c in spark.read.csv(path, header=True).columns if c != "part"]) != df.columns:
        raise ValueError(f"{path} has {there}, not {df.columns}")
    if part is None:
        df.write.mode("append").csv(path, header=True)
    else:
        df.write.mode("overwrite").csv(f"{path}/part={part}", header=True)


def mark_progress(spark: SparkSession, path: str, run: str, row: int) -> None:
    """Say that a run has done all rows before `row`."""
    spark.range(1).select(F.lit(run).alias("run"), F.lit(row).cast("bigint").alias("row")).coalesce(1).write.mode("append").json(path)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """run and row: how far each run has come."""
    return spark.read.schema("run string, row bigint").json(path).groupBy("run").agg(F.max("row").alias("row"))


#: What a pack's manifest says of each write, a line each: which attempt wrote it, its shards [first, next), its rows, key and columns.
COMMITS = "attempt string, first int, next int, rows bigint, key string, types string"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The finished writes of a pack."""
    lines = spark.read.schema("facts string").json(f"{path}/manifest")
    return lines.select(F.from_json("facts", COMMITS).alias("x")).select("x.*")


def write_shards(df: DataFrame, path: str, key: str, shards: int, unique: bool = True) -> None:
    """A pack of `shards` shards: rows are dealt by turns in the order of their keys, which are of any type that has an order.

    Each write has a folder of its own, data/attempt=..., which nobody sees until one line in the manifest names it; a write that broke off leaves
    a folder that no reader looks at, and is repeated as if it had not been. A pack that is there already must have the same columns; its shards are
    kept, keys that it has are left out, and new ones go into shards behind the last one. Rows with a null key are left out, of rows with
    one key the first in the order of the other columns stays, or without `unique` all, in that order.
    """
    spark = df.sparkSession
    first, types = 0, json.dumps(df.dtypes)
    rest = sampling.orderable(df, but=[key])
    new = df.where(F.col(key).isNotNull())
    if unique:
        new = sampling.keep_first(new, [key], rest)
    if exists(spark, f"{path}/manifest"):
        made = commits(spark, path).agg(F.max_by("types", "next"), F.max("next")).first()  # a line for each write
        if made[0] != types:
            raise ValueError(f"{path} has {made[0]}, not {types}")
        first = made[1]
        new = new.join(_visible(spark, path).select(key), key, "left_anti").select(*df.columns)
    attempt = uuid.uuid4().hex
    dealt = sampling.numbered(new, [key] if unique else [key, *rest], "_number").withColumn("shard", F.lit(first) + (F.col("_number") % shards).cast("int")).withColumn("place", F.floor(F.col("_number") / shards).cast("bigint")).drop("_number")
    dealt.repartition("shard").sortWithinPartitions("shard", "place").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/data/attempt={attempt}")
    schema = df.withColumns({"place": F.lit(0).cast("bigint"), "shard": F.lit(0)}).schema
    rows, last = spark.read.schema(schema).parquet(f"{path}/data/attempt={attempt}").agg(F.count(F.lit(1)), F.max("shard")).first()
    append_manifest(spark, f"{path}/manifest", attempt=attempt, first=first, next=first if last is None else last + 1, rows=rows, key=key, types=types)


def _visible(spark: SparkSession, path: str) -> DataFrame:
    """The rows of finished writes with shard and place: a list of folders, one for each write."""
    done = commits(spark, path).select("attempt", "types").collect()  # a line for each write
    columns = ", ".join(f"`{name}` {kind}" for name, kind in json.loads(done[0]["types"]))
    folders = [f"{path}/data/attempt={x['attempt']}" for x in done]
    return spark.read.schema(f"{columns}, place bigint, shard int").option("basePath", f"{path}/data").parquet(*folders).drop("attempt")


def read_shards(spark: SparkSession, path: str, keys: list | None = None, places: bool = False) -> DataFrame:
    """The rows of a pack, all or those of some keys, and with places their shard and place in it. Data of writes that broke off are not seen.

    A filter on keys reaches the scan, and rows of a shard lie in the order of their keys, so row groups without them are skipped.
    """
    own = _visible(spark, path)
    if keys is not None:
        key = commits(spark, path).agg(F.max("key")).first()[0]
        own = own.where(F.col(key).isin(*keys))
    return own if places else own.drop("shard", "place")


def clear_pack(spark: SparkSession, path: str) -> list[str]:
    """Delete the manifest and the data of a pack, and nothing else that lies there; the manifest goes first, so what is left of a broken delete is not seen. Returns the names of what went."""
    store, where = _store(spark, path)
    gone = []
    for pattern in ("manifest", "data/attempt=*/shard=*", "data/attempt=*", "data/shard=*"):
        for found in store.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, pattern)) or []:
            store.delete(found.getPath(), True)
            gone.append(found.getPath().getName())
    return sorted(gone)


def write_reranked(head: DataFrame, rest: DataFrame, path: str) -> None:
    """A re-ranked head with four decimals and the original tail with five, each query's hits together and in rank order, compressed."""
    own = head.withColumn("score", F.format_string("%.4f", "score")).unionByName(rest.withColumn("score", F.format_string("%.5f", "score")))
    own = own.select("query", "target", "score", "rank").repartition("query").sortWithinPartitions("query", "rank")
    own.select("query", "target", "score").write.mode("overwrite").csv(path, sep="\t", compression="gzip")


def write_predictions(df: DataFrame, path: str, name: str) -> None:
    """The predictions of a model, beside those of others; a second write of a name replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/name={name}")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """All predictions under a path, with the name of their model."""
    return spark.read.parquet(path)


def merge_timings(spark: SparkSession, path: str, **timings: float) -> None:
    """Add timings to those that a path keeps; one of a known name takes its place."""
    rows = [(name, float(value)) for name, value in timings.items()]
    own = spark.createDataFrame(rows, "name string, seconds double").withColumn("at", F.unix_micros(F.current_timestamp()))
    own.coalesce(1).write.mode("append").json(path)


def timings(spark: SparkSession, path: str) -> DataFrame:
    """name and seconds, the latest of each name."""
    return spark.read.schema("name string, seconds double, at bigint").json(path).groupBy("name").agg(F.max_by("seconds", "at").alias("seconds"))


def text_table(df: DataFrame) -> DataFrame:
    """A report's table as lines: cells padded to the width of their column, the header first. Reports are small; the lines keep the order of the first column."""
    cells = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in df.columns))
    widths = cells.agg(*(F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"_w{k}") for k, c in enumerate(cells.columns)))
    joined = cells.crossJoin(F.broadcast(widths))  # one row of widths
    line = lambda values: F.concat_ws("  ", *(F.rpad(v, F.col(f"_w{k}"), F.lit(" ")) for k, v in enumerate(values)))
    rows = joined.select(F.lit(1).alias("part"), F.col(cells.columns[0]).alias("key"), line([F.col(c) for c in cells.columns]).alias("line"))
    head = widths.select(F.lit(0).alias("part"), F.lit("").alias("key"), line([F.lit(c) for c in cells.columns]).alias("line"))
    return head.unionByName(rows).select("part", "key", F.rtrim("line").alias("line"))
