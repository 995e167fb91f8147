"""Folders that driver and executors share, and tables kept in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def kept_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or in a local session without one, under the temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or tempfile.gettempdir()).rstrip('/')}/latticeq-{uuid.uuid4().hex}"


def folder(spark: SparkSession) -> str:
    """As kept_folder, but the folder goes when the driver ends."""
    path = kept_folder(spark)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: How rows of many MB are written: each is a page of its own, and a group of rows ends after few; numbers that do not compress are not copied for it.
WIDE = {"compression": "none", "parquet.block.size": str(32 << 20), "parquet.page.row.count.limit": "1"} | {f"parquet.{kind}.size.row.check.{end}": "1" for kind in ("page", "block") for end in ("min", "max")}


def stored(df: DataFrame, wide: bool = False) -> DataFrame:
    """df written to a shared folder and read again: computed once, with its lineage cut. wide: its rows may have many MB."""
    path = folder(df.sparkSession)
    df.write.options(**WIDE if wide else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crossed(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Pairs of rows of two stored tables. Each pair of their files is a task that reads both, so no row goes through a shuffle and a file is read as often as the other table has files."""
    return left.join(right.hint("shuffle_replicate_nl"), on)
