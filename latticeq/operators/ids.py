"""Ids in tables of pairs: who occurs, who came first, who belongs to whom, and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import valid_id
from . import sampling


def distinct_ids(pairs: DataFrame, columns: list[str], trimmed: bool = True) -> DataFrame:
    """The valid ids of several columns, each once. Duplicates of a column go before the shuffle."""
    ids = pairs.select(F.explode(F.array(*columns)).alias("id")).where(valid_id(F.col("id")))
    return ids.select(F.trim("id").alias("id") if trimmed else F.col("id")).distinct()


def scan_extent(pairs: DataFrame, row: str) -> DataFrame:
    """How many rows a scan has read, and the last of them."""
    return pairs.agg(F.count(F.lit(1)).alias("rows_scanned"), F.max(row).cast("bigint").alias("last_row"))


def first_seen(pairs: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """Each id and the place at which it first occurs, when rows are read one after another and columns from left to right."""
    places = F.explode(F.array(*(F.struct((F.col(row) * len(columns) + k).alias("seen"), F.col(c).alias("id")) for k, c in enumerate(columns)))).alias("x")
    return pairs.select(places).groupBy("x.id").agg(F.min("x.seen").alias("first_seen"))


def cluster_map(members: DataFrame, member: str, rep: str, order: str) -> DataFrame:
    """member and rep; of several lines for a member the last one counts."""
    return members.groupBy(F.col(member).alias("member")).agg(F.max_by(rep, order).alias("rep"))


def first_value(rows: DataFrame, key: str, value: str, order: list[str], non_empty: bool) -> DataFrame:
    """The first value of each key, or the first that is not empty."""
    own = rows.where(F.coalesce(F.col(value), F.lit("")) != "") if non_empty else rows
    return sampling.keep_first(own.select(key, value, *order), [key], list(order)).select(key, value)


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """The ids of wanted that are not there: what is to be packed, fetched or computed, each once."""
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti")


def present_in_all(key: str, *tables: DataFrame) -> DataFrame:
    """The ids that all tables have, each once."""
    out = tables[0].select(key).distinct()
    for other in tables[1:]:
        out = out.join(other.select(key), key, "left_semi")
    return out


def union_ids(*columns: DataFrame) -> DataFrame:
    """The ids of several one-column tables as a set."""
    out = columns[0].toDF("id")
    for other in columns[1:]:
        out = out.union(other.toDF("id"))
    return out.distinct()


def lookup(pack: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of a pack with the wanted keys; the filter reaches the scan, and skips row groups of a table that is sorted by key."""
    return pack.where(F.col(key).isin(*wanted))


def named(tables: dict[str, DataFrame], name: str = "model") -> DataFrame:
    """Several tables of one schema as one, with the name of the table each row is from."""
    out = None
    for label, own in tables.items():
        own = own.withColumn(name, F.lit(label))
        out = own if out is None else out.unionByName(own)
    return out


def concat(tables: list[DataFrame]) -> DataFrame:
    """The rows of shards, one after another; the columns are those of the first, by name."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def next_shard(rows: DataFrame, shard: str) -> DataFrame:
    """The number of the shard that comes next: 0 if there is none."""
    return rows.agg(F.coalesce(F.max(shard) + 1, F.lit(0)).alias("next_shard"))


def status(*cases: tuple[Column, Column | str], otherwise: str | None = None) -> Column:
    """The text of the first case that holds; a condition that is null does not hold."""
    out = None
    for condition, text in cases:
        text = F.lit(text) if isinstance(text, str) else text
        out = F.when(condition, text) if out is None else out.when(condition, text)
    return out if otherwise is None else out.otherwise(otherwise)
