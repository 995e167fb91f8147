"""Joins of pairs with what is known about their sides, and of tables that complete each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import spread
from . import sampling

#: Nodes of a group that are one row of work.
PAIRED = 512


def both_sides(pairs: DataFrame, known: DataFrame, left: str, right: str, key: str, values: list[str]) -> DataFrame:
    """pairs with the values of both sides, as value1 and value2; a pair needs both."""
    for number, side in ((1, left), (2, right)):
        renamed = known.select(F.col(key).alias(side), *(F.col(v).alias(f"{v}{number}") for v in values))
        pairs = pairs.join(renamed, side)
    return pairs


def coverage(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """How many ids of wanted are present and missing there, and how many there are extra."""
    sides = wanted.select(key, F.lit(1).alias("w"), F.lit(0).alias("t")).unionByName(there.select(key, F.lit(0).alias("w"), F.lit(1).alias("t")))
    each = sides.groupBy(key).agg(F.max("w").alias("w"), F.max("t").alias("t"))
    counts = each.agg(*(F.sum(x.cast("bigint")).alias(name) for name, x in (("present", F.col("w") * F.col("t")), ("missing", F.col("w") * (1 - F.col("t"))), ("extra", (1 - F.col("w")) * F.col("t")))))
    return counts.unpivot([], ["present", "missing", "extra"], "kind", "n").withColumn("n", F.coalesce("n", F.lit(0)))


def first_match(rows: DataFrame, known: DataFrame, left: str, right: str, value: str, order: list[str]) -> DataFrame:
    """rows with the value of the first matching row of known, or null."""
    first = sampling.keep_first(known, [right], list(order)).select(F.col(right).alias(left), value)
    return rows.join(first, left, "left")


def reindexed(keys: DataFrame, counts: DataFrame, key: str, value: str, fill: object = 0) -> DataFrame:
    """Every key with its value, or with the fill."""
    return keys.select(key).join(counts.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def by_method(tables: dict[str, DataFrame], key: str, value: str, fill: object = 0) -> DataFrame:
    """A column for each method, over all keys that any of them has."""
    out = None
    for name, own in tables.items():
        own = own.select(key, F.col(value).alias(name))
        out = own if out is None else out.join(own, key, "full")
    return out.fillna(fill, list(tables))


def node_pairs(nodes: DataFrame, group: str, node: str) -> DataFrame:
    """All ordered pairs (i, j) of different nodes of a group. Some nodes of a group, with the list of all, are one row of work, so a large group is dealt to many tasks."""
    lists = nodes.where(F.col(group).isNotNull()).groupBy(group).agg(F.collect_list(node).alias("_all")).where(F.size("_all") > 0)  # one patch or structure
    work = spread(lists.select(group, "_all", F.explode(F.sequence(F.lit(0), F.size("_all") - 1, F.lit(PAIRED))).alias("_start")), group, "_start")
    one = work.select(group, "_all", F.explode(F.slice("_all", F.col("_start") + 1, PAIRED)).alias("i"))
    return one.select(group, "i", F.explode("_all").alias("j")).where("i <> j")


def keep_earlier(new: DataFrame, old: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """new with a column of an older table where that has the key, else with the default column of its own."""
    known = old.select(key, F.col(column).alias("_old"))
    return new.join(known, key, "left").withColumn("value", F.coalesce("_old", default)).drop("_old")


def by_distance(left: DataFrame, right: DataFrame, i: str, j: str, partner: str, reach: int) -> DataFrame:
    """Every cell of a matrix (i, j) as aligned, near or far from the partner of its row. The sides are the residues of one pair of chains."""
    apart = F.abs(F.col(j) - F.col(partner))
    cells = left.crossJoin(right)  # one matrix: both sides are bounded by the length of a chain
    return cells.select(i, j, F.when(apart == 0, "aligned").when(apart <= reach, "near").otherwise("far").alias("cell"))


def with_fallback(rows: DataFrame, known: DataFrame, key: str, fits: Column, value: Column, fallback: Column) -> DataFrame:
    """rows with a value where the known row of their key fits, else with the fallback."""
    return rows.join(known, key, "left").withColumn("value", F.when(fits, value).otherwise(fallback))
