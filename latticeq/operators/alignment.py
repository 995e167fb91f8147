"""Alignments as strings, aligned positions, and runs of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers of an aligned column.
MARKERS = (":", ".", " ")


def aligned_pairs(df: DataFrame, key: str, first: str, marker: str, second: str, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """key, pos, i, j, both letters and the marker of every aligned column: both sides have a letter there and the marker is among `markers`.

    Positions count from 0; i and j count the letters of a side up to the column. Strings of unequal length raise.
    """
    sides = [F.split(F.col(c), "") for c in (first, marker, second)]
    even = (F.length(first) == F.length(marker)) & (F.length(marker) == F.length(second))
    columns = F.when(even, F.arrays_zip(*(s.alias(n) for s, n in zip(sides, ("a", "m", "b"), strict=True)))).otherwise(F.raise_error(F.concat(F.lit("unequal lengths for "), F.col(key).cast("string"))))
    long = df.select(F.col(key), F.posexplode(columns).alias("pos", "c")).select(key, "pos", F.col("c.a").alias("a"), F.col("c.m").alias("marker"), F.col("c.b").alias("b"))
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = long.withColumn("i", F.sum((F.col("a") != "-").cast("int")).over(order) - 1).withColumn("j", F.sum((F.col("b") != "-").cast("int")).over(order) - 1)
    return counted.where((F.col("a") != "-") & (F.col("b") != "-") & F.col("marker").isin(*markers)).select(key, "pos", "i", "j", "a", "marker", "b")


def segments(pairs: DataFrame, key: str) -> DataFrame:
    """Runs of pairs in which both positions grow by 1: key, i0, j0, len."""
    order = Window.partitionBy(key).orderBy("i")
    run = pairs.withColumn("_new", F.coalesce(((F.col("i") - F.lag("i").over(order)) != 1) | ((F.col("j") - F.lag("j").over(order)) != 1), F.lit(True)).cast("int"))
    run = run.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "_run").agg(F.min("i").alias("i0"), F.min("j").alias("j0"), F.count(F.lit(1)).alias("len")).drop("_run")


def expanded(runs: DataFrame, key: str) -> DataFrame:
    """The pairs of runs: key, i, j."""
    return runs.select(key, "i0", "j0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1)).alias("_k")).select(key, (F.col("i0") + F.col("_k")).alias("i"), (F.col("j0") + F.col("_k")).alias("j"))


def identity(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """The part of columns with letters on both sides whose letters are equal, 0 if there are none."""
    both = F.filter(F.zip_with(F.split(first, ""), F.split(second, ""), lambda a, b: F.when((a != "-") & (b != "-"), a == b)), lambda x: x.isNotNull())
    equal = F.size(F.filter(both, lambda x: x))
    return df.select(key, F.coalesce(F.try_divide(equal.cast("double"), F.size(both).cast("double")), F.lit(0.0)).alias("identity"))


#: Least and greatest shift of a negative, and how many random ones are tried.
SHIFTS, TRIES = (4, 32), 10


def _drawn(n: Column, *parts: Column) -> Column:
    """A number from 0 to n - 1 by md5 of the parts: the same on any cluster, and in any engine."""
    text = F.concat_ws("|", *(part.cast("string") for part in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def shifted(rows: DataFrame, keys: list[str], length: str, seed: int = 0) -> DataFrame:
    """rows (keys, i, j) with `shifted`: j moved by 4 to 32 places, either way, the other way if that leaves the sequence, else null."""
    own = [F.col(k) for k in keys]
    step = _drawn(F.lit(SHIFTS[1] - SHIFTS[0] + 1), *own, F.lit(seed), F.lit("step")) + SHIFTS[0]
    step = F.when(_drawn(F.lit(2), *own, F.lit(seed), F.lit("sign")) == 0, step).otherwise(-step)
    inside = lambda x: (x >= 0) & (x < F.col(length))
    there, back = F.col("j") + step, F.col("j") - step
    return rows.withColumn("shifted", F.when(inside(there), there).when(inside(back), back).cast("int"))


def random_pairs(rows: DataFrame, path: DataFrame, keys: list[str], group: str, lengths: tuple[str, str], seed: int = 0) -> DataFrame:
    """keys, group, ri and rj: the first of ten hashed pairs of places that is not on the path (group, i, j), the tenth if all are.

    Membership is an anti join on (group, i, j), so no path is gathered.
    """
    own = [F.col(k) for k in keys]
    tries = F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))).alias("t")
    tried = rows.select(*keys, group, *lengths, tries) if group not in keys else rows.select(*keys, *lengths, tries)
    for k, (name, length) in enumerate(zip(("ri", "rj"), lengths, strict=True)):
        tried = tried.withColumn(name, _drawn(F.col(length), *own, F.lit(seed), F.col("t"), F.lit(k)))
    there = path.select(F.col(group), F.col("i").cast("int").alias("ri"), F.col("j").cast("int").alias("rj"), F.lit(1).alias("_on"))
    marked = tried.join(there, [group, "ri", "rj"], "left")
    best = F.min(F.struct(F.when(F.col("_on").isNull(), F.col("t")).otherwise(F.lit(TRIES) - F.col("t") + TRIES).alias("o"), "ri", "rj"))  # off the path first, else the last try
    return marked.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.ri", "x.rj")


def negatives(pairs: DataFrame, key: str, length: str, stride: int = 32, seed: int = 0, first_length: str | None = None) -> DataFrame:
    """Every stride-th aligned pair and one negative for each: shifted for even numbers, random for odd ones and where no shift fits.

    pairs has key, pos, i, j and the second side's length; random places of the first side come from its own length, else from the second's. Rows
    are key, k, pair_type, pos (-1 for negatives), i, j.
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1  # a group is one pair of sequences
    own = pairs.withColumn("k", number).where(F.col("k") % stride == 0).withColumn("k", (F.col("k") / stride).cast("int"))
    moved = shifted(own, [key, "k"], length, seed).withColumn("_shifted", F.when(F.col("k") % 2 == 0, F.col("shifted")))
    drawn = random_pairs(moved.where("_shifted is null").withColumn("_first", F.col(first_length or length)), pairs, [key, "k"], key, ("_first", length), seed)
    joined = moved.join(drawn, [key, "k"], "left")
    negative = joined.select(key, "k", F.when(F.col("_shifted").isNotNull(), "shifted").otherwise("random").alias("pair_type"), F.lit(-1).alias("pos"), F.when(F.col("_shifted").isNotNull(), F.col("i")).otherwise(F.col("ri")).cast("int").alias("i"), F.coalesce("_shifted", "rj").cast("int").alias("j"))
    return own.select(key, "k", F.lit("aligned").alias("pair_type"), "pos", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).unionByName(negative)


def whole_pairs(rows: DataFrame, key: str, failed: Column) -> DataFrame:
    """The rows of the keys none of whose rows failed: all of a pair, or nothing."""
    bad = rows.where(F.coalesce(failed, F.lit(True))).select(key).distinct()
    return rows.join(bad, key, "left_anti")
