"""Places in an order, running totals, groups, strides and runs, without a task that sees all rows.

All of them deal rows to ranges of the whole sort key, whose bounds come from a sample of keys, work within a range, and add what the ranges
before it hold, which is a row for each range. Keys are of any type that Spark orders: numbers, texts, dates, several columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StructType, TimestampType, VariantType

from ..sources.shared import stored

#: Keys of the sample for each range: a range then holds under twice its share, but for rows that are equal in every column.
SAMPLED = 100
#: Bounds that are compared one by one after every so-many-th has told the place roughly.
STEP = 16


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def orderable(df: DataFrame, but: list[str] | None = None) -> list[str]:
    """The columns of df that have an order, but some."""
    return [f.name for f in df.schema.fields if f.name not in (but or []) and not isinstance(f.dataType, MapType | VariantType)]


def tie_breaker(df: DataFrame, order: list[str]) -> Column | None:
    """A number from the columns that the order does not name, so that rows with equal keys fall into several ranges; None if there are no such columns."""
    rest = [f.name for f in df.schema.fields if f.name not in order and not isinstance(f.dataType, ArrayType | MapType | StructType | VariantType)]
    return F.xxhash64(*(F.col(f"`{name}`") for name in rest)) if rest else None


def bounds(df: DataFrame, key: Column, ranges: int) -> DataFrame:
    """One row: the keys (all) that part df into ranges of about as many rows each, and every STEP-th of them (some). It is stored, so that every use sees the same bounds."""
    sample = df.select(key.alias("k")).orderBy(F.rand(17)).limit(SAMPLED * ranges)
    sorted_ = sample.agg(F.sort_array(F.collect_list("k")).alias("s"))  # SAMPLED keys a range
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get(F.col("s"), F.floor(i * F.size("s") / ranges).cast("int")))
    chosen = sorted_.where(F.size("s") > 0).select(F.array_distinct(at).alias("all"))
    return stored(chosen.select("all", F.filter("all", lambda x, i: i % STEP == 0).alias("some")))


def ranged(df: DataFrame, order: str | list[str], out: str = "_part", ties: bool = True) -> DataFrame:
    """df with the number of the range that a row's sort key falls in; there are as many ranges as shuffle partitions, nulls come first.

    With ties, rows with equal keys are told apart by their other columns, so that a key of half of the rows is dealt to half of the ranges; the
    order by key and then by range is still the order by key.
    """
    names, width = [order] if isinstance(order, str) else list(order), _width(df)
    if width < 2:
        return df.withColumn(out, F.lit(0))
    tie = tie_breaker(df, names) if ties else None
    kind = df.schema[names[0]].dataType
    if len(names) == 1 and tie is None and isinstance(kind, NumericType | TimestampType):
        return _by_quantiles(df, names[0], F.unix_micros(names[0]) if isinstance(kind, TimestampType) else F.col(f"`{names[0]}`").cast("double"), width, out)
    key = F.struct(*(F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(names)), *([] if tie is None else [tie.alias("tie")]))
    limits = bounds(df, key, width).withColumnsRenamed({"all": "_all_bounds", "some": "_some_bounds"})
    placed = df.withColumn("_range_key", key).join(F.broadcast(limits), how="left")  # one row, or none for an empty table
    rough = F.size(F.filter("_some_bounds", lambda x: x < F.col("_range_key")))
    placed = placed.withColumn("_rough", F.coalesce(rough, F.lit(0)))
    near = F.size(F.filter(F.slice("_all_bounds", (F.col("_rough") - 1) * STEP + 2, STEP - 1), lambda x: x < F.col("_range_key")))
    place = F.when(F.col("_rough") == 0, 0).otherwise((F.col("_rough") - 1) * STEP + 1 + near)
    return placed.withColumn(out, place.cast("int")).drop("_range_key", "_all_bounds", "_some_bounds", "_rough")


def _by_quantiles(df: DataFrame, order: str, number: Column, width: int, out: str) -> DataFrame:
    """As ranged, for one number: bounds are its quantiles, an aggregation in the same plan."""
    limits = df.agg(F.percentile_approx(number, F.array(*(F.lit(k / width) for k in range(1, width))), 10_000).alias("_bounds"))
    place = F.coalesce(F.size(F.filter("_bounds", lambda x: x < number)), F.lit(0))
    return df.crossJoin(F.broadcast(limits)).withColumn(out, F.when(number.isNull(), 0).otherwise(place)).drop("_bounds")  # one row of bounds


def _before(parts: DataFrame, keys: list[str], total: str, how=F.sum) -> DataFrame:
    """parts (keys, _part, total) with what the ranges before hold: a row for each range and key."""
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", how(total).over(earlier)).drop(total)


def numbered(df: DataFrame, order: list[str], out: str = "number", keys: tuple[str, ...] = (), ties: bool = True) -> DataFrame:
    """df with each row's place from 0 in the order of its columns, within keys if there are any. Rows that the order does not tell apart share no place, in any order.

    A key of many rows is dealt to ranges like all others, and so are rows with one value of the order. ties: whether there may be such rows.
    """
    own = [*keys]
    parts = ranged(df, order, ties=ties)
    sizes = parts.groupBy(*own, "_part").agg(F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*own, "_part").orderBy(*order)) - 1
    before = _before(sizes, own, "_n").withColumnsRenamed({c: f"_k{i}" for i, c in enumerate([*own, "_part"])})
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*own, "_part"])]
    joined = parts.withColumn("_place", place).join(before, same)
    return joined.withColumn(out, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("bigint")).select(*(c for c in df.columns if c != out), out)


def running(df: DataFrame, order: str, value: str, out: str, how=F.sum, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with the total of `value` over the rows before each one in the order of a column of distinct values, within keys: null for the first. how: F.sum, F.min or F.max."""
    own = [*keys]
    parts = ranged(df, order, ties=False)
    totals = parts.groupBy(*own, "_part").agg(how(value).alias("_n"))
    within = how(value).over(Window.partitionBy(*own, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    before = _before(totals, own, "_n", how).withColumnsRenamed({c: f"_k{i}" for i, c in enumerate([*own, "_part"])})
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*own, "_part"])]
    joined = parts.withColumn("_within", within).join(before, same)
    if how is F.sum:
        both = F.when(F.col("_within").isNull() & F.col("_before").isNull(), None).otherwise(F.coalesce("_within", F.lit(0)) + F.coalesce("_before", F.lit(0)))
    else:
        both = (F.least if how is F.min else F.greatest)("_within", "_before")  # nulls are skipped
    return joined.withColumn(out, both).select(*(c for c in df.columns if c != out), out)


def key_numbers(df: DataFrame, key: str, out: str = "number") -> DataFrame:
    """The distinct keys of df and their place in order, from 0."""
    return numbered(df.select(key).distinct(), [key], out)


def group_range(df: DataFrame, key: str, skip: int, count: int) -> DataFrame:
    """All rows of `count` groups in the order of their keys, after skipping some."""
    numbers = key_numbers(df, key).where((F.col("number") >= skip) & (F.col("number") < skip + count)).select(key)
    return df.join(numbers, key, "left_semi")


def buffers(df: DataFrame, key: str, size: int) -> DataFrame:
    """Each key and the number of its buffer of `size` groups."""
    return key_numbers(df, key).select(key, F.floor(F.col("number") / size).cast("bigint").alias("buffer"))


def offsets(df: DataFrame, key: str, out: str = "first") -> DataFrame:
    """Each key and the number of rows with lesser keys: where its rows start when they lie in order."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return running(counts, key, "_rows", out).select(key, F.coalesce(out, F.lit(0)).cast("bigint").alias(out))


def every(df: DataFrame, order: list[str], step: int, first: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each step-th row in order, from the row `first` on: a stride, or part `first` of `step` parts."""
    return numbered(df, order, "_number", keys).where(F.col("_number") % step == first).drop("_number")


def blocks(df: DataFrame, order: list[str], size: int, out: str = "block") -> DataFrame:
    """df with the number of the block of `size` rows in order that a row falls in."""
    return numbered(df, order, "_number").withColumn(out, F.floor(F.col("_number") / size).cast("bigint")).drop("_number")


def key_runs(df: DataFrame, key: str, order: str, out: str = "runs") -> DataFrame:
    """How many times each key starts anew when rows are read in the order of a column of distinct values."""
    own = ranged(df.select(key, order), order, ties=False)
    lagged = F.lag(F.struct(key)).over(Window.partitionBy("_part").orderBy(order))
    last = own.groupBy("_part").agg(F.max_by(F.struct(key), order).alias("_last"))
    last = last.withColumn("_earlier", F.lag("_last").over(Window.orderBy("_part"))).drop("_last")  # a row for each range
    starts = own.withColumn("_lagged", lagged).join(F.broadcast(last), "_part").withColumn("_previous", F.coalesce("_lagged", "_earlier"))
    new = F.col("_previous").isNull() | ~F.col(f"_previous.{key}").eqNullSafe(F.col(key))
    return starts.groupBy(key).agg(F.sum(new.cast("bigint")).alias(out))


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an order. Rows are compared before the shuffle, so many rows of one key cost no more than one a task."""
    ranks = [F.struct(*(F.col(c) if isinstance(c, str) else c for c in order)).alias("_o"), F.struct(*df.columns).alias("_x")]
    return df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *ranks).groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.min(F.struct("_o", "_x")).alias("m")).select("m._x.*")
