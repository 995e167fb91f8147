"""Audits of tables: histograms, ranges, gaps, shares, and comparisons of what is stored with what should be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, sampling

r6 = metrics.r6


def count_if(condition: Column) -> Column:
    """How many rows the condition holds for, as a number."""
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


def share_of(condition: Column) -> Column:
    return r6(F.avg(F.coalesce(condition, F.lit(False)).cast("double")))


def histogram(df: DataFrame, by: Column | str, name: str) -> DataFrame:
    """n by value."""
    return df.groupBy((F.col(by) if isinstance(by, str) else by).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, by: Column, name: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value: the report's first lines."""
    return histogram(df, by, name).orderBy(F.col("n").desc(), F.col(name).asc_nulls_last()).limit(k)


def merged_counts(df: DataFrame, shard: Column, reason: str) -> DataFrame:
    """Counters of shards, added up by reason."""
    own = df.groupBy(shard.alias("shard"), F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return own.groupBy("reason").agg(F.sum("n").alias("n"))


def distinct_counts(df: DataFrame, **columns: str) -> DataFrame:
    """The number of distinct values of each column, and of rows; each column is counted on its own."""
    out = df.agg(F.count(F.lit(1)).alias("n"))
    for name, column in columns.items():
        out = out.crossJoin(df.select(column).distinct().agg(F.count(column).alias(name)))  # one row each
    return out.select(*columns, "n")


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """Least, middle, greatest and mean number of rows of a key, and how many keys have one row."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    own = sizes.agg(F.min("size").alias("least"), F.max("size").alias("most"), r6(F.avg("size")).alias("mean"), count_if(F.col("size") == 1).alias("singles"))
    return own.crossJoin(metrics.quantiles(sizes, "size", [0.5], ["middle"])).select("least", "middle", "most", "mean", "singles")  # one row each


def duplicates_and_gaps(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of a key, the span of keys, and how many keys in it do not occur."""
    each = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    span = (F.max(key) - F.min(key) + 1).cast("bigint")
    return each.agg((F.sum("n") - F.count(key)).alias("duplicates"), span.alias("span"), (span - F.count(key)).alias("gaps"))


def ranges(df: DataFrame, number: str, text: str) -> DataFrame:
    """Range and missing values of a number, and how many values of a text are no numbers."""
    return df.agg(F.min(number).alias("low"), F.max(number).alias("high"), count_if(F.col(number).isNull()).alias("missing"), count_if(F.col(text).try_cast("double").isNull()).alias("not_numbers"))


def text_lengths(df: DataFrame, text: str, length: str) -> DataFrame:
    """Texts whose length is not the stored one, empty ones, and blank ones."""
    own = F.col(text)
    return df.agg(count_if(F.length(own) != F.col(length)).alias("mismatched"), count_if(own == "").alias("empty_texts"), count_if(F.trim(own) == "").alias("blank_texts"))


def shares(df: DataFrame, by: Column, name: str) -> DataFrame:
    """n and percent by value."""
    counts = histogram(df, by, name)
    whole = df.agg(F.count(F.lit(1)).alias("_all"))
    return counts.crossJoin(F.broadcast(whole)).select(name, "n", r6(100 * F.col("n").cast("double") / F.col("_all")).alias("share"))  # one row


def cut_shares(df: DataFrame, value: str, **cuts: float) -> DataFrame:
    """The shares of rows under each cut."""
    return df.agg(*(share_of(F.col(value) < cut).alias(name) for name, cut in cuts.items()))


def cluster_summary(df: DataFrame, rep: str) -> DataFrame:
    """Members, representatives and mean size of clusters."""
    each = df.groupBy(rep).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("members"), F.count(rep).alias("representatives"), r6(F.sum("n").cast("double") / F.count(rep)).alias("mean_size"))


def domain_summary(df: DataFrame, fold: str, family: str, length: str, multi: Column) -> DataFrame:
    """Distinct folds and families, median and greatest length, and how many domains a condition holds for."""
    kinds = df.select(fold).distinct().agg(F.count(fold).alias("folds")).crossJoin(df.select(family).distinct().agg(F.count(family).alias("families")))
    lengths = metrics.quantiles(df, length, [0.5], ["median_length"])
    return kinds.crossJoin(lengths).crossJoin(df.agg(F.max(length).alias("longest"), count_if(multi).alias("multi")))  # one row each


def failure_gate(df: DataFrame, failed: Column, most: float = 0.01) -> DataFrame:
    """Rows, failures, and whether their share is within bounds."""
    return df.agg(F.count(F.lit(1)).alias("total"), count_if(failed).alias("failed"), (share_of(failed) <= most).alias("passed"))


def sampled_kinds(sample: DataFrame, kind: Column, part: float) -> DataFrame:
    """Counts by kind in a sample that is a part of a table, and what a table of this part would have."""
    return histogram(sample, kind, "kind").withColumn("extrapolated", F.floor(F.col("n") * part).cast("bigint"))


def verified(stored: DataFrame, recomputed: DataFrame, key: str, value: str) -> DataFrame:
    """How many stored values differ from recomputed ones, of how many that both have."""
    other = recomputed.select(key, F.col(value).alias("_again"))
    return stored.select(key, value).join(other, key).agg(count_if(~F.col(value).eqNullSafe(F.col("_again"))).alias("mismatches"), F.count(F.lit(1)).alias("checked"))


def changed(saved: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """The settings of both tables whose values differ."""
    own, now = saved.select(key, F.col(value).alias("saved")), current.select(key, F.col(value).alias("current"))
    return own.join(now, key).where(~F.col("saved").eqNullSafe(F.col("current")))


def resume_position(df: DataFrame, complete: Column, epoch: str, batch: Column, size: int) -> DataFrame:
    """Where a run goes on: at the start of the next epoch if one is complete, else in the same one, behind the batches done."""
    return df.withColumns({"epoch": F.when(complete, F.col(epoch) + 1).otherwise(F.col(epoch)), "start_pair": F.when(complete, 0).otherwise(batch * size)})


def unequal(one: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows of one that the other does not have."""
    return one.join(other, [one[c].eqNullSafe(other[d]) for c, d in zip(one.columns, other.columns, strict=True)], "left_anti").distinct()


def best_configs(df: DataFrame, key: str, k: int, **scores: str) -> DataFrame:
    """The k configurations with the greatest mean scores, the first score first, ties by key."""
    means = df.groupBy(key).agg(*(r6(F.avg(F.col(column).cast("double"))).alias(name) for name, column in scores.items()))
    return means.orderBy(*(F.col(name).desc() for name in scores), key).limit(k)


def softmax(df: DataFrame, value: str, temperature: float, key: str, out: str) -> DataFrame:
    """The soft share of each row's value among those of its key: maxima and sums come from aggregations, so that a key of many rows is no single task's."""
    top = df.groupBy(key).agg(F.max(value).alias("_top"))
    weighed = df.join(top, key).withColumn("_w", F.exp((F.col(value) - F.col("_top")) / temperature))
    return weighed.join(weighed.groupBy(key).agg(F.sum("_w").alias("_sum")), key).withColumn(out, F.col("_w") / F.col("_sum")).drop("_top", "_w", "_sum")


def z_scores(df: DataFrame, value: str, key: str, out: str, eps: float = 1e-12) -> DataFrame:
    """Each row's value less the mean of its key, over its population deviation; means come from an aggregation."""
    means = df.groupBy(key).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    return df.join(means, key).withColumn(out, (F.col(value) - F.col("_mean")) / (F.col("_std") + eps)).drop("_mean", "_std")


def average_rank(df: DataFrame, value: str, out: str = "average_rank") -> DataFrame:
    return metrics.tied_rank(df, value, out)


part_of = sampling.every
