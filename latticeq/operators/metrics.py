"""Regression metrics, bucket tables, calibration and agreement, as aggregations. A missing value is null; a spread of 0 gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling


def r6(x: Column) -> Column:
    return F.round(x, 6)


def varies(x: Column) -> Column:
    """Whether a column has two values. A spread that is joined from parts may miss 0 by its rounding where all values are equal, so it cannot tell."""
    return F.min(x) < F.max(x)


def variance(x: Column) -> Column:
    """The population variance, exactly 0 of equal values."""
    return F.when(F.min(x) == F.max(x), 0.0).otherwise(F.var_pop(x))


def pearson(x: Column, y: Column) -> Column:
    """Correlation, or null if a side does not vary."""
    return F.when(varies(x) & varies(y), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def rank_table(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each distinct value with the average rank of its ties, by keys: values are counted first, and ranks come from running counts over ranges of them."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = sampling.running(counts, value, "_n", "_before", keys=keys)
    return ranks.select(*keys, value, (F.coalesce("_before", F.lit(0)) + (F.col("_n") + 1) / 2).alias(out))


def tied_rank(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with average ranks of ties."""
    return df.join(rank_table(df, value, out, keys), [*keys, value])


def quantiles(df: DataFrame, value: str, parts: list[float], names: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles by keys, interpolated between neighbouring values. Only counts of distinct values move, and no task holds all those of a key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = sampling.running(counts, "_v", "_n", "_before", keys=keys).withColumn("_before", F.coalesce("_before", F.lit(0)))
    size = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    joined = placed.join(size, list(keys)) if keys else placed.crossJoin(F.broadcast(size))  # without keys, one row
    found, out = [], []
    for k, q in enumerate(parts):
        at = F.lit(float(q)) * (F.col("_size") - 1)
        for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            found.append(F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_v"))).alias(f"_{end}{k}"))
        share = at - F.floor(at)
        out.append((F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * share).alias(names[k]))
    return joined.groupBy(*keys, "_size").agg(*found).select(*keys, *out)


def regression(df: DataFrame, pred: str, target: str, keys: tuple[str, ...] = (), spearman: bool = True) -> DataFrame:
    """n, mse, rmse, mae, bias, baseline_mse, r2, pearson, spearman, means and population deviations by keys."""
    df = df.where(F.col(pred).isNotNull() & F.col(target).isNotNull())
    if spearman:
        ranks = [(rank_table(df, c, out, keys), c) for c, out in ((pred, "_rp"), (target, "_rt"))]
        for table, c in ranks:
            df = df.join(table, [*keys, c])
    p, t = F.col(pred), F.col(target)
    mse, baseline = F.avg((p - t) * (p - t)), variance(t)
    found = [F.count(F.lit(1)).alias("n"), r6(mse).alias("mse"), r6(F.sqrt(mse)).alias("rmse"), r6(F.avg(F.abs(p - t))).alias("mae"), r6(F.avg(p - t)).alias("bias"), r6(baseline).alias("baseline_mse")]
    found += [r6(1 - F.try_divide(mse, baseline)).alias("r2"), r6(pearson(p, t)).alias("pearson")]
    if spearman:
        found.append(r6(pearson(F.col("_rp"), F.col("_rt"))).alias("spearman"))
    found += [r6(F.avg(p)).alias("pred_mean"), r6(F.avg(t)).alias("target_mean"), r6(F.stddev_pop(p)).alias("pred_std"), r6(F.stddev_pop(t)).alias("target_std")]
    return df.groupBy(*keys).agg(*found) if keys else df.agg(*found)


def bucket(x: Column, edges: list[float], closed_end: bool = True) -> Column:
    """The number of the half-open bucket of x, or null outside; the last bucket may include its end."""
    case = None
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (x >= low) & ((x < high) | (F.lit(closed_end and k == len(edges) - 2) & (x == high)))
        case = F.when(inside, k) if case is None else case.when(inside, k)
    return case


def error_by_bucket(df: DataFrame, pred: str, target: str, by: str, edges: list[float], keys: tuple[str, ...] = (), closed_end: bool = True, least: int = 1) -> DataFrame:
    """n, mean target and prediction, mae, mse and bias for each bucket of a column with rows enough."""
    error = F.col(pred) - F.col(target)
    own = df.withColumn("bucket", bucket(F.col(by), edges, closed_end)).where("bucket is not null").groupBy(*keys, "bucket")
    out = own.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(target)).alias("target_mean"), r6(F.avg(pred)).alias("pred_mean"), r6(F.avg(F.abs(error))).alias("mae"), r6(F.avg(error * error)).alias("mse"), r6(F.avg(error)).alias("bias"))
    return out.where(F.col("n") >= least)


def calibration(df: DataFrame, pred: str, target: str, bins: int = 15) -> DataFrame:
    """Mean prediction and target in bins between quantiles of the prediction; equal quantiles leave bins empty."""
    names = [f"_e{k}" for k in range(bins + 1)]
    edges = quantiles(df, pred, [k / bins for k in range(bins + 1)], names).select(F.array(*names).alias("edges"))
    place = F.size(F.filter("edges", lambda e: e <= F.col(pred))) - 1
    own = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)))  # edges: one row
    return own.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(pred)).alias("pred_mean"), r6(F.avg(target)).alias("target_mean"))


def agreement(df: DataFrame, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    own = [r6(F.avg(x)).alias("mean"), r6(F.avg((F.col(x) < 0.5).cast("double"))).alias("below_half")]
    means = df.groupBy(*keys).agg(*own)
    parts = quantiles(df, x, [0.5, 0.1], ["median", "p10"], keys)
    joined = means.join(parts, list(keys)) if keys else means.crossJoin(parts)
    return joined.select(*keys, "mean", r6(F.col("median")).alias("median"), r6(F.col("p10")).alias("p10"), "below_half")


def box_statistics(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Quartiles by keys, and the ends of the whiskers: the farthest values within one and a half times the box."""
    boxes = quantiles(df, value, [0.25, 0.5, 0.75], ["q1", "q2", "q3"], keys)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = df.join(boxes, list(keys)).groupBy(*keys, "q1", "q2", "q3")
    own = ends.agg(F.min(F.when(F.col(value) >= F.col("q1") - reach, F.col(value))).alias("low"), F.max(F.when(F.col(value) <= F.col("q3") + reach, F.col(value))).alias("high"))
    return own.select(*keys, *(r6(F.col(c)).alias(c) for c in ("q1", "q2", "q3", "low", "high")))


def timing_summary(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """n, median, mean, 90th percentile as the value at place floor(0.9 (n - 1)), and total by keys."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = sampling.running(counts, value, "_n", "_before", keys=keys).withColumn("_before", F.coalesce("_before", F.lit(0)))
    whole = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(value)).alias("mean"), F.round(F.sum(value), 4).alias("total"))
    rank = F.floor((F.col("n") - 1) * 0.9)
    p90 = placed.join(whole, list(keys)).where((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))).select(*keys, r6(F.col(value)).alias("p90"))
    middle = quantiles(df, value, [0.5], ["median"], keys)
    return whole.join(p90, list(keys)).join(middle, list(keys)).select(*keys, "n", r6(F.col("median")).alias("median"), "mean", "p90", "total")


def reproduction(df: DataFrame, one: str, other: str, least: float = 1e-4) -> DataFrame:
    """The greatest difference of two columns, and the share of rows that differ by more than `least`."""
    apart = F.abs(F.col(one) - F.col(other))
    return df.agg(r6(F.max(apart)).alias("most"), r6(F.avg((apart > least).cast("double"))).alias("share"))


def weighted_loss(df: DataFrame, loss: str, n: str) -> DataFrame:
    """The mean loss of batches, each weighing as many rows as it has."""
    return df.agg(r6(F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"))


def distillation(cosine: Column, mask: Column) -> Column:
    """1 - cosine over the rows of the mask, as a mean; 0 if there are none."""
    return masked_mean(1 - cosine, mask)


def validation(df: DataFrame, pred: str, target: str, kind: str) -> DataFrame:
    """n and mse overall and by kind, of kinds with two rows or more."""
    error = F.col(pred) - F.col(target)
    own = [F.count(F.lit(1)).alias("n"), r6(F.avg(error * error)).alias("mse")]
    kinds = df.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("kind")).agg(*own)
    return df.agg(*own).select(F.lit("overall").alias("kind"), "n", "mse").unionByName(kinds).where("n > 1")


def best_so_far(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with `best`: whether a value is less than all before it in order."""
    return sampling.running(df, order, value, "_least", F.min).withColumn("best", F.coalesce(F.col(value) < F.col("_least"), F.lit(True))).drop("_least")


def report_block(df: DataFrame, pred: str, target: str) -> DataFrame:
    """name and value of the figures that a report's block prints."""
    error = F.col(pred) - F.col(target)
    row = df.agg(F.count(F.lit(1)).cast("double").alias("n"), r6(F.avg(error * error)).alias("mse"), r6(F.avg(error)).alias("bias"))
    return row.unpivot([], ["n", "mse", "bias"], "name", "value")


def masked_mean(x: Column, mask: Column) -> Column:
    return F.sum(F.when(mask, x).otherwise(0.0)) / F.greatest(F.sum(mask.cast("int")), F.lit(1))


def confusion(df: DataFrame, pred: str, target: str, cut: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall of 'at least cut'; an empty denominator counts as 1."""
    p, t = F.col(pred) >= cut, F.col(target) >= cut
    count = lambda x: F.sum(x.cast("bigint"))
    ratio = lambda a, b: r6(count(a) / F.greatest(count(b), F.lit(1)))
    return df.agg(F.count(F.lit(1)).alias("n"), ratio(p == t, F.lit(True)).alias("accuracy"), ratio(p & t, p).alias("precision"), ratio(p & t, t).alias("recall"))


def noise_stats(df: DataFrame, reference: str, one: str, other: str) -> DataFrame:
    """Bias and variance of a perturbed label against its reference, half the variance between two draws, and the ceiling they set on r2."""
    shift, between = F.col(one) - F.col(reference), F.var_pop(F.col(one) - F.col(other)) / 2
    return df.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(shift)).alias("bias"), r6(F.var_pop(shift)).alias("variance"), r6(between).alias("sigma2"), r6(1 - F.try_divide(between, variance(F.col(reference)))).alias("ceiling"))


def loss_total(terms: dict[str, Column], weights: dict[str, float], log_scales: dict[str, float] | None = None) -> Column:
    """Weighted sum of loss terms, or with log scales the sum of w * (exp(-s) * loss + s). Terms without weight are skipped; none left is an error."""
    own = {name: weights[name] for name in terms if weights.get(name)}
    if not own:
        raise ValueError("no loss term has a weight")
    parts = []
    for name, w in own.items():
        s = None if log_scales is None else float(log_scales.get(name, 0.0))
        parts.append(w * terms[name] if s is None else w * (F.exp(F.lit(-s)) * terms[name] + s))
    return sum(parts[1:], parts[0])
