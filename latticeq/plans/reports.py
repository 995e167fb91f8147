"""Regression reports, window operators, and losses over the label analogue: predictions and targets of lineitem rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import alignment, audits, metrics, sampling
from ..registry import over_tables, query, table
from .tables import LABELS, labels


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(lambda name: table(spark, sf_dir, name))


_RANKED = "SELECT *, rank() OVER ({0} ORDER BY pred) + (count(*) OVER ({1} pred) - 1) / 2.0 AS rp, rank() OVER ({0} ORDER BY target) + (count(*) OVER ({1} target) - 1) / 2.0 AS rt FROM (" + LABELS + ")"
_METRICS = """count(*)::BIGINT AS n, round(avg((pred - target) ** 2), 6) AS mse, round(sqrt(avg((pred - target) ** 2)), 6) AS rmse, round(avg(abs(pred - target)), 6) AS mae,
round(avg(pred - target), 6) AS bias, round(var_pop(target), 6) AS baseline_mse, round(1 - avg((pred - target) ** 2) / nullif(var_pop(target), 0), 6) AS r2,
round(covar_pop(pred, target) / nullif(stddev_pop(pred) * stddev_pop(target), 0), 6) AS pearson, {0}
round(avg(pred), 6) AS pred_mean, round(avg(target), 6) AS target_mean, round(stddev_pop(pred), 6) AS pred_std, round(stddev_pop(target), 6) AS target_std"""
_SPEARMAN = "round(covar_pop(rp, rt) / nullif(stddev_pop(rp) * stddev_pop(rt), 0), 6) AS spearman,"


@query("A12_regression_metrics", f"SELECT {_METRICS.format(_SPEARMAN)} FROM ({_RANKED.format('', 'PARTITION BY')})")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regression(rows(spark, sf_dir), "pred", "target")


@query("A16_metrics_by_type", f"SELECT pair_type, {_METRICS.format(_SPEARMAN)} FROM ({_RANKED.format('PARTITION BY pair_type', 'PARTITION BY pair_type,')}) GROUP BY pair_type")
def metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regression(rows(spark, sf_dir), "pred", "target", ("pair_type",))


@query("A15_summary", f"SELECT count(*)::BIGINT AS n, round(avg((pred - target) ** 2), 6) AS mse, round(1 - avg((pred - target) ** 2) / nullif(var_pop(target), 0), 6) AS r2, round(covar_pop(pred, target) / nullif(stddev_pop(pred) * stddev_pop(target), 0), 6) AS pearson FROM ({LABELS})")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regression(rows(spark, sf_dir), "pred", "target", spearman=False).select("n", "mse", "r2", "pearson")


@query("A13_guarded_pearson", f"SELECT pair_type, round(covar_pop(pred, target) / nullif(stddev_pop(pred) * stddev_pop(target), 0), 6) AS pearson, CAST(NULL AS DOUBLE) AS constant FROM ({LABELS}) GROUP BY pair_type")
def guarded_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = F.col("pred"), F.col("target")
    return rows(spark, sf_dir).groupBy("pair_type").agg(F.round(metrics.pearson(p, t), 6).alias("pearson"), F.round(metrics.pearson(p, F.lit(1.0)), 6).alias("constant"))


@query("A14_tied_ranks", f"SELECT DISTINCT target, rt FROM ({_RANKED.format('', 'PARTITION BY')})".replace("rt FROM", "CAST(rt AS DOUBLE) AS rt FROM", 1))
def tied_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tied_rank(rows(spark, sf_dir), "target", "rt").select("target", "rt").distinct()


def _bucket_sql(edges: list[float], closed: bool) -> str:
    last = len(edges) - 2
    return "CASE " + " ".join(f"WHEN {{0}} >= {a} AND {{0}} {'<=' if closed and k == last else '<'} {b} THEN {k}" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))) + " END"


FIFTHS, HALF_OPEN = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], [0.0, 0.2, 0.4, 0.6, 0.8, 1.01]
_ERRORS = "count(*)::BIGINT AS n, round(avg(target), 6) AS target_mean, round(avg(pred), 6) AS pred_mean, round(avg(abs(pred - target)), 6) AS mae, round(avg((pred - target) * (pred - target)), 6) AS mse, round(avg(pred - target), 6) AS bias"


@query("A17_error_by_target", f"SELECT * FROM (SELECT {_bucket_sql(FIFTHS, True).format('target')} AS bucket, {_ERRORS} FROM ({LABELS}) GROUP BY 1) WHERE bucket IS NOT NULL")
def error_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_by_bucket(rows(spark, sf_dir), "pred", "target", "target", FIFTHS)


@query("A24_error_tables", f"SELECT * FROM (SELECT pair_type, {_bucket_sql(HALF_OPEN, False).format('target')} AS bucket, {_ERRORS} FROM ({LABELS}) GROUP BY 1, 2) WHERE bucket IS NOT NULL AND n >= 3")
def error_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_by_bucket(rows(spark, sf_dir), "pred", "target", "target", HALF_OPEN, ("pair_type",), closed_end=False, least=3)


@query("A18_model_table", " UNION ALL ".join(f"SELECT '{name}' AS model, {_METRICS.format('')} FROM (SELECT {expr} AS pred, target FROM ({LABELS}))" for name, expr in (("model", "pred"), ("baseline", "gw_raw"), ("flat", "0.5::DOUBLE"))))
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rows(spark, sf_dir).select("target", F.expr("stack(3, 'model', pred, 'baseline', gw_raw, 'flat', 0.5D) AS (model, pred)"))
    return metrics.regression(own, "pred", "target", ("model",), spearman=False)


@query("A19_collapse_warning", f"SELECT pair_type, stddev_pop(pred) < 0.1 * stddev_pop(target) AS collapsed FROM ({LABELS}) GROUP BY 1")
def collapse_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).groupBy("pair_type").agg((F.stddev_pop("pred") < 0.1 * F.stddev_pop("target")).alias("collapsed"))


@query("A20_masked_mse", f"SELECT pair_type, round(sum(CASE WHEN gw_raw > 0.05 THEN (pred - target) ** 2 ELSE 0 END) / greatest(sum(CASE WHEN gw_raw > 0.05 THEN 1 ELSE 0 END), 1), 6) AS masked FROM ({LABELS}) GROUP BY 1")
def masked_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("pred") - F.col("target")
    return rows(spark, sf_dir).groupBy("pair_type").agg(F.round(metrics.masked_mean(error * error, F.col("gw_raw") > 0.05), 6).alias("masked"))


@query("A21_class_balanced", f"SELECT round(avg(m), 6) AS balanced FROM (SELECT pair_type, avg((pred - target) ** 2) AS m FROM ({LABELS}) GROUP BY 1)")
def class_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("pred") - F.col("target")
    return rows(spark, sf_dir).groupBy("pair_type").agg(F.avg(error * error).alias("m")).agg(F.round(F.avg("m"), 6).alias("balanced"))


@query("A22_agreement", f"SELECT pair_type, round(avg(target), 6) AS mean, round(median(target), 6) AS median, round(quantile_cont(target, 0.1), 6) AS p10, round(avg(CASE WHEN target < 0.5 THEN 1 ELSE 0 END), 6) AS below_half FROM ({LABELS}) GROUP BY 1")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.agreement(rows(spark, sf_dir), "target", ("pair_type",))


@query("A23_confusion", f"SELECT count(*)::BIGINT AS n, round(sum((p = t)::INT) / greatest(count(*), 1), 6) AS accuracy, round(sum((p AND t)::INT) / greatest(sum(p::INT), 1), 6) AS precision, round(sum((p AND t)::INT) / greatest(sum(t::INT), 1), 6) AS recall FROM (SELECT pred >= 0.5 AS p, target >= 0.5 AS t FROM ({LABELS}))")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(rows(spark, sf_dir), "pred", "target")


@query("A25_noise_stats", f"SELECT count(*)::BIGINT AS n, round(avg(pred - target), 6) AS bias, round(var_pop(pred - target), 6) AS variance, round(var_pop(pred - gw_raw) / 2, 6) AS sigma2, round(1 - var_pop(pred - gw_raw) / 2 / nullif(var_pop(target), 0), 6) AS ceiling FROM ({LABELS})")
def noise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.noise_stats(rows(spark, sf_dir), "target", "pred", "gw_raw")


_NOISE = "count(*)::BIGINT AS n, round(avg(pred - target), 6) AS bias, round(1 - var_pop(pred - gw_raw) / 2 / nullif(var_pop(target), 0), 6) AS ceiling"


@query("R23_noise_table", f"SELECT * FROM (SELECT 'all' AS kind, {_NOISE} FROM ({LABELS}) UNION ALL SELECT pair_type, {_NOISE} FROM ({LABELS}) GROUP BY 1) WHERE n >= 3")
def noise_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rows(spark, sf_dir).withColumn("kind", F.explode(F.array(F.lit("all"), "pair_type")))
    ceiling = 1 - F.try_divide(F.var_pop(F.col("pred") - F.col("gw_raw")) / 2, metrics.variance(F.col("target")))
    return own.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("pred") - F.col("target")), 6).alias("bias"), F.round(ceiling, 6).alias("ceiling")).where("n >= 3")


@query("A27_timing_summary", "SELECT event_type, count(*)::BIGINT AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(list_sort(list(value))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1], 6) AS p90, round(sum(value), 4) AS total FROM events GROUP BY 1")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.timing_summary(table(spark, sf_dir, "events"), "value", ("event_type",))


@query("W15_calibration", f"""WITH l AS ({LABELS}), e AS (SELECT {', '.join(f'quantile_cont(pred, {k / 15!r}::DOUBLE) AS e{k}' for k in range(16))} FROM l)
SELECT bin, count(*)::BIGINT AS n, round(avg(pred), 6) AS pred_mean, round(avg(target), 6) AS target_mean FROM (SELECT pred, target, least(greatest({' + '.join(f'(e{k} <= pred)::INT' for k in range(16))} - 1, 0), 14) AS bin FROM l, e) GROUP BY 1""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration(rows(spark, sf_dir), "pred", "target")


@query("A40_error_histogram", f"SELECT bin, round(100.0 * count(*) / max(total), 6) AS percent FROM (SELECT least(CAST(floor((pred - target + 0.5) / (1.0 / 60)) AS BIGINT), 59) AS bin, pred - target AS e, count(*) OVER () AS total FROM ({LABELS})) WHERE e >= -0.5 AND e <= 0.5 GROUP BY 1")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rows(spark, sf_dir).select((F.col("pred") - F.col("target")).alias("e"))
    total = own.count()
    bins = own.where("e between -0.5 and 0.5").select(F.least(F.floor((F.col("e") + 0.5) / F.lit(1.0 / 60)), F.lit(59)).cast("bigint").alias("bin"))
    return bins.groupBy("bin").agg(F.round(100.0 * F.count(F.lit(1)) / F.lit(float(total)), 6).alias("percent"))


@query("A41_box_statistics", f"SELECT b.bucket, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(e) FILTER (WHERE e >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(e) FILTER (WHERE e <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM (SELECT {_bucket_sql(HALF_OPEN, False).format('target')} AS bucket, pred - target AS e FROM ({LABELS}) WHERE pair_type = 'A') a JOIN (SELECT bucket, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS q2, quantile_cont(e, 0.75) AS q3 FROM (SELECT {_bucket_sql(HALF_OPEN, False).format('target')} AS bucket, pred - target AS e FROM ({LABELS}) WHERE pair_type = 'A') GROUP BY 1) b ON a.bucket = b.bucket GROUP BY 1, q1, q2, q3")
def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rows(spark, sf_dir).where("pair_type = 'A'").select(metrics.bucket(F.col("target"), HALF_OPEN, False).alias("bucket"), (F.col("pred") - F.col("target")).alias("e"))
    return metrics.box_statistics(own.where("bucket is not null"), "e", ("bucket",))



@query("N29_loss_balancer", f"SELECT pair_type, round(avg((pred - target) ** 2) + 0.2 * avg(abs(pred - target)), 6) AS fixed, round(1.0 * (exp(-1.0) * avg((pred - target) ** 2) + 1.0) + 0.2 * avg(abs(pred - target)), 6) AS balanced FROM ({LABELS}) GROUP BY 1")
def loss_balancer(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("pred") - F.col("target")
    terms = {"fgw": F.avg(error * error), "tm": F.avg(F.abs(error)), "unused": F.avg("gw_raw")}
    weights = {"fgw": 1.0, "tm": 0.2, "unused": 0.0}
    return rows(spark, sf_dir).groupBy("pair_type").agg(F.round(metrics.loss_total(terms, weights), 6).alias("fixed"), F.round(metrics.loss_total(terms, weights, {"fgw": 1.0}), 6).alias("balanced"))


@query("F5_similarity", f"SELECT tm_data_row, pos, round(exp(-gw_raw / 0.05), 6) AS structure, round(exp(-fgw_raw / 0.1), 6) AS composite FROM ({LABELS})")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {kind: F.round(exprs.target(kind, F.col("gw_raw"), F.col("fgw_raw"), F.col("target")), 6).alias(kind) for kind in ("structure", "composite")}
    return rows(spark, sf_dir).select("tm_data_row", "pos", *own.values())


@query("X4_tm_d0", "SELECT p_partkey, round(CASE WHEN p_size * 4 <= 21 THEN 0.5 ELSE greatest(0.5, 1.24 * pow(greatest(p_size * 4 - 15, 0), 1.0 / 3) - 1.8) END, 6) AS d0 FROM part")
def tm_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(exprs.tm_d0(F.col("p_size") * 4), 6).alias("d0"))


@query("X5_tm_term", "SELECT l_orderkey, l_linenumber, round(1 / (1 + pow(l_quantity / 4.5, 2)), 6) AS tm FROM lineitem")
def tm_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(exprs.tm_term(F.col("l_quantity"), F.lit(4.5)), 6).alias("tm"))


@query("W13_group_window", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, dense_rank() OVER (ORDER BY l_orderkey) AS g FROM lineitem WHERE l_orderkey % 10 >= 2) WHERE g > 20 AND g <= 120")
def group_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups by the order of their keys: skip 20, take 100. Keys are ranked, not rows."""
    kept = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 >= 2")
    return sampling.group_range(kept, "l_orderkey", 20, 100).select("l_orderkey", "l_linenumber", "l_partkey")


@query("W14_group_buffers", "SELECT l_orderkey, CAST(floor((dense_rank() OVER (ORDER BY l_orderkey) - 1) / 256) AS BIGINT) AS buffer FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def group_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.buffers(table(spark, sf_dir, "lineitem"), "l_orderkey", 256)


#: Operators over whole tables, each with the SQL that must give the same rows.
TABLES: dict[str, tuple[str, Callable[[Callable[[str], DataFrame]], DataFrame]]] = {
    "A26_reproduction": (
        f"SELECT round(max(abs(pred - target)), 6) AS most, round(avg(CAST(CASE WHEN abs(pred - target) > 0.0001 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS share FROM ({LABELS})",
        lambda t: metrics.reproduction(labels(t), "pred", "target"),
    ),
    "A33_identity": (
        "SELECT item_id, round(CASE WHEN both_ = 0 THEN 0 ELSE CAST(same AS DOUBLE) / both_ END, 6) AS ident FROM (SELECT item_id, CAST(sum(CASE WHEN a <> '-' AND b <> '-' THEN 1 ELSE 0 END) AS BIGINT) AS both_, CAST(sum(CASE WHEN a <> '-' AND a = b THEN 1 ELSE 0 END) AS BIGINT) AS same FROM (SELECT item_id, translate(substring(text, k, 1), 'aeiou', '-----') AS a, translate(substring(text, k, 1), 'rst', '---') AS b FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS k FROM benchmark)) GROUP BY item_id)",
        lambda t: alignment.identity(t("benchmark").select("item_id", F.translate("text", "aeiou", "-----").alias("a"), F.translate("text", "rst", "---").alias("b")), "item_id", "a", "b").select("item_id", F.round("identity", 6).alias("ident")),
    ),
    "A39_weighted_loss": (
        f"SELECT round(sum(m * n) / sum(n), 6) AS loss FROM (SELECT tm_data_row, avg((pred - target) * (pred - target)) AS m, CAST(count(*) AS DOUBLE) AS n FROM ({LABELS}) GROUP BY tm_data_row)",
        lambda t: metrics.weighted_loss(labels(t).groupBy("tm_data_row").agg(F.avg((F.col("pred") - F.col("target")) * (F.col("pred") - F.col("target"))).alias("m"), F.count(F.lit(1)).alias("n")), "m", "n"),
    ),
    "N28_distillation": (
        f"SELECT round(sum(CASE WHEN gw_raw > 0.02 THEN 1 - least(target, 1.0) ELSE 0.0 END) / greatest(sum(CASE WHEN gw_raw > 0.02 THEN 1 ELSE 0 END), 1), 6) AS loss FROM ({LABELS})",
        lambda t: labels(t).agg(F.round(metrics.distillation(F.least("target", F.lit(1.0)), F.col("gw_raw") > 0.02), 6).alias("loss")),
    ),
    "N30_loss_composition": (
        f"SELECT pair_type, round(0.25 * avg(abs(pred - target)) + 1.0 * avg((pred - target) * (pred - target)) + 0.5 * avg((pred - gw_raw) * (pred - gw_raw)), 6) AS loss FROM ({LABELS}) GROUP BY pair_type",
        lambda t: labels(t).groupBy("pair_type").agg(F.round(metrics.loss_total({"tm": F.avg(F.abs(F.col("pred") - F.col("target"))), "fgw": F.avg((F.col("pred") - F.col("target")) * (F.col("pred") - F.col("target"))), "distill": F.avg((F.col("pred") - F.col("gw_raw")) * (F.col("pred") - F.col("gw_raw")))}, {"tm": 0.25, "fgw": 1.0, "distill": 0.5}), 6).alias("loss")),
    ),
    "R18_validation": (
        f"SELECT coalesce(pair_type, 'overall') AS kind, CAST(count(*) AS BIGINT) AS n, round(avg((pred - target) * (pred - target)), 6) AS mse FROM ({LABELS}) GROUP BY GROUPING SETS ((pair_type), ()) HAVING count(*) > 1",
        lambda t: metrics.validation(labels(t), "pred", "target", "pair_type"),
    ),
    "R19_best_epoch": (
        "SELECT event_id, value, value < coalesce(min(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300) AS best FROM events",
        lambda t: metrics.best_so_far(t("events").select("event_id", "value"), "event_id", "value"),
    ),
    "R17_masked_flatten": (
        f"SELECT tm_data_row, pos, pred, target FROM ({LABELS}) WHERE fgw_raw > 0.01 AND pred IS NOT NULL",
        lambda t: labels(t).where("fgw_raw > 0.01 and pred is not null").select("tm_data_row", "pos", "pred", "target"),
    ),
    "R25_baseline": (
        "SELECT label, round(least(greatest(avg(CAST(vec_id % 7 AS DOUBLE)) / 7, 0.0), 1.0), 6) AS pred FROM embeddings GROUP BY label",
        lambda t: t("embeddings").groupBy("label").agg(F.round(exprs.unit_clip(F.avg((F.col("vec_id") % 7).cast("double")) / 7), 6).alias("pred")),
    ),
    "R28_report_block": (
        f"SELECT 'n' AS name, CAST(count(*) AS DOUBLE) AS value FROM ({LABELS}) UNION ALL SELECT 'mse', round(avg((pred - target) * (pred - target)), 6) FROM ({LABELS}) UNION ALL SELECT 'bias', round(avg(pred - target), 6) FROM ({LABELS})",
        lambda t: metrics.report_block(labels(t), "pred", "target"),
    ),
    "W1_keep_first": (
        "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1",
        lambda t: sampling.keep_first(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey"),
    ),
    "W5_key_runs": (
        "SELECT user_id, CAST(sum(starts) AS BIGINT) AS runs FROM (SELECT user_id, CASE WHEN user_id = lag(user_id) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS starts FROM events) GROUP BY user_id",
        lambda t: sampling.key_runs(t("events"), "user_id", "event_id"),
    ),
    "W8_stride": (
        "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE (k - 1) % 32 = 0",
        lambda t: sampling.every(t("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 32, keys=("l_returnflag",)).select("l_orderkey", "l_linenumber", "l_partkey"),
    ),
    "W10_average_rank": (
        "SELECT event_id, CAST(rank() OVER (ORDER BY user_id) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) - 1) / 2 AS average_rank FROM events",
        lambda t: metrics.tied_rank(t("events").select("event_id", "user_id"), "user_id", "average_rank").select("event_id", "average_rank"),
    ),
    "W11_z_score": (
        "SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / (stddev_pop(value) OVER (PARTITION BY event_type) + 1e-12), 5) AS z FROM events",
        lambda t: audits.z_scores(t("events"), "value", "event_type", "z").select("event_id", F.round("z", 5).alias("z")),
    ),
    "W12_csr_offsets": (
        "SELECT l_orderkey, CAST(sum(n) OVER (ORDER BY l_orderkey) - n AS BIGINT) AS first FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)",
        lambda t: sampling.offsets(t("lineitem"), "l_orderkey"),
    ),
    "W16_first_groups": (
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) AS r FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 10 >= 2)) WHERE r <= 50)",
        lambda t: sampling.group_range(t("lineitem").where("l_orderkey % 10 >= 2"), "l_orderkey", 0, 50).select("l_orderkey", "l_linenumber"),
    ),
    "T5_best_config": (
        "SELECT p_brand, sf, fam FROM (SELECT p_brand, sf, fam, row_number() OVER (ORDER BY sf DESC, fam DESC, p_brand) AS k FROM (SELECT p_brand, round(avg(p_retailprice), 6) AS sf, round(avg(CAST(p_size AS DOUBLE)), 6) AS fam FROM part GROUP BY p_brand)) WHERE k <= 5",
        lambda t: audits.best_configs(t("part"), "p_brand", 5, sf="p_retailprice", fam="p_size"),
    ),
    "T6_length_blocks": (
        "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY n_chars, doc_id) - 1) / 64) AS BIGINT) AS block FROM documents",
        lambda t: sampling.blocks(t("documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 64).select("doc_id", "block"),
    ),
    "X25_larger_score": (
        "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS tm_max FROM lineitem",
        lambda t: t("lineitem").select("l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("tm_max")),
    ),
    "X11_log_length": (
        "SELECT doc_id, round(ln(1 + CAST(n_chars AS DOUBLE)) / ln(CAST(1001 AS DOUBLE)), 6) AS code FROM documents",
        lambda t: t("documents").select("doc_id", F.round(exprs.log_length(F.col("n_chars")), 6).alias("code")),
    ),
    "X10_calibrated": (
        "SELECT l_orderkey, l_linenumber, round(0.5 * l_discount + 0.5, 6) AS score FROM lineitem",
        lambda t: t("lineitem").select("l_orderkey", "l_linenumber", F.round(exprs.calibrated(F.col("l_discount")), 6).alias("score")),
    ),
    "X13_softmax": (
        "SELECT event_id, round(exp((value - m) / 10) / sum(exp((value - m) / 10)) OVER (PARTITION BY user_id), 6) AS share FROM (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id) AS m FROM events)",
        lambda t: audits.softmax(t("events").select("event_id", "user_id", "value"), "value", 10.0, "user_id", "share").select("event_id", F.round("share", 6).alias("share")),
    ),
}
for _name, (_sql, _make) in TABLES.items():
    over_tables(_name, _sql, _make)
