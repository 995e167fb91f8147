"""Scans, filters, joins, set operations and audits over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import audits, ids, joins, metrics, sampling
from ..registry import over_tables, query, table
from ..sources import parquet, sinks, text
from ..sources.shared import folder

#: The pair table: a row number and two ids.
PAIRS = "SELECT o_orderkey AS row_id, CAST(o_custkey AS STRING) AS id1, o_orderpriority AS id2 FROM orders"
#: Rows of pairs, some of them repeated.
LABELS = "SELECT l_orderkey AS tm_data_row, CAST(l_linenumber AS BIGINT) AS pos, l_discount AS gw_raw, l_tax AS fgw_raw, l_returnflag AS pair_type, l_extendedprice / 100000 AS pred, l_quantity / 50 AS target, l_partkey, l_suppkey FROM lineitem"


@query("S1_window_scan", f"SELECT * FROM ({PAIRS}) WHERE row_id >= 100 AND row_id < 5000")
def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by their place in the file; the window reaches the scan, which skips row groups outside it."""
    rows = parquet.window_scan(spark, f"{sf_dir}/orders.parquet", ["o_custkey", "o_orderpriority"], 100, 5000)
    return rows.select("row_id", F.col("o_custkey").cast("string").alias("id1"), F.col("o_orderpriority").alias("id2"))


@query("S3_pair_iterator", f"SELECT row_id, trim(id1) AS id1, trim(id2) AS id2 FROM ({PAIRS}) WHERE row_id < 8000 AND row_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def pair_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet.window_scan(spark, f"{sf_dir}/orders.parquet", ["o_custkey", "o_orderpriority"], 0, 8000)
    done = table(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("row_id"))
    kept = parquet.resume(rows, done, "row_id")
    return kept.select("row_id", F.trim(F.col("o_custkey").cast("string")).alias("id1"), F.trim("o_orderpriority").alias("id2"))


@query("X1_stable_bucket", "SELECT c_name, CAST(concat('0x', substr(md5(c_name), 1, 8)) AS BIGINT) % 100 AS bucket FROM customer")
def stable_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_name", exprs.stable_bucket(F.col("c_name")).alias("bucket"))


_BUCKET = "CAST(concat('0x', substr(md5({0}), 1, 8)) AS BIGINT) % 100"
_SPLIT = "CASE WHEN {0} < 10 THEN 'test' WHEN {0} < 20 THEN 'val' ELSE 'train' END"


@query("X2_split_of", f"SELECT c_name, {_SPLIT.format(_BUCKET.format('c_name'))} AS split FROM customer")
def split_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_name", exprs.split_of(exprs.stable_bucket(F.col("c_name"))).alias("split"))


@query("X3_pair_split", f"SELECT o_orderkey, CASE WHEN a = b THEN a ELSE 'discard' END AS split FROM (SELECT o_orderkey, {_SPLIT.format(_BUCKET.format('CAST(o_custkey AS VARCHAR)'))} AS a, {_SPLIT.format(_BUCKET.format('o_orderpriority'))} AS b FROM orders)")
def pair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", exprs.pair_split(F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("split"))


@query("J3_cluster_split", f"SELECT c_name, key_, {_SPLIT.format(_BUCKET.format('key_'))} AS split FROM (SELECT c_name, coalesce(n_name, c_name) AS key_ FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey)")
def cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a cluster share the split of its representative; others go by themselves."""
    clusters = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    keyed = table(spark, sf_dir, "customer").join(clusters, "c_nationkey", "left").select("c_name", F.coalesce("n_name", "c_name").alias("key_"))
    return keyed.withColumn("split", exprs.split_of(exprs.stable_bucket(F.col("key_"))))


def pairs(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("string").alias("id1"), F.col("o_orderpriority").alias("id2"))


def labels(t: Callable[[str], DataFrame]) -> DataFrame:
    own = [F.col("l_orderkey").alias("tm_data_row"), F.col("l_linenumber").cast("bigint").alias("pos"), F.col("l_discount").alias("gw_raw"), F.col("l_tax").alias("fgw_raw"), F.col("l_returnflag").alias("pair_type")]
    return t("lineitem").select(*own, (F.col("l_extendedprice") / 100000).alias("pred"), (F.col("l_quantity") / 50).alias("target"), "l_partkey", "l_suppkey")


def csv_projection(t: Callable[[str], DataFrame]) -> DataFrame:
    """Four columns of a CSV table that has nine."""
    spark = t("lineitem").sparkSession
    path = f"{folder(spark)}/labels.csv"
    sinks.write_table(labels(t), path)
    return text.csv_columns(spark, path, labels(t).schema, ["tm_data_row", "pos", "gw_raw", "pair_type"])


#: Operators over whole tables, each with the SQL that must give the same rows.
TABLES: dict[str, tuple[str, Callable[[Callable[[str], DataFrame]], DataFrame]]] = {
    "S4_csv_projection": (
        f"SELECT tm_data_row, pos, gw_raw, pair_type FROM ({LABELS})",
        lambda t: csv_projection(t),
    ),
    "S5_input_rows": (
        f"SELECT tm_data_row, pos, gw_raw FROM (SELECT *, row_number() OVER (PARTITION BY tm_data_row, pos ORDER BY l_partkey, l_suppkey, gw_raw, fgw_raw, pred, target) AS k FROM ({LABELS})) WHERE k = 1 AND tm_data_row >= 10 AND tm_data_row < 900 AND tm_data_row % 7 <> 0",
        lambda t: sampling.keep_first(labels(t), ["tm_data_row", "pos"], ["l_partkey", "l_suppkey", "gw_raw", "fgw_raw", "pred", "target"]).where("tm_data_row >= 10 and tm_data_row < 900 and tm_data_row % 7 <> 0").select("tm_data_row", "pos", "gw_raw"),
    ),
    "S6_distinct_ids": (
        f"SELECT DISTINCT id FROM (SELECT id1 AS id FROM ({PAIRS}) WHERE row_id < 3000 UNION ALL SELECT id2 FROM ({PAIRS}) WHERE row_id < 3000) WHERE trim(id) <> '' AND lower(trim(id)) <> 'nan'",
        lambda t: ids.distinct_ids(pairs(t).where("row_id < 3000"), ["id1", "id2"], trimmed=False),
    ),
    "S6_scan_extent": (
        f"SELECT CAST(count(*) AS BIGINT) AS rows_scanned, CAST(max(row_id) AS BIGINT) AS last_row FROM ({PAIRS}) WHERE row_id < 3000",
        lambda t: ids.scan_extent(pairs(t).where("row_id < 3000"), "row_id"),
    ),
    "S7_first_seen_ids": (
        f"SELECT id, CAST(min(seen) AS BIGINT) AS first_seen FROM (SELECT id1 AS id, row_id * 2 AS seen FROM ({PAIRS}) UNION ALL SELECT id2, row_id * 2 + 1 FROM ({PAIRS})) GROUP BY id",
        lambda t: ids.first_seen(pairs(t), "row_id", ["id1", "id2"]),
    ),
    "S8_ids_of_table": (
        f"SELECT trim(id1) AS id FROM ({PAIRS}) WHERE trim(id1) <> '' UNION SELECT trim(id2) FROM ({PAIRS}) WHERE trim(id2) <> ''",
        lambda t: ids.distinct_ids(pairs(t), ["id1", "id2"]),
    ),
    "S19_cluster_map": (
        "SELECT member, rep FROM (SELECT c_name AS member, n_name AS rep, row_number() OVER (PARTITION BY c_name ORDER BY n_nationkey DESC) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE k = 1",
        lambda t: ids.cluster_map(t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "n_name", "n_nationkey"),
    ),
    "S20_closest_overlap": (
        "SELECT query, hit, ident FROM (SELECT l_orderkey AS query, l_partkey AS hit, l_discount AS ident, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem WHERE l_quantity / 50 >= 0.5) WHERE k = 1",
        lambda t: sampling.keep_first(t("lineitem").where(F.col("l_quantity") / 50 >= 0.5), ["l_orderkey"], [-F.col("l_discount"), "l_linenumber", "l_partkey", "l_suppkey"]).select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("hit"), F.col("l_discount").alias("ident")),
    ),
    "S24_pack_lookup": (
        "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey IN (3, 5, 8, 13, 21, 34, 55, 89, 144)",
        lambda t: ids.lookup(t("part").select("p_partkey", "p_name", "p_size"), "p_partkey", [3, 5, 8, 13, 21, 34, 55, 89, 144]),
    ),
    "S25_aligned_lookup": (
        f"SELECT o.o_orderkey, l.pos, l.gw_raw FROM orders o JOIN ({LABELS}) l ON o.o_orderkey = l.tm_data_row WHERE o.o_orderstatus = 'F'",
        lambda t: t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey")).join(labels(t).select(F.col("tm_data_row").alias("o_orderkey"), "pos", "gw_raw"), "o_orderkey"),
    ),
    "S26_named_predictions": (
        f"SELECT 'model_a' AS model, tm_data_row, pos, pred FROM ({LABELS}) WHERE pair_type = 'A' UNION ALL SELECT 'model_b', tm_data_row, pos, target FROM ({LABELS}) WHERE pair_type = 'R'",
        lambda t: ids.named({"model_a": labels(t).where("pair_type = 'A'").select("tm_data_row", "pos", "pred"), "model_b": labels(t).where("pair_type = 'R'").select("tm_data_row", "pos", F.col("target").alias("pred"))}),
    ),
    "F1_valid_ids": (
        "SELECT doc_id FROM documents WHERE trim(lang) <> '' AND lower(trim(lang)) <> 'nan'",
        lambda t: t("documents").where(exprs.valid_id(F.col("lang"))).select("doc_id"),
    ),
    "F2_length_guard": (
        "SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'too long' ELSE 'ok' END AS status FROM documents",
        lambda t: t("documents").select("doc_id", ids.status((F.col("n_chars") > 1000, "too long"), otherwise="ok").alias("status")),
    ),
    "F4_unit_clip": (
        f"SELECT tm_data_row, pos, least(greatest(target * 1.5 - 0.2, 0.0), 1.0) AS clipped FROM ({LABELS})",
        lambda t: labels(t).select("tm_data_row", "pos", exprs.unit_clip(F.col("target") * 1.5 - 0.2).alias("clipped")),
    ),
    "F12_part_of": (
        "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) WHERE (k - 1) % 4 = 2",
        lambda t: sampling.every(t("customer").select("c_custkey"), ["c_custkey"], 4, 2),
    ),
    "F16_truncated": (
        "SELECT doc_id, CAST(length(substring(text, 1, 1000)) AS BIGINT) AS n, length(text) > 1000 AS truncated FROM documents",
        lambda t: t("documents").select("doc_id", F.length(F.substring("text", 1, 1000)).cast("bigint").alias("n"), (F.length("text") > 1000).alias("truncated")),
    ),
    "J1_resume": (
        f"SELECT p.row_id, p.id1 FROM ({PAIRS}) p WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = p.row_id AND e.event_id % 2 = 0)",
        lambda t: parquet.resume(pairs(t).select("row_id", "id1"), t("events").where("event_id % 2 = 0").select(F.col("event_id").alias("row_id")), "row_id"),
    ),
    "J2_pair_sides": (
        "SELECT o.o_orderkey, a.c_name AS name1, b.c_name AS name2 FROM orders o JOIN customer a ON o.o_custkey = a.c_custkey JOIN customer b ON o.o_custkey % 100 + 1 = b.c_custkey",
        lambda t: joins.both_sides(t("orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_custkey") % 100 + 1).alias("b")), t("customer").withColumnRenamed("c_name", "name"), "a", "b", "c_custkey", ["name"]).select("o_orderkey", "name1", "name2"),
    ),
    "J4_coverage": (
        "SELECT 'present' AS kind, CAST(count(*) AS BIGINT) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) UNION ALL SELECT 'missing', CAST(count(*) AS BIGINT) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) UNION ALL SELECT 'extra', CAST(count(DISTINCT o.o_custkey) AS BIGINT) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE o.o_custkey = c.c_custkey)",
        lambda t: joins.coverage(t("customer").select(F.col("c_custkey").alias("id")), t("orders").select(F.col("o_custkey").alias("id")), "id"),
    ),
    "J5_first_lookup": (
        "SELECT o.o_orderkey, x.l_discount AS ident FROM orders o LEFT JOIN (SELECT l_orderkey, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) x ON o.o_orderkey = x.l_orderkey AND x.k = 1",
        lambda t: joins.first_match(t("orders").select("o_orderkey"), t("lineitem"), "o_orderkey", "l_orderkey", "l_discount", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).withColumnRenamed("l_discount", "ident"),
    ),
    "J6_two_levels": (
        "SELECT l.l_orderkey, l.l_linenumber, p.p_brand, s.s_nationkey FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey",
        lambda t: t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "left").select("l_orderkey", "l_linenumber", "p_brand", "s_nationkey"),
    ),
    "J7_reindex_fill": (
        "SELECT c.c_custkey, coalesce(x.n, 0) AS n FROM customer c LEFT JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) x ON c.c_custkey = x.o_custkey",
        lambda t: joins.reindexed(t("customer"), audits.histogram(t("orders").where("o_orderstatus = 'O'"), "o_custkey", "c_custkey"), "c_custkey", "n"),
    ),
    "J9_cell_classes": (
        "SELECT a.i, b.j, CASE WHEN b.j = a.partner THEN 'aligned' WHEN abs(b.j - a.partner) <= 32 THEN 'near' ELSE 'far' END AS cell FROM (SELECT p_size AS i, max(p_size * 7 % 50) AS partner FROM part GROUP BY 1) a CROSS JOIN (SELECT DISTINCT p_size AS j FROM part) b",
        lambda t: joins.by_distance(t("part").groupBy(F.col("p_size").alias("i")).agg(F.max(F.col("p_size") * 7 % 50).alias("partner")), t("part").select(F.col("p_size").alias("j")).distinct(), "i", "j", "partner", 32),
    ),
    "J10_node_pairs": (
        "SELECT a.label, a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id",
        lambda t: joins.node_pairs(t("embeddings"), "label", "vec_id"),
    ),
    "J11_keep_earlier": (
        "SELECT a.p_partkey, coalesce(b.p_brand, a.p_type) AS value FROM part a LEFT JOIN (SELECT * FROM part WHERE p_size < 25) b ON a.p_partkey = b.p_partkey",
        lambda t: joins.keep_earlier(t("part").select("p_partkey", "p_type"), t("part").where("p_size < 25"), "p_partkey", "p_brand", "p_type").select("p_partkey", "value"),
    ),
    "J12_full_methods": (
        "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS method_a, coalesce(b.n, 0) AS method_b FROM (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) a FULL OUTER JOIN (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) b ON a.k = b.k",
        lambda t: joins.by_method({name: audits.histogram(t("orders").where(F.col("o_orderstatus") == status), "o_custkey", "k") for name, status in (("method_a", "O"), ("method_b", "F"))}, "k", "n"),
    ),
    "J13_length_fallback": (
        "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN d.lang ELSE 'fallback' END AS source_used FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id",
        lambda t: joins.with_fallback(t("documents").select("doc_id", "lang"), t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", F.col("quality") == 1, F.col("lang"), F.lit("fallback")).select("doc_id", F.col("value").alias("source_used")),
    ),
    "J14_not_downloaded": (
        "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_orderkey < 100)",
        lambda t: ids.missing(t("supplier"), t("lineitem").where("l_orderkey < 100").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey"),
    ),
    "U1_id_union": (
        "SELECT CAST(o_custkey AS STRING) AS id FROM orders UNION SELECT o_orderpriority FROM orders",
        lambda t: ids.union_ids(t("orders").select(F.col("o_custkey").cast("string")), t("orders").select("o_orderpriority")),
    ),
    "U2_difference": (
        "SELECT CAST(c_custkey AS BIGINT) AS id FROM customer EXCEPT SELECT CAST(o_custkey AS BIGINT) FROM orders WHERE o_orderkey < 400",
        lambda t: ids.missing(t("customer").select(F.col("c_custkey").alias("id")), t("orders").where("o_orderkey < 400").select(F.col("o_custkey").alias("id")), "id"),
    ),
    "U2_intersection": (
        "SELECT CAST(c_custkey AS BIGINT) AS id FROM customer INTERSECT SELECT CAST(o_custkey AS BIGINT) FROM orders",
        lambda t: ids.present_in_all("id", t("customer").select(F.col("c_custkey").alias("id")), t("orders").select(F.col("o_custkey").alias("id"))),
    ),
    "U4_concat": (
        f"SELECT tm_data_row, pos, pred FROM ({LABELS}) WHERE tm_data_row < 500 UNION ALL SELECT tm_data_row, pos, pred FROM ({LABELS}) WHERE tm_data_row >= 500",
        lambda t: ids.concat([labels(t).where(f"tm_data_row {which} 500").select("tm_data_row", "pos", "pred") for which in ("<", ">=")]),
    ),
    "K8_shard_merge": (
        "SELECT event_id, value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, value FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, value FROM events WHERE event_id % 3 = 2",
        lambda t: ids.concat([t("events").where(f"event_id % 3 = {k}").select("event_id", "value") for k in range(3)]),
    ),
    "A1_failure_histogram": (
        "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type",
        lambda t: audits.histogram(t("events"), "event_type", "event_type"),
    ),
    "A2_value_counts": (
        "SELECT head, n FROM (SELECT head, n, row_number() OVER (ORDER BY n DESC, head) AS k FROM (SELECT substring(text, 1, 60) AS head, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY substring(text, 1, 60))) WHERE k <= 5",
        lambda t: audits.top_values(t("documents"), F.substring("text", 1, 60), "head", 5),
    ),
    "A3_distinct_counts": (
        "SELECT CAST(count(DISTINCT l_orderkey) AS BIGINT) AS pairs, CAST(count(DISTINCT l_partkey) AS BIGINT) AS proteins, CAST(count(*) AS BIGINT) AS n FROM lineitem",
        lambda t: audits.distinct_counts(t("lineitem"), pairs="l_orderkey", proteins="l_partkey"),
    ),
    "A4_group_sizes": (
        "SELECT CAST(min(n) AS BIGINT) AS least, median(n) AS middle, CAST(max(n) AS BIGINT) AS most, round(avg(n), 6) AS mean, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singles FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)",
        lambda t: audits.group_sizes(t("lineitem"), "l_orderkey"),
    ),
    "A5_duplicates_gaps": (
        "SELECT CAST(count(*) - count(DISTINCT l_orderkey) AS BIGINT) AS duplicates, CAST(max(l_orderkey) - min(l_orderkey) + 1 AS BIGINT) AS span, CAST(max(l_orderkey) - min(l_orderkey) + 1 - count(DISTINCT l_orderkey) AS BIGINT) AS gaps FROM lineitem",
        lambda t: audits.duplicates_and_gaps(t("lineitem"), "l_orderkey"),
    ),
    "A6_ranges": (
        "SELECT min(value) AS low, max(value) AS high, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN try_cast(event_type AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS not_numbers FROM events",
        lambda t: audits.ranges(t("events"), "value", "event_type"),
    ),
    "A7_length_mismatches": (
        "SELECT CAST(sum(CASE WHEN length(text) <> n_chars THEN 1 ELSE 0 END) AS BIGINT) AS mismatched, CAST(sum(CASE WHEN text = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_texts, CAST(sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_texts FROM documents",
        lambda t: audits.text_lengths(t("documents"), "text", "n_chars"),
    ),
    "A9_split_shares": (
        "SELECT split, n, round(100 * CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share FROM (SELECT CASE WHEN event_id % 100 < 10 THEN 'test' WHEN event_id % 100 < 20 THEN 'val' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1)",
        lambda t: audits.shares(t("events"), exprs.split_of(F.col("event_id") % 100), "split"),
    ),
    "A29_cut_shares": (
        "SELECT round(avg(CAST(CASE WHEN l_quantity < 15 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS below_30, round(avg(CAST(CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS below_50, round(avg(CAST(CASE WHEN l_quantity < 45 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS below_90 FROM lineitem",
        lambda t: audits.cut_shares(t("lineitem"), "l_quantity", below_30=15, below_50=25, below_90=45),
    ),
    "A30_cluster_summary": (
        "SELECT CAST(count(*) AS BIGINT) AS members, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS representatives, round(CAST(count(*) AS DOUBLE) / count(DISTINCT c_nationkey), 6) AS mean_size FROM customer",
        lambda t: audits.cluster_summary(t("customer"), "c_nationkey"),
    ),
    "A31_first_non_empty": (
        "SELECT o_custkey, value FROM (SELECT o_custkey, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'P') WHERE k = 1",
        lambda t: ids.first_value(t("orders").withColumn("value", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))), "o_custkey", "value", ["o_orderkey"], non_empty=True),
    ),
    "A32_first_even_empty": (
        "SELECT o_custkey, value FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1",
        lambda t: ids.first_value(t("orders").withColumn("value", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))), "o_custkey", "value", ["o_orderkey"], non_empty=False),
    ),
    "A34_skip_reasons": (
        "SELECT event_type AS reason, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_id % 4 AS shard, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type",
        lambda t: audits.merged_counts(t("events"), F.col("event_id") % 4, "event_type"),
    ),
    "A35_purge_statuses": (
        "SELECT CASE WHEN html LIKE '%</html>%' THEN 'whole' WHEN html LIKE '%</article>%' THEN 'cut late' ELSE 'cut early' END AS status, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1",
        lambda t: audits.histogram(t("pages"), ids.status((F.contains("html", F.lit("</html>")), "whole"), (F.contains("html", F.lit("</article>")), "cut late"), otherwise="cut early"), "status"),
    ),
    "A37_domain_summary": (
        "SELECT CAST(count(DISTINCT p_brand) AS BIGINT) AS folds, CAST(count(DISTINCT p_type) AS BIGINT) AS families, median(p_size) AS median_length, max(p_size) AS longest, CAST(sum(CASE WHEN p_size > 40 THEN 1 ELSE 0 END) AS BIGINT) AS multi FROM part",
        lambda t: audits.domain_summary(t("part"), "p_brand", "p_type", "p_size", F.col("p_size") > 40),
    ),
    "A38_loader_gate": (
        "SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(avg(CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS DOUBLE)), 6) <= 0.01 AS passed FROM events",
        lambda t: audits.failure_gate(t("events"), F.col("event_type") == "error"),
    ),
    "R10_sampled_integrity": (
        "SELECT n_chars % 3 AS kind, CAST(count(*) AS BIGINT) AS n, CAST(floor(count(*) * 0.25) AS BIGINT) AS extrapolated FROM (SELECT * FROM documents WHERE doc_id % 4 = 1) GROUP BY 1",
        lambda t: audits.sampled_kinds(t("documents").where("doc_id % 4 = 1"), F.col("n_chars") % 3, 0.25),
    ),
    "R11_sampled_verification": (
        "SELECT CAST(sum(CASE WHEN a.o_totalprice = b.o_totalprice THEN 0 ELSE 1 END) AS BIGINT) AS mismatches, CAST(count(*) AS BIGINT) AS checked FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey % 11 = 0",
        lambda t: audits.verified(t("orders").where("o_orderkey % 11 = 0"), t("orders"), "o_orderkey", "o_totalprice"),
    ),
    "R12_reject_reasons": (
        "SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN n_chars = 0 THEN 'no residues' WHEN lang NOT IN ('en', 'fr') THEN concat('dtype ', lang) WHEN n_chars > 3000 THEN 'shape' WHEN length(text) <> n_chars THEN 'length mismatch' END AS reason FROM documents",
        lambda t: t("documents").select("doc_id", ids.status((F.col("text").isNull(), "missing"), (F.col("n_chars") == 0, "no residues"), (~F.col("lang").isin("en", "fr"), F.concat(F.lit("dtype "), "lang")), (F.col("n_chars") > 3000, "shape"), (F.length("text") != F.col("n_chars"), "length mismatch")).alias("reason")),
    ),
    "R13_todo_ids": (
        "SELECT DISTINCT CAST(c_custkey AS BIGINT) AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 1000)",
        lambda t: ids.missing(t("customer").select(F.col("c_custkey").alias("id")), t("orders").where("o_orderkey < 1000").select(F.col("o_custkey").alias("id")), "id"),
    ),
    "R14_next_shard": (
        "SELECT coalesce(max(l_linenumber) + 1, 0) AS next_shard FROM lineitem",
        lambda t: ids.next_shard(t("lineitem"), "l_linenumber"),
    ),
    "R16_train_filter": (
        "SELECT concat('>', c_name, '|', n_name) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2",
        lambda t: t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey <> 2").select(F.concat(F.lit(">"), "c_name", F.lit("|"), "n_name").alias("line")),
    ),
    "R20_config_diff": (
        "SELECT a.n_name, a.n_regionkey AS saved, b.n_regionkey AS current FROM nation a JOIN (SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey FROM nation) b ON a.n_name = b.n_name WHERE a.n_regionkey <> b.n_regionkey",
        lambda t: audits.changed(t("nation"), t("nation").withColumn("n_regionkey", F.when(F.col("n_nationkey") % 5 == 0, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey"))), "n_name", "n_regionkey"),
    ),
    "R21_resume_position": (
        "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id + 1 ELSE event_id END AS epoch, CASE WHEN event_id % 5 = 0 THEN 0 ELSE (event_id % 7) * 256 END AS start_pair FROM events",
        lambda t: audits.resume_position(t("events").select("event_id"), F.col("event_id") % 5 == 0, "event_id", F.col("event_id") % 7, 256),
    ),
    "R31_equal_lengths": (
        "SELECT doc_id, n_chars FROM documents EXCEPT SELECT doc_id, length(text) FROM documents",
        lambda t: audits.unequal(t("documents").select("doc_id", "n_chars"), t("documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))),
    ),
    "R31_unequal_lengths": (
        "SELECT doc_id, n_chars FROM documents EXCEPT SELECT doc_id, strlen(text) FROM documents",
        lambda t: audits.unequal(t("documents").select("doc_id", "n_chars"), t("documents").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("bigint").alias("n"))),
    ),
    "R32_tuning_pool": (
        "SELECT c_custkey FROM customer c WHERE c_custkey % 10 <> 3 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O') AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
        lambda t: ids.present_in_all("c_custkey", t("customer").where("c_custkey % 10 <> 3"), *(t("orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("c_custkey")) for status in "OF")),
    ),
    "R33_common_queries": (
        "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
        lambda t: ids.present_in_all("o_custkey", *(t("orders").where(F.col("o_orderstatus") == status) for status in "OF")),
    ),
}
for _name, (_sql, _make) in TABLES.items():
    over_tables(_name, _sql, _make)


@query("A8_percentiles", f"SELECT pair_type, {', '.join(f'round(quantile_cont(gw_raw, {q}), 6) AS p{int(q * 100)}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM ({LABELS}) GROUP BY pair_type")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (0.05, 0.25, 0.5, 0.75, 0.95)
    names = [f"p{int(q * 100)}" for q in parts]
    own = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("pair_type"), "l_discount")
    return metrics.quantiles(own, "l_discount", list(parts), names, ("pair_type",)).select("pair_type", *(F.round(name, 6).alias(name) for name in names))


@query("F7_hierarchy", "SELECT p_partkey, p_type AS fold, concat(p_type, '.', p_brand) AS superfamily, concat(p_type, '.', p_brand, '.', CAST(p_size AS VARCHAR)) AS family FROM part")
def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws(".", "p_type", "p_brand", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", *(exprs.hierarchy(path, k + 1).alias(name) for k, name in enumerate(("fold", "superfamily", "family"))))


@query("F8_method_name", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(name, '\\.gz$', ''), '\\.tsv$', ''), '\\.m8$', '') AS method FROM (SELECT page_id, concat('run_', CAST(page_id AS VARCHAR), CASE page_id % 3 WHEN 0 THEN '.tsv.gz' WHEN 1 THEN '.m8' ELSE '' END) AS name FROM pages)")
def method_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("page_id") % 3 == 0, ".tsv.gz").when(F.col("page_id") % 3 == 1, ".m8").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", exprs.method_name(F.concat(F.lit("out/run_"), F.col("page_id").cast("string"), ending)).alias("method"))


@query("F15_rare_letters", "SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[uzob]', 'x', 'g'), '(.)', '\\1 ', 'gs')) AS spaced FROM benchmark")
def rare_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.lower("text"), "[uzob]", "x")
    return table(spark, sf_dir, "benchmark").select("item_id", F.trim(F.array_join(F.split(plain, ""), " ")).alias("spaced"))


@query("X19_bucket_labels", "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN '>=300000' ELSE concat('[', CAST(CAST(floor(o_totalprice / 100000) * 100000 AS BIGINT) AS VARCHAR), ', ', CAST(CAST((floor(o_totalprice / 100000) + 1) * 100000 AS BIGINT) AS VARCHAR), ')') END AS label FROM orders")
def bucket_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = (F.floor(F.col("o_totalprice") / 100000) * 100000).cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") >= 300000, ">=300000").otherwise(F.format_string("[%d, %d)", low, low + 100000)).alias("label"))


@query("X22_clock", "SELECT event_id, CASE WHEN event_id >= 3600 THEN printf('%dh %02dm', event_id // 3600, event_id % 3600 // 60) WHEN event_id >= 60 THEN printf('%dm %02ds', event_id // 60, event_id % 60) ELSE printf('%ds', event_id) END AS took FROM events")
def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", exprs.clock(F.col("event_id")).alias("took"))


@query("X23_json", "SELECT event_id, event_type, value FROM events")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest line written as JSON and read back."""
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("line"))
    return lines.select(F.from_json("line", "event_id bigint, event_type string, value double").alias("x")).select("x.*")


@query("T7_seeded_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '|7')), doc_id) AS k FROM documents) WHERE k <= 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample without replacement: the 100 least hashes of id and seed."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|7")).cast("binary")), "doc_id").limit(100)


@query("T8_examples", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority LIMIT 5")
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").limit(5)


@query("R24_wide_columns", "SELECT tm_data_row, sum(CASE WHEN pair_type = 'A' THEN gw_raw END) AS a, sum(CASE WHEN pair_type = 'N' THEN gw_raw END) AS n, sum(CASE WHEN pair_type = 'R' THEN gw_raw END) AS r FROM (SELECT tm_data_row, pair_type, round(avg(gw_raw), 6) AS gw_raw FROM (" + LABELS + ") GROUP BY 1, 2) GROUP BY 1")
def wide_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tm_data_row")).pivot("l_returnflag", ["A", "N", "R"])
    return own.agg(F.round(F.avg("l_discount"), 6)).toDF("tm_data_row", "a", "n", "r")
