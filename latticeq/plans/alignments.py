"""Alignment strings over the texts of benchmark: a gapped on vowels, b gapped on r, s and t, both of the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import alignment
from ..registry import query, table

def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    own = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(text, "[aeiou-]", "-").alias("a"), F.translate(F.regexp_replace(text, "[^aeiourst]", ":"), "aeiourst", "...    X").alias("m"), F.regexp_replace(text, "[rst-]", "-").alias("b"))
    return own


_LONG = f"""SELECT item_id, k - 1 AS pos, substr(a, k, 1) AS a, substr(m, k, 1) AS marker, substr(b, k, 1) AS b FROM (
 SELECT item_id, regexp_replace(t, '[aeiou-]', '-', 'g') AS a, translate(regexp_replace(t, '[^aeiourst]', ':', 'g'), 'aeiourst', '...    X') AS m, regexp_replace(t, '[rst-]', '-', 'g') AS b, unnest(range(1, length(t) + 1)) AS k
 FROM (SELECT item_id, text AS t FROM benchmark))"""
_PAIRS = f"""SELECT item_id, pos, i, j, a, marker, b FROM (SELECT *, CAST(sum((a <> '-')::INT) OVER w - 1 AS BIGINT) AS i, CAST(sum((b <> '-')::INT) OVER w - 1 AS BIGINT) AS j FROM ({_LONG}) WINDOW w AS (PARTITION BY item_id ORDER BY pos))
 WHERE a <> '-' AND b <> '-' AND marker IN (':', '.', ' ')"""
_SEGMENTS = f"SELECT item_id, min(i) AS i0, min(j) AS j0, count(*)::BIGINT AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY item_id, j - i ORDER BY i) AS g FROM ({_PAIRS})) GROUP BY item_id, j - i, g"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_pairs(strings(spark, sf_dir), "item_id", "a", "m", "b")


def sized_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned pairs with the length of the second side."""
    length = strings(spark, sf_dir).select("item_id", F.length(F.replace("b", F.lit("-"), F.lit(""))).alias("size"))
    return pairs(spark, sf_dir).join(length, "item_id")


@query("X17_aligned_pairs", f"SELECT item_id, pos::INT AS pos, i, j, a, marker, b FROM ({_PAIRS})")
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query("F3_marker_filter", f"SELECT marker, count(*)::BIGINT AS n FROM ({_PAIRS}) GROUP BY 1")
def marker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


@query("W6_aligned_segments", _SEGMENTS)
def aligned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.segments(pairs(spark, sf_dir), "item_id")


@query("W7_residue_index", f"SELECT item_id, pos::INT AS pos, i FROM (SELECT item_id, pos, a, CAST(sum((a <> '-')::INT) OVER (PARTITION BY item_id ORDER BY pos) - 1 AS BIGINT) AS i FROM ({_LONG})) WHERE a <> '-'")
def residue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = strings(spark, sf_dir).withColumn("m", F.regexp_replace("a", "(?s).", ":")).withColumn("b", F.regexp_replace("a", "(?s).", "x"))
    return alignment.aligned_pairs(own, "item_id", "a", "m", "b").select("item_id", "pos", "i")


@query("X18_expanded_segments", f"SELECT item_id, i, j FROM ({_PAIRS})")
def expanded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.expanded(alignment.segments(pairs(spark, sf_dir), "item_id"), "item_id")


@query("A33_string_identity", f"SELECT item_id, round(coalesce(sum((a = b AND a <> '-')::INT) / nullif(sum((a <> '-' AND b <> '-')::INT), 0), 0), 6) AS identity FROM ({_LONG}) GROUP BY 1")
def string_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.identity(strings(spark, sf_dir), "item_id", "a", "b").withColumn("identity", F.round("identity", 6))


@query("W8_aligned_stride", f"SELECT item_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS k FROM ({_PAIRS})) WHERE (k - 1) % 8 = 0")
def aligned_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = alignment.negatives(sized_pairs(spark, sf_dir), "item_id", "size", stride=8)
    return own.where("pair_type = 'aligned'").select("item_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"))


def drawn_sql(n: str, *parts: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT) % {n}"


def shifted_sql(rows: str, keys: tuple[str, ...]) -> str:
    """rows (keys, i, j, size) with shifted."""
    step, sign = (drawn_sql(n, *keys, "0", f"'{name}'") for n, name in (("29", "step"), ("2", "sign")))
    return f"SELECT * EXCLUDE (step), CAST(CASE WHEN j + step >= 0 AND j + step < size THEN j + step WHEN j - step >= 0 AND j - step < size THEN j - step END AS INT) AS shifted FROM (SELECT *, (CASE WHEN {sign} = 0 THEN 1 ELSE -1 END) * ({step} + 4) AS step FROM ({rows}))"


def random_sql(rows: str, path: str, keys: tuple[str, ...]) -> str:
    """keys, ri and rj of rows (keys, item_id, size): the first of ten that is not on the path, else the last."""
    ri, rj = (drawn_sql("size", *keys, "0", "t", str(k)) for k in (0, 1))
    tried = f"SELECT *, {ri} AS ri, {rj} AS rj FROM ({rows}), range(10) r(t)"
    marked = f"SELECT t.*, CASE WHEN p.i IS NULL THEN t.t ELSE 20 - t.t END AS o FROM ({tried}) t LEFT JOIN ({path}) p ON p.item_id = t.item_id AND p.i = t.ri AND p.j = t.rj"
    return f"SELECT {', '.join(keys)}, CAST(arg_min(ri, o) AS INT) AS ri, CAST(arg_min(rj, o) AS INT) AS rj FROM ({marked}) GROUP BY {', '.join(keys)}"


SIZED = f"SELECT p.*, length(regexp_replace(text, '[rst-]', '', 'g')) AS size FROM ({_PAIRS}) p JOIN benchmark USING (item_id)"
_POSITIVE = f"SELECT item_id, (n - 1) // 8 AS k, pos, i, j, size FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM ({SIZED})) WHERE (n - 1) % 8 = 0"
_MOVED = f"SELECT * EXCLUDE (shifted), CASE WHEN k % 2 = 0 THEN shifted END AS s FROM ({shifted_sql(_POSITIVE, ('item_id', 'k'))})"
NEGATIVES = f"""SELECT item_id, k::INT AS k, 'aligned' AS pair_type, pos::INT AS pos, i::INT AS i, j::INT AS j FROM ({_POSITIVE}) UNION ALL
SELECT m.item_id, m.k::INT, CASE WHEN s IS NOT NULL THEN 'shifted' ELSE 'random' END, -1, CASE WHEN s IS NOT NULL THEN i ELSE ri END::INT, coalesce(s, rj)::INT
FROM ({_MOVED}) m LEFT JOIN ({random_sql(f'SELECT * FROM ({_MOVED}) WHERE s IS NULL', _PAIRS, ('item_id', 'k'))}) d ON d.item_id = m.item_id AND d.k = m.k"""


@query("W9_negatives", NEGATIVES)
def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and negatives by turns; md5 takes the place of random numbers."""
    return alignment.negatives(sized_pairs(spark, sf_dir), "item_id", "size", stride=8)


@query("R5_dense_anchors", f"SELECT b.item_id, coalesce(s.n, 0) AS anchors, CASE WHEN coalesce(s.n, 0) > 12 THEN 'stored' ELSE 'labelled' END AS used FROM benchmark b LEFT JOIN (SELECT item_id, count(*)::BIGINT AS n FROM ({_PAIRS}) GROUP BY 1) s ON b.item_id = s.item_id")
def dense_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = pairs(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id").join(stored, "item_id", "left").select("item_id", n.alias("anchors"), F.when(n > 12, "stored").otherwise("labelled").alias("used"))


@query("X17_lateral_columns", f"SELECT item_id, pos::INT AS pos, i, j, a, marker, b FROM ({_PAIRS})")
def lateral_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As X17, from SQL with a table function."""
    tables.register(spark)
    return spark.sql("SELECT s.item_id, t.* FROM {strings} s, LATERAL aligned_columns(s.a, s.m, s.b) t", strings=strings(spark, sf_dir))


@query("X18_lateral_runs", f"SELECT item_id, i, j FROM ({_PAIRS})")
def lateral_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As X18, from SQL with a table function."""
    tables.register(spark)
    runs = alignment.segments(pairs(spark, sf_dir), "item_id")
    return spark.sql("SELECT r.item_id, t.* FROM {runs} r, LATERAL expanded_run(r.i0, r.j0, r.len) t", runs=runs)
