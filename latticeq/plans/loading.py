"""Items, rejects and batches over the embeddings: structures of 1, 3, 5, ... residues, each paired with the next one, residue by residue.

Every seventh structure lacks a feature, every fifth group asks for a residue behind the end, every eleventh has an unknown pair type, and the last structure has no next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loader
from ..registry import query, table

PATCH = 6


def _name(s: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad((s * 7 % 1000).cast("string"), 4, "0"), F.lit("_"), s.cast("string"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.sqrt(F.col("vec_id").cast("double"))).alias("s"), F.col("embedding").cast("array<double>").alias("v"))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _rows(spark, sf_dir).groupBy("s").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("r"))  # one chain
    kept = F.when(F.col("s") % 7 == 3, F.size("r") - 1).otherwise(F.size("r"))
    return lists.select(_name(F.col("s")).alias("id"), F.transform("r", lambda x: F.slice(x["v"], 1, 3)).alias("points"), F.slice(F.transform("r", lambda x: x["v"]), F.lit(1), kept).alias("features"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("s"), F.col("vec_id")
    kind = F.when((s % 11 == 5) & (k % 3 == 0), "other").when(k % 3 == 0, "aligned").when(k % 3 == 1, "shifted").otherwise("random")
    raw = [(F.abs(F.get("v", place)) / 4).alias(name) for place, name in ((3, "gw_raw"), (4, "fgw_raw"))]
    behind = F.when(s % 5 == 2, 1).otherwise(0)
    return _rows(spark, sf_dir).select(s.alias("row"), _name(s).alias("id1"), _name(s + 1).alias("id2"), (k - s * s).alias("r1"), (k * 7 % (2 * s + 3) + behind).alias("r2"), *raw, F.abs(F.get("v", 5)).alias("tm_term"), kind.alias("pair_type"))


_R = "SELECT vec_id, CAST(floor(sqrt(vec_id::DOUBLE)) AS BIGINT) AS s, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_L = """SELECT s AS row, vec_id - s * s AS r1, vec_id * 7 % (2 * s + 3) + CASE WHEN s % 5 = 2 THEN 1 ELSE 0 END AS r2, exp(-abs(v[4]) / 4 / 0.05) AS structure, exp(-abs(v[5]) / 4 / 0.1) AS composite, abs(v[6]) AS tm,
 CASE WHEN s % 11 = 5 AND vec_id % 3 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 0 WHEN vec_id % 3 = 1 THEN 1 ELSE 2 END AS code FROM r"""
_NAME = "concat('S', lpad(CAST({0} * 7 % 1000 AS VARCHAR), 4, '0'), '_', CAST({0} AS VARCHAR))"
_G = f"""SELECT l.row, {_NAME.format('l.row')} AS id1, {_NAME.format('(l.row + 1)')} AS id2, count(*) AS n, CASE
 WHEN max(b.points) IS NULL THEN concat('no protein ', {_NAME.format('(l.row + 1)')})
 WHEN l.row % 7 = 3 OR (l.row + 1) % 7 = 3 THEN 'points and features differ in number'
 WHEN max(l.r1) >= max(a.points) OR max(l.r2) >= max(b.points) THEN 'residue outside the protein'
 WHEN bool_or(l.code IS NULL) THEN 'unknown pair type' WHEN max(greatest(a.points, b.points)) > 1000 THEN 'sequence too long' END AS reason
 FROM l LEFT JOIN p a ON a.s = l.row LEFT JOIN p b ON b.s = l.row + 1 GROUP BY l.row"""
_WITH = f"WITH r AS MATERIALIZED ({_R}), l AS MATERIALIZED ({_L}), p AS (SELECT s, count(*) AS points FROM r GROUP BY s), g AS MATERIALIZED ({_G})"
_NEAR = f"SELECT s, i, list(j ORDER BY place) AS patch FROM (SELECT a.s, a.vec_id - a.s * a.s AS i, b.vec_id - b.s * b.s AS j, row_number() OVER (PARTITION BY a.vec_id ORDER BY a.vec_id <> b.vec_id, sqrt((a.v[1] - b.v[1]) ** 2 + (a.v[2] - b.v[2]) ** 2 + (a.v[3] - b.v[3]) ** 2), b.vec_id) AS place FROM r a JOIN r b ON a.s = b.s) WHERE place <= {PATCH} GROUP BY s, i"
_ORDER = "ORDER BY l.r1, l.r2, l.code"


@query("R1_built_items", f"""{_WITH}, near AS MATERIALIZED ({_NEAR})
SELECT g.row, g.id1, g.id2, g.n, list(l.r1 {_ORDER}) AS r1, list(l.r2 {_ORDER}) AS r2, list(l.code {_ORDER}) AS code, list(round(l.structure, 6) {_ORDER}) AS structure, list(round(l.composite, 6) {_ORDER}) AS composite,
 list(round(l.tm, 6) {_ORDER}) AS tm, list(x.patch {_ORDER}) AS patch1, list(y.patch {_ORDER}) AS patch2
FROM g JOIN l USING (row) JOIN near x ON x.s = g.row AND x.i = l.r1 JOIN near y ON y.s = g.row + 1 AND y.i = l.r2 WHERE g.reason IS NULL GROUP BY 1, 2, 3, 4""")
def built_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group that can be built, with the labels and patches of its residue pairs."""
    own = loader.build_items(labels(spark, sf_dir), proteins(spark, sf_dir), patch=PATCH).built
    rounded = {name: F.transform(name, lambda x: F.round(x, 6)) for name in ("structure", "composite", "tm")}
    whole = {name: F.transform(name, lambda p: F.transform(p, lambda j: j.cast("bigint"))) for name in ("patch1", "patch2")}
    return own.withColumns(rounded | whole)


@query("R2_rejected_items", f"{_WITH} SELECT row, id1, id2, n, reason FROM g WHERE reason IS NOT NULL")
def rejected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group that cannot be built, and why."""
    return loader.build_items(labels(spark, sf_dir), proteins(spark, sf_dir)).rejects


_BATCHED = "SELECT row, n, (row_number() OVER (ORDER BY row) - 1) // 4 AS batch, CAST((row_number() OVER (ORDER BY row) - 1) % 4 AS INT) AS place FROM g WHERE reason IS NULL"
_PADDED = "list({0} " + _ORDER + ") || list_resize([]::{1}[], (b.width - b.n)::BIGINT, {2}) AS {3}"


@query("R3_ragged_batches", f"""{_WITH}, k AS ({_BATCHED}), b AS (SELECT *, max(n) OVER (PARTITION BY batch) AS width FROM k)
SELECT b.batch, b.place, b.row, b.n, b.width, {_PADDED.format('l.r1', 'BIGINT', 0, 'r1')}, {_PADDED.format('l.code', 'INT', -1, 'code')}, {_PADDED.format('round(l.structure, 6)', 'DOUBLE', 0.0, 'structure')},
 {_PADDED.format('true', 'BOOLEAN', 'false', 'mask')} FROM b JOIN l USING (row) GROUP BY 1, 2, 3, 4, 5""")
def ragged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four items, each padded to its longest."""
    own = loader.collated(loader.build_items(labels(spark, sf_dir), proteins(spark, sf_dir), patch=PATCH).built, 4)
    return own.select("batch", "place", "row", "n", "width", "r1", "code", F.transform("structure", lambda x: F.round(x, 6)).alias("structure"), "mask")


@query("R12_reject_counts", f"{_WITH} SELECT regexp_replace(reason, ' S[0-9_]+$', '') AS reason, count(*) AS groups, sum(n)::BIGINT AS rows FROM g WHERE reason IS NOT NULL GROUP BY 1")
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected groups and rows by reason, without the names."""
    own = loader.build_items(labels(spark, sf_dir), proteins(spark, sf_dir)).rejects
    return own.groupBy(F.regexp_replace("reason", " S[0-9_]+$", "").alias("reason")).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"))
