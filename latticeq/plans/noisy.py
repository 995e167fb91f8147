"""Noise of labels over the embeddings: each label with the next one is a pair of structures, every eighth residue a labelled pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import noise
from ..registry import query
from ..sources.shared import stored
from .geometry import _POINTS, _lists, residues


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("id", "points")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eighth residue with the one at its place, five behind it, or the third of its number."""
    idx = F.col("idx")
    kind = F.element_at(F.array(*(F.lit(x) for x in noise.TYPES)), (F.floor(idx / 8) % 3 + 1).cast("int"))
    j = F.when(kind == "aligned", idx).when(kind == "shifted", idx + 5).otherwise(F.floor(idx / 3))
    return residues(spark, sf_dir).where("idx % 8 = 0").select(F.col("id").alias("row"), F.col("id").alias("id1"), (F.col("id") + 1).alias("id2"), idx.alias("i"), j.cast("bigint").alias("j"), kind.alias("pair_type"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored labels, which are the reference's, and those of all conditions."""
    long = stored(noise.relabelled(pairs(spark, sf_dir), structures(spark, sf_dir)))
    return noise.wide(long, long.where("condition = 'reference'"))


@query("N21_noise_conditions")
def noise_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each residue pair's label under eleven conditions, as similarities."""
    names = [name for name, *_ in noise.conditions()]
    return _wide(spark, sf_dir).select("row", "i", "j", "pair_type", *(F.round(exprs.similarity(F.col(f"`{name}`")), 5).alias(name.replace(".", "_")) for name in names))


_ASKED = f"SELECT id AS row, idx AS i, CASE (idx // 8) % 3 WHEN 0 THEN 'aligned' WHEN 1 THEN 'shifted' ELSE 'random' END AS pair_type, CASE (idx // 8) % 3 WHEN 0 THEN idx WHEN 1 THEN idx + 5 ELSE idx // 3 END AS j FROM ({_POINTS}) WHERE idx % 8 = 0"
_SIZES = f"SELECT id, count(*) AS n FROM ({_POINTS}) GROUP BY 1"


@query("N21_labelled_pairs", f"SELECT a.row, a.pair_type, count(*) AS pairs, 11 * count(*) AS labels FROM ({_ASKED}) a JOIN ({_SIZES}) s ON s.id = a.row + 1 WHERE a.j < s.n GROUP BY 1, 2")
def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many residue pairs and labels there are by structure and type: every pair has all of its eleven labels."""
    long = noise.relabelled(pairs(spark, sf_dir), structures(spark, sf_dir))
    return long.where(F.col("gw_raw").isNotNull()).groupBy("row", "pair_type").agg(F.count_distinct("i", "j").alias("pairs"), F.count(F.lit(1)).alias("labels"))


@query("R23_noise_families")
def noise_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six families of changes over all pairs and the three types."""
    return noise.noise_table(_wide(spark, sf_dir))
