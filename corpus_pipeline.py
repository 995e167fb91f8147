"""A training-data pipeline over `documents`: toxic documents, site boilerplate, near copies and benchmark leaks go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeq.llm import decontam, near_dup, packing, site_lines, toxicity
from latticeq.llm.common import stored, table
from latticeq.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones scores under the threshold.

    Null and empty texts score as texts without any toxic window; texts of any length are scored whole; repeated rows stay or go alike; a score equal to the
    threshold goes; without labels of both classes all score alike; an empty table gives an empty table; extra columns stay, whatever their names.
    """
    return toxicity.drop_toxic(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that its source repeats; n_chars is the length of what is left.

    A null text stays null with its n_chars, a null source is the source ''; lines and texts of any length are taken whole; repeated rows are cleaned each; a
    line whose ratio equals the limit stays; an empty table gives an empty table; extra columns stay, whatever their names.
    """
    cleaned = site_lines.drop_site_lines(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id.

    Null, empty and blank texts and null ids have no copies and stay; texts of any length are compared by all their shingles; repeated rows with the kept id
    all stay; a pair at exactly the least similarity is a pair of copies; an empty table gives an empty table; extra columns stay, whatever their names.
    """
    return near_dup.keep_one(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items.

    Null and empty texts hold none and stay; texts of any length are searched whole; repeated rows stay or go alike; a passage that reaches an item's threshold
    exactly is verified; without items all stay; an empty table gives an empty table; extra columns stay, whatever their names.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, in sequences.

    Null and empty texts give the end id alone; texts longer than a sequence are cut into whole pieces, none is lost; repeated rows are packed each; of pieces of
    one length any may come first; an empty table gives an empty table; extra columns are left out.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_site_lines), ("near duplicates", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: SQL expresses neither the model nor the packing; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
