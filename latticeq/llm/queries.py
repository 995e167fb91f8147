"""The queries of this subpackage's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_ngram, decontam, license_scan, line_quality, near_dup, packing, page_diff, site_lines, spot_sigs, toxicity, url_model, whitening
from .common import crc_bucket, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    """Where the environment's vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document; fold 2 of 4 is held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_brown_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base scores of every document; fold 1 of 5 is held out."""
    trained = class_ngram.in_training()
    scored = class_ngram.score_texts(table(spark, sf_dir, "documents"), trained)
    return scored.withColumn("held_out", ~trained)


def op3_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict for every document."""
    judged = line_quality.clean_lines(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_diff.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


URL_RULES = [url_model.Rule.of(*x) for x in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def op5_character_ratio_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return url_model.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_superminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies over all documents."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_site_relative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that its source repeats."""
    return site_lines.drop_site_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices in all documents."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_bm25_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return decontam.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's whitened components, a row for each, with the figures of the fit."""
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit_whitening(rows)
    done = whitening.whiten(rows.select("vec_id", "embedding"), model)
    explained = F.array(*(F.lit(float(e)) for e in (model.explained if model else ()))).cast("array<double>")
    placed = done.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    figures = [F.lit(model.n if model else 0).cast("bigint").alias("n"), F.col("deviation")]
    return placed.select("vec_id", (F.col("place") + 1).alias("component"), *figures, "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))


def op12_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return spot_sigs.fingerprints(table(spark, sf_dir, "documents"))


for _query in (op1_compression_toxicity, op2_brown_class_bigrams, op3_line_first_quality, op4_page_differencing, op5_character_ratio_urls, op6_superminhash_near_dup, op7_site_relative_lines, op8_best_fit_packing, op9_patience_licenses, op10_bm25_wand_decontamination, op11_embedding_whitening, op12_spot_signatures):
    QUERIES[_query.__name__] = _query

ORACLES["op3_line_first_quality"] = line_quality.ORACLE
ORACLES["op7_site_relative_lines"] = site_lines.ORACLE
