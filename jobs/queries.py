"""The jobs as registered queries: each runs twice into one new folder under the shared one and gives its output as it then stands."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import search_benchmark, sequence_intake
from latticeq.plans import retrieval
from latticeq.plans.tables import _BUCKET, _SPLIT
from latticeq.registry import query
from latticeq.sources.shared import kept_folder

_HERE = Path(__file__).resolve().parent


def _config(job: str) -> dict:
    return json.loads((_HERE / f"{job}.json").read_text())


_INTAKE = f"""
WITH read_ AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS cluster, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'UZOB', 'XXXX') AS sequence FROM documents),
judged AS (SELECT *, CAST(length(sequence) AS BIGINT) AS letters, md5(sequence) AS digest, CASE WHEN id IS NULL OR trim(id) IN ('', 'nan') THEN 'no id' WHEN sequence = '' THEN 'no letters'
  WHEN length(sequence) < 20 THEN 'too short' WHEN length(sequence) > 60000 THEN 'too long' END AS bad FROM read_),
placed AS (SELECT *, first_value(id) OVER (PARTITION BY bad IS NULL, digest ORDER BY length(id), id) AS first, row_number() OVER (PARTITION BY bad IS NULL, digest ORDER BY length(id), id) AS k FROM judged),
done AS (SELECT *, CASE WHEN bad IS NULL AND k > 1 THEN 'copy' ELSE bad END AS reason FROM placed)
SELECT id, cluster, sequence, letters, digest, reason, CASE WHEN reason = 'copy' THEN first END AS copy_of, 0 AS batch,
  CASE WHEN reason IS NOT NULL THEN 'rejected' ELSE {_SPLIT.format(_BUCKET.format('coalesce(cluster, id)'))} END AS split FROM done"""


@query("job1_sequence_intake", _INTAKE)
def job1_sequence_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are new to the first run, none to the second."""
    where = kept_folder(spark)
    for _ in range(2):
        out = sequence_intake.run(spark, f"{sf_dir}/documents.parquet", f"{where}/out", f"{where}/checkpoint", _config("sequence_intake"))
    return out


def _hits_part(name: str, hits: str) -> str:
    level = "CASE WHEN q.family = t.family THEN 'family' WHEN q.superfamily = t.superfamily THEN 'superfamily' WHEN q.fold = t.fold THEN 'fold' ELSE 'none' END"
    return f"SELECT 'hits' AS part, '{name}' AS method, query, target, rank, {level} AS name, score AS value FROM ({hits}) h JOIN ({retrieval._DOMAINS}) q ON h.query = q.id JOIN ({retrieval._DOMAINS}) t ON h.target = t.id"


def _scores_part(name: str, hits: str) -> str:
    levels = " UNION ALL ".join(f"SELECT query, '{level}' AS name, {level} AS value FROM s_{name}" for level in search_benchmark.LEVELS)
    return f"SELECT 'sensitivity' AS part, '{name}' AS method, query, NULL::BIGINT AS target, NULL::INT AS rank, name, value FROM ({levels})"


def _means_part(name: str) -> str:
    lines = " UNION ALL ".join([*(f"SELECT '{level}' AS name, round(avg({level}), 6) AS value FROM s_{name}" for level in search_benchmark.LEVELS), f"SELECT 'queries', count(*)::DOUBLE FROM s_{name}"])
    return f"SELECT 'report' AS part, '{name}' AS method, NULL::BIGINT AS query, NULL::BIGINT AS target, NULL::INT AS rank, name, value FROM ({lines})"


_LEAD = " UNION ALL ".join(f"SELECT 'report' AS part, 'squares' AS method, NULL::BIGINT AS query, NULL::BIGINT AS target, NULL::INT AS rank, '{c}' AS name, {c}::DOUBLE AS value FROM lead_" for c in ("difference", "low", "high", "wins_a", "wins_b"))
_METHODS = {"cosine": retrieval._HITS, "squares": retrieval._OTHER}
_BENCHMARK = "WITH " + ", ".join(f"s_{name} AS MATERIALIZED ({retrieval._sensitivity_sql(hits)})" for name, hits in _METHODS.items()) + f""",
lead_ AS MATERIALIZED ({retrieval.bootstrap_sql('SELECT a.query, a.superfamily AS a, b.superfamily AS b FROM s_cosine a JOIN s_squares b ON a.query = b.query')})
""" + " UNION ALL ".join([*(part for name, hits in _METHODS.items() for part in (_hits_part(name, hits), _scores_part(name, hits), _means_part(name))), _LEAD])


@query("job2_search_benchmark", _BENCHMARK)
def job2_search_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched by the first run; the second finds the lists, and judges and compares them again."""
    where = kept_folder(spark)
    for _ in range(2):
        out = search_benchmark.run(spark, f"{sf_dir}/embeddings.parquet", where, _config("search_benchmark"))
    return out
