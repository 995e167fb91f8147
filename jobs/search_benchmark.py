"""Retrieval benchmark: search all against all under several methods, judge the lists by a hierarchy of classes, and compare the methods.

A group that tries out embeddings asks which of them finds relatives best. For each method, an expression over the table of vectors, the job
searches every vector's nearest ones and says at which level a hit is related: family, superfamily, fold, or none. From the lists come each
query's sensitivity up to the first false positive, the methods' means, and paired bootstrap intervals of the first method's lead on the
superfamily level.

Output, all Parquet: `hits` by method and level, `sensitivity` by method, `report` by method. Lists are the expensive part. They are made once for the
same files and settings, by a stamp that is void while they are written, so a run that broke off, or one more run, makes only what is
missing; everything else is derived from them and replaced.

    python -m jobs.search_benchmark --source TABLE --output FOLDER [--config jobs/search_benchmark.json] [--cpus 8]
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import counts, logger, main
from latticeq.operators import runs, search

log = logger("search_benchmark")

LEVELS = ("family", "superfamily", "fold")
DEFAULTS = {"id": "id", "methods": {"cosine": "vec"}, "levels": {name: name for name in LEVELS}, "top": 2000, "draws": 10_000}


def domains(table: DataFrame, config: dict) -> DataFrame:
    """id and the names of its classes."""
    return table.select(F.col(config["id"]).alias("id"), *(F.expr(config["levels"][level]).alias(level) for level in LEVELS))


def with_level(hits: DataFrame, classes: DataFrame) -> DataFrame:
    """hits with the narrowest level that both sides share: family, superfamily, fold or none; 'unknown' for a side without classes."""
    sides = [classes.select(F.col("id").alias(side), *(F.col(level).alias(f"{side}_{level}") for level in LEVELS)) for side in ("query", "target")]
    joined = hits.join(sides[0], "query", "left").join(sides[1], "target", "left")
    known = F.col("query_fold").isNotNull() & F.col("target_fold").isNotNull()
    level = F.when(~known, "unknown")
    for name in LEVELS:
        level = level.when(F.col(f"query_{name}") == F.col(f"target_{name}"), name)
    return joined.select("query", "target", "score", "rank", level.otherwise("none").alias("level"))


def lists(spark: SparkSession, source: str, output: str, name: str, config: dict) -> DataFrame:
    """The ranked list of one method, searched unless the same files and settings have been."""
    table = spark.read.parquet(source)
    vector = config["methods"][name]

    def searched() -> DataFrame:
        log.info("searching %s under %s", source, name)
        return search.blocked_top_k(table.select(F.col(config["id"]).alias("id"), F.expr(vector).alias("vec")), config["top"])

    return runs.cached(spark, f"{output}/lists/{name}", runs.files_stamp(table, config["id"], vector, config["top"]), searched)


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> DataFrame:
    """Search, judge and compare; gives all of the output in one table."""
    config = DEFAULTS | (config or {})
    classes = domains(spark.read.parquet(source), config)
    log.info("read %d vectors from %s", classes.count(), source)
    for name in config["methods"]:
        found = lists(spark, source, output, name, config)
        with_level(found, classes).write.mode("overwrite").partitionBy("level").parquet(f"{output}/hits/method={name}")
        search.sensitivity(found, classes).write.mode("overwrite").parquet(f"{output}/sensitivity/method={name}")
    scores = {name: spark.read.parquet(f"{output}/sensitivity/method={name}") for name in config["methods"]}
    first = next(iter(scores))
    for name, own in scores.items():
        means = own.agg(*(F.round(F.avg(level), 6).alias(level) for level in LEVELS), F.count(F.lit(1)).cast("double").alias("queries"))
        lines = means.unpivot([], [*LEVELS, "queries"], "name", "value")
        if name != first:
            paired = scores[first].select("query", F.col("superfamily").alias("a")).join(own.select("query", F.col("superfamily").alias("b")), "query")
            lead = search.paired_bootstrap(paired, config["draws"])
            figures = ["difference", "low", "high", "wins_a", "wins_b"]
            lines = lines.unionByName(lead.select(*(F.col(c).cast("double").alias(c) for c in figures)).unpivot([], figures, "name", "value"))
        lines.coalesce(1).write.mode("overwrite").parquet(f"{output}/report/method={name}")
    hits, sensitivity, report = tables(spark, output)
    log.info("wrote hits %s to %s", counts(hits, "method", "level"), output)
    for row in report.orderBy("method", "name").collect():  # a few figures for each method
        log.info("%s: %s %.6f", row["method"], row["name"], row["value"] if row["value"] is not None else float("nan"))
    return whole(hits, sensitivity, report)


def tables(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """hits, sensitivity and report as they stand."""
    return tuple(spark.read.parquet(f"{output}/{name}") for name in ("hits", "sensitivity", "report"))


def whole(hits: DataFrame, sensitivity: DataFrame, report: DataFrame) -> DataFrame:
    """The three tables as one: part, method, query, target, rank, name (a level or figure) and value."""
    nothing = [F.lit(None).cast(sensitivity.schema["query"].dataType).alias(c) for c in ("query", "target")]
    none = F.lit(None).cast("int").alias("rank")
    each = sensitivity.unpivot(["method", "query"], list(LEVELS), "name", "value")
    found = hits.select(F.lit("hits").alias("part"), "method", "query", "target", F.col("rank").cast("int").alias("rank"), F.col("level").alias("name"), F.col("score").alias("value"))
    found = found.unionByName(each.select(F.lit("sensitivity").alias("part"), "method", "query", nothing[1], none, "name", "value"))
    return found.unionByName(report.select(F.lit("report").alias("part"), "method", *nothing, none, "name", "value"))


if __name__ == "__main__":
    main("search_benchmark", __doc__.splitlines()[0], {"source": "Parquet table of vectors", "output": "folder of the results"}, Path(__file__).with_suffix(".json"), DEFAULTS, run)
