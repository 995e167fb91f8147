"""Incremental intake of sequences: new files of a text table are cleaned, checked, freed of copies, split, and appended.

A training set of sequences grows file by file. Each run takes the files that came since the last one, as a stream that ends when all of them
are taken. A text becomes a sequence of upper-case letters, in which rare ones are replaced. What cannot be used is kept aside with its
reason: no id, no letters, too short, too long, or a copy of a sequence that came before (in one batch: of the one with the least id). What is
left goes to train, val or test by its cluster, which is the same on any machine and in any run.

Output, all Parquet, partitioned by batch and split: `sequences` (the split of what is not used is 'rejected') and `ledger` (rows by batch, split
and reason). A batch has folders of its own, which a retry replaces, and copies are looked for in earlier batches only, so a run that broke
off is repeated with the same result. The stream's checkpoint says what has been taken; it belongs to its output and moves with it.

    python -m jobs.sequence_intake --source TABLE --output FOLDER --checkpoint FOLDER [--config jobs/sequence_intake.json] [--cpus 8]
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import counts, logger, main
from latticeq.functions import exprs
from latticeq.operators import ids, sampling
from latticeq.sources.shared import stored
from latticeq.streaming import incremental

log = logger("sequence_intake")

DEFAULTS = {"id": "doc_id", "cluster": "source", "text": "text", "least_letters": 20, "most_letters": 60_000, "files_per_batch": 1000}
#: Letters that stand for rare residues, and the one that takes their place.
RARE, PLAIN = "UZOB", "XXXX"
SEQUENCES = "id string, cluster string, sequence string, letters bigint, digest string, reason string, copy_of string, split string"


def sequence_of(text: Column) -> Column:
    """The Latin letters of a text in upper case, rare ones replaced."""
    return F.translate(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", "")), RARE, PLAIN)


def cleaned(rows: DataFrame, config: dict) -> DataFrame:
    """id, cluster, sequence, letters, digest and the reason against a row, if there is one that the row itself shows."""
    own = rows.select(F.col(config["id"]).cast("string").alias("id"), F.col(config["cluster"]).cast("string").alias("cluster"), sequence_of(F.col(config["text"])).alias("sequence"))
    own = own.withColumns({"letters": F.length("sequence").cast("bigint"), "digest": F.md5(F.col("sequence").cast("binary"))})
    reason = ids.status((~exprs.valid_id(F.col("id")), "no id"), (F.col("letters") == 0, "no letters"), (F.col("letters") < config["least_letters"], "too short"), (F.col("letters") > config["most_letters"], "too long"))
    return own.withColumn("reason", reason)


def first_of_each(rows: DataFrame) -> DataFrame:
    """digest and the id of its first row: the least by length and text, so 2 comes before 10. Ids are taken before rows meet, so a sequence of many copies costs no more than one."""
    return sampling.keep_first(rows.select("digest", "id", F.length("id").alias("long")), ["digest"], ["long", "id"]).select("digest", F.col("id").alias("first"))


def taken_in(batch: DataFrame, before: DataFrame | None, config: dict) -> DataFrame:
    """A batch with reason, copy_of and split; `before` has the digests and ids of earlier batches' sequences.

    Rows that are refused for what they are do not meet others: their sequences are often the same, and many.
    """
    rows = stored(cleaned(batch, config))  # read by several joins, cleaned once
    usable, refused = rows.where("reason is null"), rows.where("reason is not null")
    firsts = first_of_each(usable).withColumn("old", F.lit(False))
    if before is not None:
        known = before.select("digest", F.col("id").alias("earlier"))
        firsts = firsts.join(known, "digest", "left").select("digest", F.coalesce("earlier", "first").alias("first"), F.col("earlier").isNotNull().alias("old"))
    again = F.row_number().over(Window.partitionBy("digest", "id").orderBy("cluster")) > 1  # of rows that repeat id and sequence, one stays
    copy = F.col("old") | (F.col("id") != F.col("first")) | F.col("again")
    marked = usable.join(firsts, "digest").withColumn("again", again).withColumn("copy", copy)
    judged = marked.select(*rows.drop("reason").columns, F.when(F.col("copy"), "copy").alias("reason"), F.when(F.col("copy"), F.col("first")).alias("copy_of"))
    whole = judged.unionByName(refused.withColumn("copy_of", F.lit(None).cast("string")))
    split = F.when(F.col("reason").isNotNull(), "rejected").otherwise(exprs.split_of(exprs.stable_bucket(F.coalesce("cluster", "id"))))
    return whole.select("id", "cluster", "sequence", "letters", "digest", "reason", "copy_of", split.alias("split"))


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take what is new in source; gives all of the output as it stands then."""
    config = DEFAULTS | (config or {})
    stream = incremental.file_stream(spark, source, config["files_per_batch"]).select(config["id"], config["cluster"], config["text"])

    def each(batch: DataFrame, number: int) -> None:
        before = None
        if number:
            before = sequences(spark, output).where((F.col("batch") < number) & (F.col("split") != "rejected"))
        where = f"{output}/sequences/batch={number}"
        taken_in(batch, before, config).write.mode("overwrite").partitionBy("split").parquet(where)
        written = spark.read.schema(SEQUENCES).parquet(where).groupBy("split", "reason").count()
        written.coalesce(1).write.mode("overwrite").parquet(f"{output}/ledger/batch={number}")
        lines = counts(spark.read.schema(SEQUENCES).parquet(where), "split", "reason")
        log.info("batch %d of %s: read %d rows, wrote %s to %s", number, source, sum(x["count"] for x in lines), lines, where)

    incremental.run_available(stream, checkpoint, each)
    found = sequences(spark, output)
    log.info("%s holds %s", output, counts(found, "batch", "split"))
    return found


def sequences(spark: SparkSession, output: str) -> DataFrame:
    """Everything taken in so far, with its batch and split."""
    return spark.read.schema(f"{SEQUENCES}, batch int").parquet(f"{output}/sequences")


def ledger(spark: SparkSession, output: str) -> DataFrame:
    """Rows by batch, split and reason."""
    return spark.read.schema("split string, reason string, count bigint, batch int").parquet(f"{output}/ledger")


if __name__ == "__main__":
    main("sequence_intake", __doc__.splitlines()[0], {"source": "Parquet table, a folder that grows or a file", "output": "folder of the results", "checkpoint": "folder of the stream's checkpoint"}, Path(__file__).with_suffix(".json"), DEFAULTS, run)
