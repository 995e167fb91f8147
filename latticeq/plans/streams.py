"""Streams over the events file with all available rows taken at once; results equal those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..registry import query, table
from ..sources.shared import folder
from ..streaming import incremental


@query("G1_incremental_append", "SELECT event_id, event_type FROM events")
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended twice: the second run finds nothing new."""
    where = folder(spark)
    for _ in range(2):
        stream = incremental.file_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "event_type")
        incremental.append_stream(stream, f"{where}/out", f"{where}/state", "event_id")
    return incremental.appended(spark, f"{where}/out")


@query("G2_first_seen", "SELECT DISTINCT user_id FROM events")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = folder(spark)
    stream = incremental.first_seen(incremental.file_stream(spark, f"{sf_dir}/events.parquet"), "user_id", "ts", "3650 days").select("user_id")
    incremental.write_batches(stream, f"{where}/out", f"{where}/state")
    return incremental.appended(spark, f"{where}/out")


@query("G3_windowed_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    where = folder(spark)
    counts = incremental.windowed_counts(incremental.file_stream(spark, f"{sf_dir}/events.parquet"), "ts", "1 day", "event_type")
    sink = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{where}/out"))
    sink.option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("G4_carried_groups", "SELECT user_id, event_id, value FROM events")
def carried_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of users, each user's together once all are there; the number of rows comes with each."""
    from pyspark.sql import functions as F

    sizes = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    where = folder(spark)
    stream = incremental.file_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "value").join(sizes, "user_id")
    groups = incremental.carried_groups(stream, "user_id", "size")
    incremental.write_batches(groups, f"{where}/out", f"{where}/state")
    return incremental.appended(spark, f"{where}/out").select("user_id", "event_id", "value")


_SIZED = "SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id) + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS size, user_id % 5 <> 0 AS whole FROM events"


@query("G4_late_groups", f"SELECT user_id, event_id, whole FROM ({_SIZED}) WHERE whole OR user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events))")
def late_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' rows when all are there, held in keyed state; of users that lack a row, what is there an hour after their last one. Others still wait."""
    from pyspark.sql import functions as F

    own, where = table(spark, sf_dir, "events"), folder(spark)
    sizes = own.groupBy("user_id").agg((F.count(F.lit(1)) + F.when(F.col("user_id") % 5 == 0, 1).otherwise(0)).alias("size"))
    stream = incremental.file_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).join(sizes, "user_id")
    with incremental.keyed_state(spark):
        incremental.write_batches(incremental.whole_groups(stream, "user_id", "size", "ts", "1h"), f"{where}/out", f"{where}/state")
    return incremental.appended(spark, f"{where}/out").select("user_id", "event_id", "whole")


@query("G5_stopped_and_resumed", "SELECT event_id FROM events")
def stopped_and_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over eight files that stops after two batches, and one that goes on where it stopped."""
    from pyspark.sql import functions as F

    where = folder(spark)
    table(spark, sf_dir, "events").select("event_id").repartition(8, F.col("event_id")).write.parquet(f"{where}/in")
    for most in (2, 8):
        incremental.stopped_after(incremental.file_stream(spark, f"{where}/in", 1), f"{where}/state", incremental.into(f"{where}/out"), most)
    return incremental.appended(spark, f"{where}/out")


@query("G6_incremental_pack", "SELECT event_id, value FROM events WHERE event_id % 2 = 0")
def incremental_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = folder(spark)
    stream = incremental.file_stream(spark, f"{sf_dir}/events.parquet").where("event_id % 2 = 0").select("event_id", "value")
    incremental.append_stream(stream, f"{where}/out", f"{where}/state", "event_id")
    return incremental.appended(spark, f"{where}/out")
