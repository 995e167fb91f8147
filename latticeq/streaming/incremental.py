"""Incremental runs on Structured Streaming: what a run has done is the checkpoint's business, and each key comes out once."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet files under a path, or of a single file, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")  # a stream reads folders
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Take all that is new since the last run, batch by batch, then stop. A run that broke off goes on where its checkpoint ends."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def into(target: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch into a folder of its own, which a retry of the batch replaces: a row that comes once is there once, whatever breaks."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")


def write_batches(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Take all that is new and write it, each batch once."""
    run_available(stream, checkpoint, into(target))


def append_stream(stream: DataFrame, target: str, checkpoint: str, key: str) -> None:
    """Append what is new, each key once. What has been seen is the stream's state, so no batch reads the table."""
    write_batches(stream.dropDuplicates([key]), target, checkpoint)


def appended(spark: SparkSession, target: str) -> DataFrame:
    """What has been written by batches."""
    return spark.read.parquet(target).drop("batch")


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the time that late rows may take; state older than that is dropped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, width: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Rows per window and keys; rows later than the watermark are left out."""
    own = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def carried_groups(stream: DataFrame, key: str, size: str) -> DataFrame:
    """The rows of whole groups from a stream that brings them in parts: rows are held until a group has as many as its column `size` says.

    State holds the rows of groups that are not whole yet. A group's rows come out together, with `parts`, the number of batches it took.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout
    from pyspark.sql.types import StructType

    names = stream.columns
    packed = stream.select(key, size, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("row"))
    fields = {f.name: f for f in stream.schema.fields}

    def hold(group, batches, state):
        held, parts = state.get if state.exists else ([], 0)
        held, need = list(held), None
        for rows in batches:
            held += rows["row"].tolist()
            need = int(rows[size].iloc[0])
        if len(held) >= need:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"row": held, "parts": parts + 1})
        else:
            state.update((held, parts + 1))

    out = packed.groupBy(key).applyInPandasWithState(hold, "row string, parts int", "held array<string>, parts int", "append", GroupStateTimeout.NoTimeout)
    schema = StructType([fields[c] for c in names])
    return out.select(F.from_json("row", schema).alias("x"), "parts").select("x.*", "parts")


_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within have the state store that keyed state needs; what was set is restored."""
    name, wanted = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def whole_groups(stream: DataFrame, key: str, size: str, time: str, wait: str = "1 day", keep: str = "0 seconds") -> DataFrame:
    """The rows of whole groups, and of groups that waited too long: stream's columns, `parts` (batches it took) and `whole`.

    A group that comes whole in one batch goes straight out. Other rows are put into the group's list state when they come and are read once, when the group
    has as many as its column `size` says, so state and work grow with the rows. A timer is set behind the group's last row; if event time passes it by `wait`, what is held comes out with `whole` false, and
    the state is dropped. Rows that come later begin a group anew. `keep`: how long event time waits for rows that are late. Start the stream within keyed_state.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

    names = stream.columns
    schema = StructType([f for f in stream.schema.fields])
    waits = int(pd.Timedelta(wait) / pd.Timedelta("1ms"))

    class Group(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.rows = handle.getListState("rows", schema)
            self.facts = handle.getValueState("facts", "held bigint, parts int, last bigint")

        def handleInputRows(self, key, rows, timerValues):
            frames = list(rows)  # a batch's rows of one group
            begun = self.facts.exists()
            held, parts, last = self.facts.get() if begun else (0, 0, 0)
            held += sum(len(frame) for frame in frames)
            if begun:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            if held >= int(frames[-1][size].iloc[0]):  # what comes whole never is in the state
                before = [self.taken()] if begun else []
                yield pd.concat([*before, *frames], ignore_index=True).assign(parts=parts + 1, whole=True)
                return
            for frame in frames:
                last = max(last, int(frame[time].max().timestamp() * 1000))
                self.rows.appendList([tuple(x.to_pydatetime() if hasattr(x, "to_pydatetime") else x.item() if hasattr(x, "item") else x for x in row) for row in frame.itertuples(index=False, name=None)])
            self.facts.update((held, parts + 1, last))
            self.handle.registerTimer(last + waits)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.facts.exists():
                parts = self.facts.get()[1]
                yield self.taken().assign(parts=parts, whole=False)

        def taken(self):
            frame = pd.DataFrame([tuple(row) for row in self.rows.get()], columns=names)
            self.rows.clear()
            self.facts.clear()
            return frame

        def close(self):
            pass

    out = StructType([*schema.fields, StructField("parts", IntegerType()), StructField("whole", BooleanType())])
    return stream.withWatermark(time, keep).groupBy(key).transformWithStateInPandas(Group(), out, "Append", "eventTime")


def stopped_after(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], batches: int) -> int:
    """Take up to so many batches, then stop where a batch ends; the next run goes on there. Returns how many were taken."""
    taken = 0

    class _Enough(Exception):
        pass

    def run(batch: DataFrame, number: int) -> None:
        nonlocal taken
        if taken == batches:
            raise _Enough
        each(batch, number)
        taken += 1

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if taken < batches or "_Enough" not in str(query.exception()):
            raise
    return taken
