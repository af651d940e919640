"""The event log as a stream: windows with late data, and the current state of each key.

Spark's own stateful operators do the work; the batch operators give the same rows over the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyframe.sources import scratch


def read_events(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Event files as a stream: the Parquet file, or the files in the folder, of that name. ts becomes a timestamp, which a watermark needs."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        rows = reader.parquet(f"{folder}/{name}")
    else:  # a stream is read from a folder
        rows = reader.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines as a stream; blank lines are left out."""
    return spark.readStream.schema(schema).json(path)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


class Latest(StatefulProcessor):
    """Keeps of each key the event with the largest (time, id), and the count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "ts timestamp, event_id long, event_type string, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        for pdf in rows:
            top = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            n = len(pdf) + (last[3] if last else 0)
            if last is None or (top.ts, top.event_id) > (pd.Timestamp(last[0]), last[1]):
                last = (top.ts.to_pydatetime(), int(top.event_id), top.event_type, n)
            else:
                last = (*last[:3], n)
        self.state.update(last)
        yield pd.DataFrame({"user_id": [key[0]], "ts": [last[0]], "event_id": [last[1]], "event_type": [last[2]], "events": [last[3]]})

    def close(self) -> None:
        pass


def latest_state(events: DataFrame) -> DataFrame:
    """The current state of each user, updated with every batch."""
    return events.groupBy("user_id").transformWithStateInPandas(Latest(), "user_id long, ts timestamp, event_id long, event_type string, events long", "Update", "none")


def drained(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """What a stream gives once it has read all that is there, as a table in the shared folder.

    folder: that of an earlier call goes on where it ended; the table then holds what both gave.

    Every batch is written under its number, so one that is run again replaces itself; of a complete output the last counts."""
    spark, out = stream.sparkSession, folder or scratch.folder(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/log").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/table")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], stream.schema)
    found = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{out}/table")
    if mode == "complete":
        found = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.drop("batch")
