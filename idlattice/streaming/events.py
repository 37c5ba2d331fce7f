"""Windows over event streams: tumbling, sliding and session counts with watermarks, and duplicates dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh_path, remove

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream of the event files of a folder; ``ts`` becomes a timestamp, as watermarks need one."""
    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Events, least and largest value of each window and type; ``late``: how long a window waits for late events."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("largest")).select(F.col("w.start").alias("start"), "event_type", "n", "least", "largest")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Events of each user's session; a session ends after ``gap`` without events."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def without_duplicates(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event once, repeats recognised for as long as the watermark allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drain(frame: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and read its last result from a table in the shared folder.

    Each batch has a folder of its own, written over if the batch is run again, so that a retry repeats no rows; in
    complete mode the last one counts. The stream's state is removed at the end, the table when the driver ends.
    """
    spark = frame.sparkSession
    out, state = fresh_path(spark, "drained"), fresh_path(spark, "state")

    at = lambda number: out if mode == "complete" else f"{out}/batch={number}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(at(number))

    spark.createDataFrame([], frame.schema).write.parquet(at(-1))  # a source without events has no batch
    frame.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    remove(spark, state)
    return spark.read.schema(frame.schema).parquet(out).select(*[f"`{c}`" for c in frame.columns])
