"""Stage events as a stream: the latest state of each run, and, as an extension, counts in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", glob).parquet(folder)


def latest_state(events: DataFrame) -> DataFrame:
    """Per run (here user_id) its newest event; works on a stream in complete mode and on a table."""
    newest = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(newest.alias("s"), F.count("*").alias("n_events"), F.max("ts").alias("last_ts")).select("user_id", F.col("s.event_type").alias("state"), F.col("s.value").alias("value"), "n_events", "last_ts")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type in tumbling windows; a watermark bounds the state (an extension, no counterpart elsewhere)."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_once(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Drive a stream over what is there and return the result table."""
    w = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return df.sparkSession.table(name)
