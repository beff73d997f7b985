"""Structured Streaming over telemetry: an addition of this engine, with the batch queries' results on closed windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_at_once: int | None = None) -> DataFrame:
    """Events as a stream of files. Watermarks need a timestamp with a zone, so ``ts`` becomes one."""
    reader = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "event_type", "n")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, remembered as long as the watermark allows repeats."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_counts(events: DataFrame) -> DataFrame:
    """Each user's number of events so far, kept in state: what each batch adds is a row."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(map(len, batches))
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(add, "user_id long, n long", "n long", "update", "NoTimeout")


def collect(stream: DataFrame, mode: str, checkpoint: str, path: str) -> None:
    """Run a stream over all that is there now, appending its rows as Parquet by ``foreachBatch``, and stop."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")  # repeated batches replace themselves

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
