"""Structured Streaming: ingest, windows, deduplication, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """A folder as a stream; files: how many a trigger takes at most."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """column as a timestamp with a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def windowed(df: DataFrame, time: str, width: str, slide: str | None, keys, **aggregates) -> DataFrame:
    """Tumbling or sliding windows; a late row counts while the watermark allows."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(w, *keys).agg(*[a.alias(n) for n, a in aggregates.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys, **aggregates) -> DataFrame:
    w = F.session_window(time, gap)
    return df.groupBy(w, *keys).agg(*[a.alias(n) for n, a in aggregates.items()]).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggregates)


def distinct_events(df: DataFrame, keys) -> DataFrame:
    """First row of each key within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, then stop; a restart goes on where the checkpoint ends."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert(df: DataFrame, key: str, path: str, checkpoint: str) -> None:
    """The first row of each key is appended, batch by batch.

    Which keys are there is state of the stream, kept with its checkpoint, so the target is never read again
    (set RocksDB as state store for many keys). A batch that is repeated after a failure replaces its own folder, `batch=<number>`.
    """

    def add(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.dropDuplicates([key]).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
