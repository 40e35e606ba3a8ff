"""Event-time windows; the same plan runs on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", ts: str = "ts", by=("event_type",)) -> DataFrame:
    """(start, by, n, total) of each window; on a stream, rows later than `late` are left out and state is dropped.

    A timestamp without a zone is read as UTC, the session's zone: watermarks take no other kind.
    """
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark(ts, late)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return e.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def read_stream(spark, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, in bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what the stream has so far to path as Parquet and stop; a rerun goes on where it ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
