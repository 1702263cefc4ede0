"""Incremental runs as streams: new documents are processed once, whatever the number of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, file_format: str = "parquet", **options: str) -> None:
    """Apply ``transform`` to the files of ``source`` that no earlier run with this checkpoint has read, append the result, and stop; ``options`` are those of the reader."""
    stream = spark.readStream.schema(schema).format(file_format).options(**options).load(source)
    transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Events by time window and keys, batch or stream; a stream forgets windows older than the watermark."""
    base = events.withWatermark(time, late) if events.isStreaming else events
    return base.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), *keys, "n_events")


def windows_to_files(spark: SparkSession, source: str, schema: str, time: str, width: str, late: str, out: str, checkpoint: str, *keys: str, file_format: str = "parquet", **options: str) -> None:
    """Windowed counts of the new files of ``source``, each window being appended once it is older than the watermark.

    Events that come later than that are dropped, as their windows are final; state outlives the run in the checkpoint.
    """
    stream = spark.readStream.schema(schema).format(file_format).options(**options).load(source)
    counted = windowed_counts(stream, time, width, late, *keys)
    counted.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
