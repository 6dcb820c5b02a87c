"""Streams of pages and page events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def page_events(events: DataFrame) -> DataFrame:
    """Recorded events as page events: errors are failed pages; the value is the duration."""
    kind = F.when(F.col("event_type") == "error", "page_failed").otherwise("page_completed")
    return events.select("event_id", "ts", F.col("user_id").alias("tenant"), kind.alias("event_type"), F.col("value").alias("duration_ms"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Page events by tumbling window and type; for a stream, with a watermark."""
    # Watermarks need instants; the windows are given back in the table's own kind of time.
    kind = events.schema["ts"].dataType
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"))
    return out.select(F.col("window.start").cast(kind).alias("start"), "event_type", "n", "total_ms")


def page_stream(spark: SparkSession, folder: str, schema: str, format: str = "parquet", max_files: int = 8) -> DataFrame:
    """A stream over a folder of pages; at most max_files files are under way in a micro-batch, the bound on work in flight."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", max_files).load(folder)


def run_pages(stream: DataFrame, process: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Starts a run page by page: each micro-batch goes through process, then to sink(batch, number); with a checkpoint, a new run goes on where the last one stopped."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: sink(process(batch), number)).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def processed(stream: DataFrame, process: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What a whole run over the stream yields, with the micro-batch each row came in; batches are written to the folder once each."""
    session = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is repeated after a failure replaces its own rows.
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    run_pages(stream, process, write, f"{folder}/checkpoint").awaitTermination()
    return session.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/*")
