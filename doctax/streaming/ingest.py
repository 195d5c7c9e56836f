"""Extension: incremental ingestion and running statistics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_folder(spark, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_deliveries(rows: DataFrame, id_col: str, time_col: str, lateness: str = "30 days") -> DataFrame:
    """Each id once within the watermark: later deliveries of a known id are dropped."""
    return rows.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark([id_col])


def usage_by_window(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events and their mean value by type in tumbling windows; works on streams and on tables."""
    marked = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a finite stream gives, from memory; for tests and small folders."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
