"""Streaming ingest: hit lines as they arrive, rejects apart, and counts or sessions by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.operators.malformed import parse_lines


def read_line_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    """A stream of Parquet files of lines (line_id, file_name, line_no, raw_line, read_at)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def parsed_stream(lines: DataFrame) -> DataFrame:
    """line_id, reason, fields of the data lines of a stream; the batch parser works on streams unchanged."""
    return parse_lines(lines)


def start_split(lines: DataFrame, hits_path: str, rejects_path: str, checkpoint: str, available_now: bool = True):
    """Writes sound lines and rejects of every micro-batch to two Parquet folders, each batch once.

    A batch's folder is named by its number and overwritten, so a batch that is run again after a failure leaves no
    rows twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_lines(batch).persist()
        parsed.where("reason is null").select("line_id", "fields").write.mode("overwrite").parquet(f"{hits_path}/batch={number}")
        parsed.where("reason is not null").select("line_id", "reason").write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")
        parsed.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n): rows a tumbling window and key; rows later than `late` behind the newest are dropped."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, first, last, n): event-time sessions; `last` is the end of the window, the last event plus the gap."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")
