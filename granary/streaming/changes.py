"""Change streams: bucketed counts of late data, and a subscriber that applies changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import apply_changes


def tumbling_counts(events: DataFrame, time: str, keys: list[str], size: str, late: str | None = None) -> DataFrame:
    """Rows and keys per window of ``size``; on a stream rows later than ``late`` are dropped. Batch and stream alike."""
    source = events.withWatermark(time, late) if late and events.isStreaming else events
    counted = source.groupBy(F.window(time, size).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n")


def subscribe(changes: DataFrame, path: str, keys: list[str], sequence: str, operation: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of changes to the table under ``path``: each batch writes the next version beside the last.

    Versions are folders named by batch, so a batch that is run again after a failure writes the same one.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = spark.read.parquet(f"{path}/{number}")
        apply_changes(table, batch, keys, sequence, operation).write.mode("overwrite").parquet(f"{path}/{number + 1}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
