"""Incremental runs: what is not done yet, and a file stream that handles what has come since the last run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def remaining(todo: DataFrame, log: DataFrame, key: str, retry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of todo whose key the log doesn't have with a final status; statuses in retry are tried again."""
    done = log.filter(~F.col("status").isin(*retry)) if retry else log
    return todo.join(done.select(key).distinct(), key, "left_anti")


def run_new_files(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Apply step to the JSON-lines files that have come since the last run and append the result; a batch that is run again
    after a failure replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and kind; on a stream, windows close once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"))


def progress(log: DataFrame, step: str, cost: str) -> DataFrame:
    """Completions and their cost so far by step; the same whatever order they came in, on a stream as on a table."""
    return log.groupBy(step).agg(F.count("*").alias("done"), F.sum(cost).alias("cost"))
