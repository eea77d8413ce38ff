"""Reports over a stream of arriving snapshots, and sliding windows over samples."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: seconds between two runs of the monitor.
MONITOR_SECONDS = 30


def stream_monitor(
    snapshots: DataFrame, reports: Mapping[str, Callable[[DataFrame], DataFrame]], folder: str, checkpoint: str,
    seconds: int | None = MONITOR_SECONDS,
):
    """Runs every report on each arriving snapshot and keeps the results by report and batch."""
    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, report in reports.items():
                report(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            batch.unpersist()

    writer = snapshots.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def sliding_hour(samples: DataFrame, ts: str, keys: list[str], measure: str, late: str = "10 minutes") -> DataFrame:
    """Samples and their sum per key over the last hour, moved on every five minutes; streams and tables alike."""
    # Event time on a stream must be a timestamp with zone; the windows are given back without one.
    rows = samples.withColumn(ts, F.col(ts).cast("timestamp"))
    if samples.isStreaming:
        rows = rows.withWatermark(ts, late)
    # Five-minute sums first: these, not the samples, are then copied to the twelve hours they lie in.
    short = rows.groupBy(F.window(ts, "5 minutes").alias("_s"), *keys).agg(F.count("*").alias("samples"), F.sum(measure).alias(measure))
    hours = short.groupBy(F.window(F.window_time("_s"), "1 hour", "5 minutes").alias("_w"), *keys)
    sums = hours.agg(F.sum("samples").alias("samples"), F.sum(measure).alias(measure))
    return sums.select(
        F.col("_w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("_w.end").cast("timestamp_ntz").alias("window_end"), *keys, "samples", measure,
    )
