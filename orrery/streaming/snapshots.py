"""Streams of results: running metric reports, a ledger without repeated entries, windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, time: str, kind: str, value: str, width: str, late: str) -> DataFrame:
    """Counts and sums per window and kind; events later than ``late`` after newer ones are left out on a stream."""
    seen = events.withWatermark(time, late) if events.isStreaming else events
    out = seen.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "total")


def running_report(results: DataFrame, kind: str, score: str) -> DataFrame:
    """Mean score and count by type so far (complete mode on a stream)."""
    return results.groupBy(kind).agg(F.avg(score).alias("mean"), F.count("*").alias("n"))


def ledger(entries: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Entries with the first of each identity only; state is kept as long as ``late`` allows."""
    if not entries.isStreaming:
        return entries.dropDuplicates(key)
    return entries.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def snapshots(report: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Runs ``write`` on the whole report at every trigger."""
    return report.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(write).start()
