"""Streams: sessions, windows, first-seen rows, and batch-wise packing of new documents.

These have the gap merge, the grid, the keep-first and the skip-if-done operators as
their batch counterparts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.chunks import pack_lines


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes", by: str = "user_id", at: str = "ts") -> DataFrame:
    """Runs of events of one key whose gaps are shorter than ``gap``: start, end, count, sum of value."""
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
    return rows.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "value")


def windowed(events: DataFrame, length: str = "1 hour", step: str | None = None, late: str = "10 minutes", by: str = "event_type", at: str = "ts") -> DataFrame:
    """Counts and sums by sliding (or, without ``step``, tumbling) windows."""
    rows = events.withWatermark(at, late).groupBy(F.window(at, length, step or length).alias("w"), by).agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
    return rows.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "value")


def first_seen(rows: DataFrame, by: list[str], at: str = "ts", late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(by)


def pack_new(docs: DataFrame, out: str, checkpoint: str, max_lines: int = 12, max_chars: int = 800) -> StreamingQuery:
    """Packs documents that arrived since the last run, then stops: a rerun skips what is done."""
    return pack_lines(docs, max_lines=max_lines, max_chars=max_chars).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
