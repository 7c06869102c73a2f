"""Windowed popularity over an event stream: an extension, the batch form of which is the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _stamped(events: DataFrame, late: str) -> DataFrame:
    """A stream needs a zoned time for its watermark; a batch keeps the time as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour", value: str = "value") -> DataFrame:
    """(start, event_type, n, total, users): events per window and type.

    Rows later than ``late`` are dropped in a stream; in a batch nothing is late. Users are counted approximately, as an exact distinct
    count has no bounded state.
    """
    stamped = _stamped(events, late)
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stamped.groupBy(win.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"), F.approx_count_distinct("user_id", 0.02).alias("users")).select(F.col("w.start").alias("start"), "event_type", "n", "total", "users")


def start(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows to Parquet, each exactly once; runs over what is there, then ends."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a pause of ``gap``."""
    stamped = _stamped(events, late)
    return stamped.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
