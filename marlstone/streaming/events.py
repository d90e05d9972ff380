"""Extras over the event stream: windows with late data, and an idempotent sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.tables import append_new


def stamped(events: DataFrame) -> DataFrame:
    """Event time as an instant: watermarks take no zone-free time."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(event_type, start, n, total) by tumbling hour; streams drop what is later than the watermark."""
    e = stamped(events)
    e = e.withWatermark("ts", late) if events.isStreaming else e
    out = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "total")


def append_each_batch(events: DataFrame, path: str, checkpoint: str, key: str = "event_id"):
    """Write a stream so that a batch run twice adds nothing the second time."""
    return events.writeStream.foreachBatch(lambda df, _: append_new(df, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
