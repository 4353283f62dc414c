"""Demand counts of a stream of trips, by event time with a watermark: the batch aggregates over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_counts(trips: DataFrame, time: str, station: str, freq: str = "1 hour", late: str = "2 hours", name: str = "departures") -> DataFrame:
    """timestamp, station_id and the count of each window; rows later than the watermark don't count."""
    events = trips.where(F.col(time).isNotNull() & F.col(station).isNotNull()).withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = events.groupBy(F.window("_t", freq), F.col(station).alias("station_id")).agg(F.count("*").alias(name))
    return out.select(F.col("window.start").alias("timestamp"), "station_id", name)
