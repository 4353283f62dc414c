"""Trips to a dense panel of demand, and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import floor_time, freq_seconds, micros
from .order import quantiles, small


def departures(trips: DataFrame, freq: str = "1h") -> DataFrame:
    keys = trips.select(floor_time(F.col("StartTime"), freq).alias("timestamp"), F.col("StartStationId").alias("station_id")).na.drop()
    return keys.groupBy("timestamp", "station_id").agg(F.count("*").alias("departures"))


def arrivals(trips: DataFrame, freq: str = "1h") -> DataFrame:
    keys = trips.select(floor_time(F.col("EndTime"), freq).alias("timestamp"), F.col("EndStationId").alias("station_id"), F.col("duration_minutes").alias("d")).na.drop(subset=["timestamp", "station_id"])
    return keys.groupBy("timestamp", "station_id").agg(F.count("d").alias("arrivals"), F.bround(F.avg("d"), 2).alias("avg_duration_minutes"))


def densify(df: DataFrame, freq: str, time: str = "timestamp", group: str = "station_id", fill: dict | None = None) -> DataFrame:
    """Every period from the first to the last, for every group; periods are generated, not collected."""
    step = freq_seconds(freq) * 1_000_000
    span = df.agg(F.min(micros(F.col(time))).alias("a"), F.max(micros(F.col(time))).alias("b")).where("a IS NOT NULL")
    periods = span.select(F.explode(F.sequence("a", "b", F.lit(step))).alias("t")).select(F.timestamp_micros("t").cast("timestamp_ntz").alias(time))
    grid = df.select(group).where(F.col(group).isNotNull()).distinct().crossJoin(small(periods))  # a grid: all groups at all periods
    out = grid.join(df, [time, group], "left")
    return out.na.fill(fill) if fill else out


def demand_panel(trips: DataFrame, freq: str = "1h", dense: bool = True) -> DataFrame:
    """timestamp, station_id, departures, arrivals, avg_duration_minutes; 0 where nothing happened."""
    both = departures(trips, freq).join(arrivals(trips, freq), ["timestamp", "station_id"], "full_outer")
    zeros = {"departures": 0, "arrivals": 0, "avg_duration_minutes": 0.0}
    both = both.na.fill(zeros)
    return (densify(both, freq, fill=zeros) if dense else both).select("timestamp", "station_id", "departures", "arrivals", "avg_duration_minutes")


def station_summary(panel: DataFrame) -> DataFrame:
    stats = [f(c).alias(f"{c}_{n}") for c in ("departures", "arrivals") for n, f in (("sum", F.sum), ("mean", lambda c: F.bround(F.avg(c), 2)), ("max", F.max))]
    return panel.groupBy("station_id").agg(*stats, F.bround(F.avg("avg_duration_minutes"), 2).alias("avg_duration_minutes_mean"))


def time_summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy("timestamp").agg(F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals"), F.bround(F.avg("avg_duration_minutes"), 2).alias("avg_duration_minutes"))


def run_info(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("n_rows"), F.countDistinct("station_id").alias("n_stations"), F.countDistinct("timestamp").alias("n_periods"), F.min("timestamp").alias("first_period"), F.max("timestamp").alias("last_period"), F.sum("departures").alias("total_departures"), F.sum("arrivals").alias("total_arrivals"))


def drop_low_demand(panel: DataFrame, least: float, value: str = "arrivals", time: str = "timestamp", group: str = "station_id") -> DataFrame:
    """Groups whose mean daily sum is below least go, with all their rows."""
    daily = panel.where(F.col(time).isNotNull() & F.col(group).isNotNull()).groupBy(group, F.to_date(time).alias("_day")).agg(F.sum(value).alias("_sum"))
    low = daily.groupBy(group).agg(F.avg("_sum").alias("_mean")).where(F.col("_mean") < least).select(group)
    return panel.join(low, group, "left_anti")


def crowd_series(points: DataFrame, keys: tuple[str, ...] = ("district_id", "city", "timestamp"), point: str = "point_id") -> DataFrame:
    return points.groupBy(*keys).agg(F.count(point).alias("crowd"))


def cross_counts(df: DataFrame, row: Column, column: Column, values: list, row_name: str, prefix: str, zero: bool = False) -> DataFrame:
    """Counts by row and column, one output column for each of the values, which are given: no pass to find them."""
    counts = [F.count(F.when(column == v, 1)) for v in values]
    if not zero:
        counts = [F.when(c > 0, c) for c in counts]
    return df.groupBy(row.alias(row_name)).agg(*[c.alias(f"{prefix}{v}") for c, v in zip(counts, values)])


def cleaning_report(trips: DataFrame) -> DataFrame:
    d = "duration_minutes"
    quarters = quantiles(trips, {"_q": F.col(d)}, (0.25, 0.5, 0.75)).select(*[F.element_at("_q", i + 1).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
    one = trips.agg(
        F.count(d).alias("count"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"),
        F.countDistinct("TripId").alias("n_trips"), F.countDistinct("StartStationId").alias("n_start_stations"), F.countDistinct("EndStationId").alias("n_end_stations"),
        F.sum("IsRoundTrip").alias("round_trips"), F.avg("IsRoundTrip").alias("round_trip_share"), F.min("StartTime").alias("first_start"), F.max("StartTime").alias("last_start"),
        F.mode("StartHour", True).alias("peak_hour"), F.mode("StartDayOfWeek", True).alias("peak_day"),
    )
    return one.crossJoin(F.broadcast(quarters))  # one row each


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """bin (from 0), n, percent, over equal bins from the least to the greatest value, the last one closed."""
    span = df.agg(F.min(c).alias("_a"), F.max(c).alias("_b"))
    at = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col(c) - F.col("_a")) * bins / F.when(F.col("_b") > F.col("_a"), F.col("_b") - F.col("_a"))), F.lit(bins - 1))).otherwise(0)
    counts = df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") * 100.0 / F.col("_t")).alias("percent"))
