"""Views of the test tables as trips, panels and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event starts a trip of its user that ends at the user's next event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events", ["event_id", "user_id", "ts", "props"])
    station = F.get_json_object("props", "$.k").cast("long") % 24
    e = e.withColumn("station", station)
    return e.select(F.col("event_id").alias("TripId"), F.col("user_id").alias("UserId"), F.col("ts").alias("StartTime"), F.lead("ts").over(w).alias("EndTime"), F.col("station").alias("StartStationId"), F.lead("station").over(w).alias("EndStationId"))


def dirty_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to shipments: repeated ids, ends before starts."""
    o = read(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    li = read(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate"])
    both = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("TripId"), F.col("o_orderdate").alias("StartTime"), F.col("l_shipdate").alias("EndTime"), (F.col("l_suppkey") % 24).alias("StartStationId"), (F.col("l_partkey") % 24).alias("EndStationId"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and mean values by event type: district_id, timestamp, crowd, load."""
    e = read(spark, sf_dir, "events", ["event_type", "ts", "value"])
    return e.groupBy(F.col("event_type").alias("district_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp")).agg(F.count("*").alias("crowd"), F.bround(F.avg("value"), 4).alias("load"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return e.select(F.col("vec_id").alias("point_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


TRIPS_SQL = """trips AS (
  SELECT event_id AS TripId, user_id AS UserId, ts AS StartTime, lead(ts) OVER w AS EndTime,
         k % 24 AS StartStationId, lead(k % 24) OVER w AS EndStationId
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

CLEAN_SQL = TRIPS_SQL + """,
clean AS (
  SELECT *, floor(duration_seconds / 60) AS duration_minutes, floor(duration_seconds / 3600) AS duration_hours FROM (
    SELECT TripId, UserId, least(StartTime, EndTime) AS StartTime, greatest(StartTime, EndTime) AS EndTime, StartStationId, EndStationId,
           abs(epoch_us(EndTime) - epoch_us(StartTime)) / 1e6 AS duration_seconds
    FROM trips WHERE TripId IS NOT NULL AND StartTime IS NOT NULL AND EndTime IS NOT NULL AND StartStationId IS NOT NULL AND EndStationId IS NOT NULL)
  WHERE floor(duration_seconds / 60) BETWEEN 0.5 AND 1440)"""

DEMAND_SQL = CLEAN_SQL + """,
dep AS (SELECT date_trunc('hour', StartTime) AS timestamp, StartStationId AS station_id, count(*) AS departures FROM clean GROUP BY ALL),
arr AS (SELECT date_trunc('hour', EndTime) AS timestamp, EndStationId AS station_id, count(duration_minutes) AS arrivals,
               round_even(avg(duration_minutes), 2) AS avg_duration_minutes FROM clean GROUP BY ALL),
both_ AS (SELECT timestamp, station_id, coalesce(departures, 0) AS departures, coalesce(arrivals, 0) AS arrivals, coalesce(avg_duration_minutes, 0) AS avg_duration_minutes
          FROM dep FULL JOIN arr USING (timestamp, station_id)),
periods AS (SELECT unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp FROM both_),
demand AS (SELECT timestamp, station_id, coalesce(departures, 0)::BIGINT AS departures, coalesce(arrivals, 0)::BIGINT AS arrivals, coalesce(avg_duration_minutes, 0)::DOUBLE AS avg_duration_minutes
           FROM periods CROSS JOIN (SELECT DISTINCT station_id FROM both_) LEFT JOIN both_ USING (timestamp, station_id))"""

PANEL_SQL = """panel AS (SELECT event_type AS district_id, date_trunc('hour', ts) AS timestamp, count(*) AS crowd, round_even(avg(value), 4) AS load FROM events GROUP BY ALL)"""

DIRTY_SQL = """dirty AS (
  SELECT l_orderkey * 8 + l_linenumber AS TripId, o_orderdate AS StartTime, l_shipdate AS EndTime, l_suppkey % 24 AS StartStationId, l_partkey % 24 AS EndStationId
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
