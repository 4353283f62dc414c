"""Queries of cleaning, demand panels and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import derived_trip_columns, floor_time
from ..operators import clean, panel
from ..sources import tables
from ..sources.tables import CLEAN_SQL, DEMAND_SQL, DIRTY_SQL, TRIPS_SQL
from .register import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
#: Bounds wide enough for orders that ship years later.
LONG_MINUTES = 5_000_000.0


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return clean.fix_times(clean.drop_missing(tables.trips(spark, d)))


def _demand(spark: SparkSession, d: str) -> DataFrame:
    return panel.demand_panel(_clean(spark, d))


@query(f"WITH {DEMAND_SQL} SELECT * FROM demand")
def hourly_demand_dense(spark, d):
    return _demand(spark, d)


@query(f"WITH {DEMAND_SQL} SELECT * FROM both_")
def hourly_demand_sparse(spark, d):
    return panel.demand_panel(_clean(spark, d), dense=False)


@query(f"WITH {DEMAND_SQL} SELECT * FROM dep")
def departures_by_hour(spark, d):
    return panel.departures(_clean(spark, d))


@query(f"WITH {DEMAND_SQL} SELECT * FROM arr")
def arrivals_by_hour(spark, d):
    return panel.arrivals(_clean(spark, d))


@query(f"WITH {TRIPS_SQL} SELECT * FROM trips WHERE TripId IS NOT NULL AND NOT (StartTime IS NULL AND EndTime IS NULL) AND StartStationId IS NOT NULL AND EndStationId IS NOT NULL")
def clean_missing(spark, d):
    return clean.drop_missing(tables.trips(spark, d))


@query(f"""WITH {DIRTY_SQL}
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY TripId ORDER BY StartTime, EndTime, StartStationId, EndStationId) AS k FROM (SELECT DISTINCT * FROM dirty)) WHERE k = 1""")
def clean_dedup(spark, d):
    return clean.drop_duplicate_trips(tables.dirty_trips(spark, d))


@query(f"WITH {CLEAN_SQL} SELECT * FROM clean")
def clean_swap_bounds(spark, d):
    return _clean(spark, d)


@query(f"WITH {CLEAN_SQL} SELECT * FROM clean WHERE NOT (StartStationId = EndStationId AND duration_minutes < 30)")
def clean_round_trips(spark, d):
    return clean.drop_short_round_trips(_clean(spark, d), 30)


@query(f"""WITH {CLEAN_SQL}, q AS (SELECT quantile_cont(duration_minutes, 0.25) AS a, quantile_cont(duration_minutes, 0.75) AS b FROM clean)
SELECT clean.* FROM clean, q WHERE duration_minutes BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)""")
def outlier_iqr(spark, d):
    return clean.drop_outliers_iqr(_clean(spark, d), factor=0.5)


@query(f"""WITH {CLEAN_SQL}, q AS (SELECT avg(duration_minutes) AS m, stddev_samp(duration_minutes) AS s FROM clean)
SELECT clean.* FROM clean, q WHERE abs(duration_minutes - m) / nullif(s, 0) <= 1.5""")
def outlier_zscore(spark, d):
    return clean.drop_outliers_zscore(_clean(spark, d), most=1.5)


@query(f"""WITH {CLEAN_SQL}, q AS (SELECT quantile_cont(duration_minutes, 0.25) AS a, quantile_cont(duration_minutes, 0.75) AS b FROM clean)
SELECT TripId, greatest(least(duration_minutes, b), a) AS duration_minutes FROM clean, q""")
def outlier_cap(spark, d):
    return clean.cap_outliers(_clean(spark, d).select("TripId", "duration_minutes"), "duration_minutes")


@query(f"""WITH {CLEAN_SQL}, q AS (SELECT quantile_cont(duration_minutes, 0.25) AS a, quantile_cont(duration_minutes, 0.75) AS b FROM clean)
SELECT TripId, CASE WHEN duration_minutes BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a) THEN duration_minutes END AS duration_minutes FROM clean, q""")
def outlier_null(spark, d):
    return clean.null_outliers(_clean(spark, d).select("TripId", "duration_minutes"), "duration_minutes", 0.2)


@query()
def outlier_forest(spark, d):
    return clean.drop_outliers_forest(_clean(spark, d), clean.forest_features()).select("TripId", "duration_minutes")


_DERIVED = """SELECT TripId, hour(StartTime)::INTEGER AS StartHour, month(StartTime)::INTEGER AS StartMonth, year(StartTime)::INTEGER AS StartYear,
  (isodow(StartTime) - 1)::INTEGER AS StartDayOfWeek, (StartStationId = EndStationId)::INTEGER AS IsRoundTrip,
  CASE WHEN hour(StartTime) <= 6 THEN 'Night' WHEN hour(StartTime) <= 12 THEN 'Morning' WHEN hour(StartTime) <= 18 THEN 'Afternoon' ELSE 'Evening' END AS TimeCategory,
  CASE WHEN duration_minutes <= 15 THEN 'Short' WHEN duration_minutes <= 30 THEN 'Medium' WHEN duration_minutes <= 60 THEN 'Long' ELSE 'Very Long' END AS DurationCategory"""


@query(f"WITH {CLEAN_SQL} {_DERIVED} FROM clean")
def derived_features(spark, d):
    return _clean(spark, d).select("TripId", *[c.alias(n) for n, c in derived_trip_columns().items()])


@query(f"""WITH {CLEAN_SQL} SELECT bool_and(TripId IS NOT NULL) AS trip_ids_present, bool_and(StartTime IS NOT NULL AND EndTime IS NOT NULL) AS times_present,
bool_and(StartStationId IS NOT NULL AND EndStationId IS NOT NULL) AS stations_present, bool_and(EndTime >= StartTime) AS times_in_order, bool_and(EndTime - StartTime >= INTERVAL 0 SECOND) AS durations_positive,
bool_and(NOT (StartStationId = EndStationId AND duration_minutes < 3)) AS reasonable_round_trips, count(*) = (SELECT count(*) FROM (SELECT DISTINCT * FROM clean)) AS no_duplicates,
bool_and(duration_minutes BETWEEN 0.5 AND 1440) AS durations_in_bounds, count(*) > 0 AS has_rows, count(TripId) = count(DISTINCT TripId) AS unique_trip_ids FROM clean""")
def quality_checks(spark, d):
    return clean.quality_checks(_clean(spark, d))


@query(f"""WITH {CLEAN_SQL},
s AS (SELECT 0 AS place, 'input' AS step, count(*) AS remaining FROM trips
  UNION ALL SELECT 1, 'missing', count(*) FROM trips WHERE StartStationId IS NOT NULL AND EndStationId IS NOT NULL
  UNION ALL SELECT 2, 'duplicates', count(DISTINCT TripId) FROM trips WHERE StartStationId IS NOT NULL AND EndStationId IS NOT NULL
  UNION ALL SELECT 3, 'times', count(*) FROM clean
  UNION ALL SELECT 4, 'round_trips', count(*) FROM clean WHERE NOT (StartStationId = EndStationId AND duration_minutes < 3)
  UNION ALL SELECT 5, 'outliers', count(*) FROM clean, (SELECT quantile_cont(duration_minutes, 0.25) AS a, quantile_cont(duration_minutes, 0.75) AS b FROM clean WHERE NOT (StartStationId = EndStationId AND duration_minutes < 3))
    WHERE NOT (StartStationId = EndStationId AND duration_minutes < 3) AND duration_minutes BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))
SELECT step, remaining, coalesce(lag(remaining) OVER w - remaining, 0) AS removed, coalesce((lag(remaining) OVER w - remaining) * 100.0::DOUBLE / nullif(lag(remaining) OVER w, 0), 0) AS percentage
FROM s WINDOW w AS (ORDER BY place)""")
def cleaning_audit(spark, d):
    return clean.clean_trips(tables.trips(spark, d))[1]


@query(f"WITH {TRIPS_SQL} SELECT TripId, date_trunc('hour', StartTime) AS hour, time_bucket(INTERVAL 15 MINUTE, StartTime) AS quarter FROM trips")
def floor_periods(spark, d):
    t = tables.trips(spark, d)
    return t.select("TripId", floor_time(F.col("StartTime"), "1h").alias("hour"), floor_time(F.col("StartTime"), "15min").alias("quarter"))


@query(f"""WITH {DEMAND_SQL} SELECT station_id, sum(departures)::BIGINT AS departures_sum, round_even(avg(departures), 2) AS departures_mean, max(departures) AS departures_max,
sum(arrivals)::BIGINT AS arrivals_sum, round_even(avg(arrivals), 2) AS arrivals_mean, max(arrivals) AS arrivals_max, round_even(avg(avg_duration_minutes), 2) AS avg_duration_minutes_mean FROM demand GROUP BY station_id""")
def station_summary(spark, d):
    return panel.station_summary(_demand(spark, d))


@query(f"WITH {DEMAND_SQL} SELECT timestamp, sum(departures)::BIGINT AS departures, sum(arrivals)::BIGINT AS arrivals, round_even(avg(avg_duration_minutes), 2) AS avg_duration_minutes FROM demand GROUP BY timestamp")
def time_summary(spark, d):
    return panel.time_summary(_demand(spark, d))


@query(f"""WITH {DEMAND_SQL} SELECT count(*) AS n_rows, count(DISTINCT station_id) AS n_stations, count(DISTINCT timestamp) AS n_periods, min(timestamp) AS first_period, max(timestamp) AS last_period,
sum(departures)::BIGINT AS total_departures, sum(arrivals)::BIGINT AS total_arrivals FROM demand""")
def run_info(spark, d):
    return panel.run_info(_demand(spark, d))


@query(f"""WITH {DEMAND_SQL}, daily AS (SELECT station_id, timestamp::DATE AS day, sum(arrivals) AS s FROM demand GROUP BY ALL),
low AS (SELECT station_id FROM daily GROUP BY station_id HAVING avg(s) < 12)
SELECT * FROM demand WHERE station_id NOT IN (SELECT station_id FROM low)""")
def low_demand_filter(spark, d):
    return panel.drop_low_demand(_demand(spark, d), 12)


@query(f"""WITH {DEMAND_SQL} SELECT month(StartTime)::INTEGER AS month, nullif(count(*) FILTER (year(StartTime) = 2024), 0) AS y2024, nullif(count(*) FILTER (year(StartTime) = 2025), 0) AS y2025 FROM clean GROUP BY 1""")
def month_year_pivot(spark, d):
    return panel.cross_counts(_clean(spark, d), F.month("StartTime"), F.year("StartTime"), [2024, 2025], "month", "y")


@query(f"WITH {CLEAN_SQL} SELECT (isodow(StartTime) - 1)::INTEGER AS day, {', '.join(f'count(*) FILTER (hour(StartTime) = {h}) AS h{h}' for h in range(24))} FROM clean GROUP BY 1")
def dow_hour_crosstab(spark, d):
    return panel.cross_counts(_clean(spark, d), F.weekday("StartTime"), F.hour("StartTime"), list(range(24)), "day", "h", zero=True)


@query(f"""WITH {CLEAN_SQL}, c AS (SELECT (isodow(StartTime) - 1)::INTEGER AS day, hour(StartTime)::INTEGER AS hour, count(*) AS n FROM clean GROUP BY ALL)
SELECT day AS peak_day, hour AS peak_hour, n FROM c ORDER BY n DESC, day, hour LIMIT 1""")
def peak_cell(spark, d):
    c = _clean(spark, d).groupBy(F.weekday("StartTime").alias("day"), F.hour("StartTime").alias("hour")).agg(F.count("*").alias("n"))
    best = c.agg(F.max_by(F.struct("day", "hour", "n"), F.struct("n", -F.col("day"), -F.col("hour"))).alias("b"))
    return best.select(F.col("b.day").alias("peak_day"), F.col("b.hour").alias("peak_hour"), F.col("b.n").alias("n"))


@query(f"WITH {CLEAN_SQL} SELECT hour(StartTime)::INTEGER AS hour, count(*) AS n FROM clean GROUP BY 1")
def hourly_counts(spark, d):
    return _clean(spark, d).groupBy(F.hour("StartTime").alias("hour")).agg(F.count("*").alias("n"))


@query(f"""WITH {CLEAN_SQL}, f AS ({_DERIVED}, duration_minutes AS m, StartStationId, EndStationId, StartTime FROM clean)
SELECT count(m) AS count, avg(m) AS mean, stddev_samp(m) AS std, min(m) AS min, max(m) AS max, quantile_cont(m, 0.25) AS q25, quantile_cont(m, 0.5) AS q50, quantile_cont(m, 0.75) AS q75,
count(DISTINCT TripId) AS n_trips, count(DISTINCT StartStationId) AS n_start_stations, count(DISTINCT EndStationId) AS n_end_stations, sum(IsRoundTrip)::BIGINT AS round_trips, avg(IsRoundTrip) AS round_trip_share,
min(StartTime) AS first_start, max(StartTime) AS last_start,
(SELECT StartHour FROM f GROUP BY StartHour ORDER BY count(*) DESC, StartHour LIMIT 1) AS peak_hour, (SELECT StartDayOfWeek FROM f GROUP BY StartDayOfWeek ORDER BY count(*) DESC, StartDayOfWeek LIMIT 1) AS peak_day FROM f""")
def cleaning_report(spark, d):
    return panel.cleaning_report(clean.add_derived(_clean(spark, d)))


@query(f"""WITH {CLEAN_SQL}, s AS (SELECT min(duration_minutes) AS a, max(duration_minutes) AS b FROM clean),
c AS (SELECT least(floor((duration_minutes - a) * 30 / (b - a)), 29)::INTEGER AS bin, count(*) AS n FROM clean, s GROUP BY 1)
SELECT bin, n, n * 100.0::DOUBLE / sum(n) OVER () AS percent FROM c""")
def duration_histogram(spark, d):
    return panel.histogram(_clean(spark, d), "duration_minutes", 30)


@query("SELECT event_type AS district_id, date_trunc('hour', ts) AS timestamp, count(*) AS crowd FROM events WHERE event_type NOT IN ('view') GROUP BY ALL")
def valid_districts(spark, d):
    p = tables.panel(spark, d)
    return p.where(~F.lower("district_id").isin("view")).select("district_id", "timestamp", "crowd")


@query("SELECT count(*) AS n_rows, count(DISTINCT TripId) AS n_trips, sum(minutes)::DOUBLE AS minutes FROM (SELECT TripId, floor(abs(epoch_us(EndTime) - epoch_us(StartTime)) / 6e7) AS minutes FROM (SELECT *, row_number() OVER (PARTITION BY TripId ORDER BY StartTime, EndTime, StartStationId, EndStationId) AS k FROM (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS TripId, o_orderdate AS StartTime, l_shipdate AS EndTime, l_suppkey % 24 AS StartStationId, l_partkey % 24 AS EndStationId FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) WHERE k = 1) WHERE minutes BETWEEN 0.5 AND 5000000")
def clean_long_trips(spark, d):
    t = clean.fix_times(clean.drop_duplicate_trips(clean.drop_missing(tables.dirty_trips(spark, d))), high=LONG_MINUTES)
    return t.agg(F.count("*").alias("n_rows"), F.countDistinct("TripId").alias("n_trips"), F.sum("duration_minutes").alias("minutes"))
