"""Encodings, quotes, time formats, aliases, checks, rings and metrics against values written by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import clean, metrics, spatial
from tidegrid.sources import files


def test_encoding_is_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('name,n\ncafé,1\n"a ""b"", c",2\n'.encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("name,n\nnaïve,3\n".encode("latin-1"))
    got = {tuple(r) for r in files.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert got == {("café", "1"), ('a "b", c', "2"), ("naïve", "3")}
    (tmp_path / "c.csv").write_text('name,n\n"two\nlines",4\n')
    assert files.read_csv(spark, str(tmp_path / "c.csv"), multi_line=True).first()["name"] == "two\nlines"


def test_five_time_formats(spark):
    rows = ["2016-12-25 10:00:00", "12/25/2016 10:00:00", "2016-12-25 10:00:00.5", "2016-12-25T10:00:00", "25/12/2016 10:00:00", "nonsense", None]
    want = [datetime(2016, 12, 25, 10), datetime(2016, 12, 25, 10), datetime(2016, 12, 25, 10, 0, 0, 500_000), datetime(2016, 12, 25, 10), datetime(2016, 12, 25, 10), None, None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    assert [r["t"] for r in clean.parse_times(df, ["t"]).orderBy("i").collect()] == want
    for text, t in zip(rows[:5], want):
        assert clean.parse_times(df.where(F.col("t") == text), ["t"]).first()["t"] == t


def test_aliases():
    names = ["Departure_Time", "arrival_time", "origin_station_id", "destination_station_id", "restart_time_zone", "ride_id"]
    assert clean.suggest_columns(names) == {"StartTime": "Departure_Time", "EndTime": "arrival_time", "StartStationId": "origin_station_id", "EndStationId": "destination_station_id", "TripId": "ride_id"}


@pytest.mark.parametrize("row, failed", [((2, "A", "B", 0, 600), set()), ((1, "A", "B", 0, 600), {"no_duplicates", "unique_trip_ids"}), ((2, "A", "A", 0, 60), {"reasonable_round_trips"}), ((None, "A", "B", 0, 600), {"trip_ids_present"}), ((2, None, "B", 0, 600), {"stations_present"}), ((2, "A", "B", 600, 0), {"times_in_order", "durations_positive", "durations_in_bounds"})])
def test_quality_checks(spark, row, failed):
    df = spark.createDataFrame([(1, "A", "B", 0, 600), row], "TripId int, StartStationId string, EndStationId string, s long, e long")
    df = df.select("TripId", "StartStationId", "EndStationId", F.timestamp_seconds("s").alias("StartTime"), F.timestamp_seconds("e").alias("EndTime"), (F.col("e") - F.col("s")).alias("duration_seconds"), ((F.col("e") - F.col("s")) / 60).alias("duration_minutes"))
    assert {k for k, v in clean.quality_checks(df).first().asDict().items() if not v} == failed


def test_rings(spark):
    hole = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    two = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((8 8, 9 8, 9 9, 8 9, 8 8)))"
    polygons = spark.createDataFrame([("hole", hole), ("two", two)], "id string, w string").select("id", spatial.parse_polygon(F.col("w")).alias("ring"))
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.5, 0.5), (3, 8.5, 8.5), (4, 4.0, 5.0), (5, 20.0, 20.0)], "p int, x double, y double")
    got = {(r["p"], r["id"]) for r in spatial.points_in_polygons(points, polygons, 2.0).collect()}
    assert got == {(2, "hole"), (3, "hole"), (4, "hole"), (2, "two"), (3, "two")}
    assert {(r["a"], r["b"]) for r in spatial.polygon_neighbours(polygons, 2.0, "id").collect()} == {("hole", "two"), ("two", "hole")}
    with pytest.raises(Exception, match="not a polygon"):
        spark.createDataFrame([("LINESTRING (0 0, 1 1)",)], "w string").select(spatial.parse_polygon(F.col("w"))).collect()


def test_r2_at_large_offsets(spark):
    rows = [("g", 1e9 + k, 1e9 + k + (0.01 if k % 2 else -0.01)) for k in range(10)]
    got = metrics.regression_metrics(spark.createDataFrame(rows, "g string, y double, y_pred double"), ("g",)).first()
    assert got["r2"] == pytest.approx(1 - 10 * 1e-4 / 82.5, rel=1e-6)
