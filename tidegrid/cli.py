"""python -m tidegrid.cli clean|demand|neighbours|features ...: the library's steps over files."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import clean, panel, spatial
from .plans.pipeline import FeaturePipeline, save_features
from .operators.split import burn_in_split
from .session import session
from .sources import files
from .spec import CleaningConfig, ColumnMapping, FeatureConfig, PanelSpec


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidegrid")
    sub = top.add_subparsers(dest="step", required=True)
    c = sub.add_parser("clean", help="raw trips by month to cleaned trips")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--months", nargs="*")
    c.add_argument("--columns", nargs=4, metavar=("START", "END", "FROM", "TO"), default=["starttime", "stoptime", "start station id", "end station id"])
    c.add_argument("--trip-id")
    c.add_argument("--outliers", default="iqr", choices=["iqr", "zscore", "isolation_forest", "none"])
    d = sub.add_parser("demand", help="cleaned trips to a dense panel")
    d.add_argument("source")
    d.add_argument("target")
    d.add_argument("--freq", default="1h")
    d.add_argument("--least-daily-arrivals", type=float, default=0.0)
    n = sub.add_parser("neighbours", help="station points to adjacency lists")
    n.add_argument("source")
    n.add_argument("target")
    n.add_argument("--radius", type=float, required=True)
    f = sub.add_parser("features", help="a panel to features, split by time")
    f.add_argument("source")
    f.add_argument("target")
    f.add_argument("--groups", nargs="+", default=["station_id"])
    f.add_argument("--time", default="timestamp")
    f.add_argument("--values", nargs="+", default=["departures", "arrivals"])
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session()
    if a.step == "clean":
        frames, errors = files.load_months(spark, a.source, a.months)
        for month, why in errors.items():
            print(f"{month}: {why}")
        start, end, come, go = a.columns
        trips = clean.canonical_columns(frames["all"], ColumnMapping(start, end, come, go, trip_id=a.trip_id))
        trips = clean.parse_times(trips.withColumns({c: F.col(c).cast("string") for c in ("StartTime", "EndTime")}), ["StartTime", "EndTime"])
        done, audit = clean.clean_trips(trips, CleaningConfig(outliers=a.outliers))
        files.save_cleaned(done, a.target)
        audit.show(truncate=False)
    elif a.step == "demand":
        out = panel.demand_panel(spark.read.parquet(a.source), a.freq)
        out = panel.drop_low_demand(out, a.least_daily_arrivals) if a.least_daily_arrivals else out
        files.save(out, a.target, compression="gzip")
    elif a.step == "neighbours":
        stations = files.load_stations(spark, a.source)
        files.save_adjacency(spatial.adjacency_lists(stations, spatial.neighbours_within(stations, a.radius, "station_id"), "station_id"), a.target)
    else:
        df = burn_in_split(spark.read.parquet(a.source), a.time)
        spec = PanelSpec(tuple(a.groups), a.time, tuple(a.values))
        model = FeaturePipeline(FeatureConfig(spec)).fit(df.where("split = 'burn'").drop("split"))
        save_features(model.transform(df), a.target)


if __name__ == "__main__":
    main()
