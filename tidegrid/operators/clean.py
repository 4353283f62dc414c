"""Cleaning of trip records. Each step takes and gives a DataFrame; clean_trips() chains them with an audit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clip, derived_trip_columns, seconds_between
from ..spec import CleaningConfig, ColumnMapping
from ..storage import written
from .order import quantiles

REQUIRED = ("StartTime", "EndTime", "StartStationId", "EndStationId")
#: Formats that whole columns are tried with, in this order.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss")
#: What else a value that fits none of them is tried with.
OTHER_FORMATS = ("MM/dd/yyyy HH:mm",)
#: Names by which a source column is proposed for a canonical one.
ALIASES = {
    "StartTime": ("start_time", "starttime", "start_datetime", "departure_time", "trip_start_time", "begin_time", "started_at"),
    "EndTime": ("end_time", "endtime", "stoptime", "end_datetime", "arrival_time", "trip_end_time", "finish_time", "ended_at"),
    "StartStationId": ("start_station_id", "startstation", "start_station", "origin_station_id", "from_station_id", "departure_station_id"),
    "EndStationId": ("end_station_id", "endstation", "end_station", "destination_station_id", "to_station_id", "arrival_station_id"),
    "TripId": ("trip_id", "tripid", "ride_id", "journey_id", "trip_number", "id"),
}


def suggest_columns(columns: list[str]) -> dict[str, str]:
    """For each canonical name the column that has its first alias there is, whatever the case."""
    out = {}
    for name, aliases in ALIASES.items():
        hit = next((c for p in aliases for c in columns if p == c.lower()), None)
        if hit:
            out[name] = hit
    return out


def canonical_columns(df: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """Renames to canonical names; raises for missing ones, naming what might be meant."""
    renames = mapping.renames()
    needed = [mapping.start_time, mapping.end_time, mapping.start_station, mapping.end_station]
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; did you mean {suggest_columns(df.columns)}?")
    return df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def parse_times(df: DataFrame, columns: list[str], formats: tuple[str, ...] = TIME_FORMATS) -> DataFrame:
    """Each column by the first format that fits all of it, else value by value by the first that fits; others become null."""
    text = [c for c in columns if dict(df.dtypes)[c] == "string"]
    if not text:
        return df
    failed = lambda c, f: F.sum((F.col(c).isNotNull() & F.try_to_timestamp(F.col(c), F.lit(f)).isNull()).cast("long"))
    found = df.agg(*[failed(c, f).alias(f"{c}|{i}") for c in text for i, f in enumerate(formats)]).first().asDict()
    out = {}
    for c in text:
        whole = next((f for i, f in enumerate(formats) if not found[f"{c}|{i}"]), None)
        tries = [F.try_to_timestamp(F.col(c), F.lit(f)) for f in ([whole] if whole else formats)]
        out[c] = F.coalesce(*tries, *([] if whole else [*[F.try_to_timestamp(F.col(c), F.lit(f)) for f in OTHER_FORMATS], F.try_to_timestamp(F.col(c))]))
    return df.withColumns(out)


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows without a trip id, without both times, or without either station; then columns that hold nothing are for drop_empty_columns()."""
    if "TripId" in df.columns:
        df = df.na.drop(subset=["TripId"])
    return df.na.drop(how="all", subset=["StartTime", "EndTime"]).na.drop(how="any", subset=["StartStationId", "EndStationId"])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """One pass counts all columns; those without a value go."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if not counts[i]])


def drop_duplicate_trips(df: DataFrame, key: str = "TripId", order: tuple[str, ...] = ("StartTime",)) -> DataFrame:
    """Equal rows once; of rows with one key, the first in the given order, ties by the other columns. Rows without a key all stay."""
    if key not in df.columns:
        return df.distinct()
    rest = [c for c in df.columns if c not in (key, *order)]
    # One shuffle, after the least row of each task: a row without a key is a group of its own, with its equals.
    row = F.struct(*order, *rest)
    least = df.groupBy(key, F.when(F.col(key).isNull(), row).alias("_row")).agg(F.min(row).alias("_least"))
    return least.select(key, "_least.*").select(*df.columns)


def add_durations(df: DataFrame) -> DataFrame:
    seconds = seconds_between(F.col("StartTime"), F.col("EndTime"))
    return df.withColumns({"duration_seconds": seconds, "duration_minutes": F.floor(seconds / 60).cast("double"), "duration_hours": F.floor(seconds / 3600).cast("double")})


def fix_times(df: DataFrame, low: float = 0.5, high: float = 1440.0) -> DataFrame:
    """Swaps times that stand the wrong way round, then keeps durations within bounds, in whole minutes."""
    swap = F.col("EndTime") < F.col("StartTime")
    df = df.withColumns({"StartTime": F.when(swap, F.col("EndTime")).otherwise(F.col("StartTime")), "EndTime": F.when(swap, F.col("StartTime")).otherwise(F.col("EndTime"))})
    return add_durations(df).where((F.col("duration_seconds") >= 0) & F.col("duration_minutes").between(low, high))


def drop_short_round_trips(df: DataFrame, minutes: float = 3.0) -> DataFrame:
    short = (F.col("StartStationId") == F.col("EndStationId")) & (F.col("duration_minutes") < minutes)
    return df.where(~F.coalesce(short, F.lit(False)))


def _with_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(bounds))  # one row


def iqr_bounds(df: DataFrame, c: str, factor: float = 1.5, lower: float = 0.25, upper: float = 0.75) -> DataFrame:
    q = quantiles(df, {"q": F.col(c)}, (lower, upper))
    a, b = F.element_at("q", 1), F.element_at("q", 2)
    return q.select((a - factor * (b - a)).alias("_low"), (b + factor * (b - a)).alias("_high"), a.alias("_q1"), b.alias("_q3"))


def drop_outliers_iqr(df: DataFrame, c: str = "duration_minutes", factor: float = 1.5) -> DataFrame:
    return _with_bounds(df, iqr_bounds(df, c, factor)).where(F.col(c).between(F.col("_low"), F.col("_high"))).drop("_low", "_high", "_q1", "_q3")


def drop_outliers_zscore(df: DataFrame, c: str = "duration_minutes", most: float = 3.0) -> DataFrame:
    """Where all values are equal no score exists and no row stays."""
    stats = df.agg(F.avg(c).alias("_mean"), F.stddev_samp(c).alias("_std"))
    score = F.abs(F.col(c) - F.col("_mean")) / F.when(F.col("_std") != 0, F.col("_std"))
    return _with_bounds(df, stats).where(score <= most).drop("_mean", "_std")


def null_outliers(df: DataFrame, c: str, factor: float = 1.5) -> DataFrame:
    inside = F.col(c).between(F.col("_low"), F.col("_high"))
    return _with_bounds(df, iqr_bounds(df, c, factor)).withColumn(c, F.when(inside, F.col(c))).drop("_low", "_high", "_q1", "_q3")


def cap_outliers(df: DataFrame, c: str, lower: float = 0.25, upper: float = 0.75) -> DataFrame:
    """Values beyond the percentiles become the percentiles."""
    return _with_bounds(df, iqr_bounds(df, c, 1.5, lower, upper)).withColumn(c, clip(F.col(c), F.col("_q1"), F.col("_q3"))).drop("_low", "_high", "_q1", "_q3")


class IsolationForest:
    """Isolation trees (Liu, Ting and Zhou 2008) as arrays; fitted on a bounded sample, scored in batches."""

    def __init__(self, trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42) -> None:
        self.n_trees, self.sample, self.contamination, self.seed = trees, sample, contamination, seed
        self.trees: list[list[tuple]] = []
        self.threshold = 0.0

    @staticmethod
    def _path(n: float) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(x))
        depth = int(np.ceil(np.log2(max(size, 2))))

        def grow(rows: np.ndarray, d: int, nodes: list[tuple]) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, -1, -1, d + self._path(len(rows))))
            span = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(x.shape[1])
            if d < depth and len(rows) > 1 and span.any():
                f = int(rng.choice(np.flatnonzero(span)))
                cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
                left = rows[:, f] < cut
                nodes[at] = (f, cut, grow(rows[left], d + 1, nodes), grow(rows[~left], d + 1, nodes), 0.0)
            return at

        for _ in range(self.n_trees):
            nodes: list[tuple] = []
            grow(x[rng.choice(len(x), size, replace=False)], 0, nodes)
            self.trees.append(nodes)
        self.norm = self._path(size) or 1.0
        self.threshold = float(np.quantile(self.score(x), 1 - self.contamination))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for nodes in self.trees:
            f, cut, left, right, length = (np.array(c) for c in zip(*nodes))
            at = np.zeros(len(x), int)
            while (f[at] >= 0).any():
                inner = np.flatnonzero(f[at] >= 0)
                k = at[inner]
                at[inner] = np.where(x[inner, f[k]] < cut[k], left[k], right[k])
            total += length[at]
        return 2 ** (-total / len(self.trees) / self.norm)


def drop_outliers_forest(df: DataFrame, features: dict[str, Column], contamination: float = 0.1, sample: int = 20_000, seed: int = 42, id_col: str = "TripId") -> DataFrame:
    """Rows that an isolation forest scores as outliers; a null counts as -1.

    Its trees are fitted on rows drawn by the hash of their id (of all columns where there is none), so equal
    values are drawn as often as they occur. All rows are scored; the threshold is the quantile of all scores.
    """
    inputs = [F.coalesce(c.cast("double"), F.lit(-1.0)) for c in features.values()]
    hashed = F.xxhash64(*([id_col] if id_col in df.columns else df.columns))
    # A bound on the hashes leaves about 1.2 times the sample, of which the least are taken: no partition sends a sample's worth of rows.
    share = 1.2 * sample / max(1, df.count())
    some = df if share >= 1 else df.where(hashed.cast("double") / 2.0**64 + 0.5 < share)
    drawn = some.select(hashed.alias("h"), *[c.alias(str(i)) for i, c in enumerate(inputs)])
    x = drawn.orderBy(*drawn.columns).limit(sample).drop("h").toPandas().to_numpy()
    if not len(x):
        return df
    forest = IsolationForest(contamination=contamination, seed=seed).fit(x)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(forest.score(np.column_stack(cols)))

    scored = written(df.withColumn("_score", score(*inputs)), "scored")
    most = quantiles(scored, {"_most": F.col("_score")}, (1 - contamination,)).select(F.get("_most", 0).alias("_most"))
    return scored.crossJoin(F.broadcast(most)).where("_score <= _most").drop("_score", "_most")


def forest_features() -> dict[str, Column]:
    code = lambda c: F.xxhash64(F.col(c)) % 1024
    return {"minutes": F.col("duration_minutes"), "from": code("StartStationId"), "to": code("EndStationId"), "hour": F.hour("StartTime")}


def add_derived(df: DataFrame) -> DataFrame:
    return df.withColumns(derived_trip_columns())


def quality_checks(df: DataFrame, low: float = 0.5, high: float = 1440.0, least_round_trip: float = 3.0) -> DataFrame:
    """One row of checks that cleaned trips pass, in one pass but for repeated ids and rows. No rows pass all but has_rows."""
    good = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    named = "TripId" in df.columns
    ids = df.agg((F.count("TripId") == F.countDistinct("TripId")).alias("unique_trip_ids")) if named else df.sparkSession.range(1).select(F.lit(True).alias("unique_trip_ids"))
    again = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg((F.coalesce(F.max("_n"), F.lit(1)) == 1).alias("no_duplicates"))
    checks = df.agg(
        good(F.col("TripId").isNotNull() if named else F.lit(True)).alias("trip_ids_present"),
        good(F.col("StartTime").isNotNull() & F.col("EndTime").isNotNull()).alias("times_present"),
        good(F.col("StartStationId").isNotNull() & F.col("EndStationId").isNotNull()).alias("stations_present"),
        good(F.col("EndTime") >= F.col("StartTime")).alias("times_in_order"),
        good(F.col("duration_seconds") >= 0).alias("durations_positive"),
        good(F.col("duration_minutes").between(low, high)).alias("durations_in_bounds"),
        good(~((F.col("StartStationId") == F.col("EndStationId")) & (F.col("duration_minutes") < least_round_trip))).alias("reasonable_round_trips"),
        (F.count("*") > 0).alias("has_rows"),
    )
    return checks.crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(again))  # a row each


def audit(spark: SparkSession, counts: list[tuple[str, int]]) -> DataFrame:
    """step, remaining, removed, percentage removed, of successive steps and the rows that they left."""
    rows, before = [], None
    for step, n in counts:
        gone = 0 if before is None else before - n
        rows.append((step, n, gone, gone * 100.0 / before if before else 0.0))
        before = n
    return spark.createDataFrame(rows, "step string, remaining long, removed long, percentage double")


def clean_steps(df: DataFrame, config: CleaningConfig = CleaningConfig(), watch: Callable[[str, DataFrame], DataFrame] = lambda name, out: out) -> list[tuple[str, DataFrame]]:
    """The frame after each step; the next one goes on from what watch makes of it."""
    steps = [("input", watch("input", df))]
    add = lambda name, out: steps.append((name, watch(name, out)))
    add("missing", drop_missing(steps[-1][1]))
    add("duplicates", drop_duplicate_trips(steps[-1][1]))
    add("times", fix_times(steps[-1][1], config.min_minutes, config.max_minutes))
    add("round_trips", drop_short_round_trips(steps[-1][1], config.min_round_trip_minutes))
    last = steps[-1][1]
    outliers = {"iqr": lambda: drop_outliers_iqr(last, factor=config.iqr_factor), "zscore": lambda: drop_outliers_zscore(last, most=config.max_z), "isolation_forest": lambda: drop_outliers_forest(last, forest_features(), config.contamination), "none": lambda: last}
    add("outliers", outliers[config.outliers]())
    return steps


def clean_trips(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> tuple[DataFrame, DataFrame]:
    """Cleaned trips with derived columns, evaluated, and the audit of what each step removed.

    Rows are counted between the steps as they pass, by observations of the one run that writes the trips (or finds the bounds of
    outliers). Where a lost executor's work is done again, rows can count twice in the audit, never in the trips.
    """
    seen: dict[str, Observation] = {}

    def watch(name: str, out: DataFrame) -> DataFrame:
        seen[name] = Observation()
        return out.observe(seen[name], F.count(F.lit(1)).alias("n"))

    done = written(add_derived(clean_steps(df, config, watch)[-1][1]), "trips")
    return done, audit(df.sparkSession, [(name, o.get["n"]) for name, o in seen.items()])
