"""What reports are made of: first and best rows, metrics by horizon, smoothed trials, aligned predictions, checks, sinks."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def first_rows(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The n first rows in the order of by: a limit on training rows. Ties at the end fall as the other columns order them."""
    return df.orderBy(*by, *[c for c in df.columns if c not in by]).limit(n)


def best_trials(df: DataFrame, n: int, value: str, *ties: str, largest: bool = False) -> DataFrame:
    """The n trials of the least, or largest, value; nulls never. Spark keeps n rows a task, and sorts no more."""
    order = F.col(value).desc() if largest else F.col(value).asc()
    return df.where(F.col(value).isNotNull()).orderBy(order, *ties).limit(n)


def by_horizon(df: DataFrame, index: str, horizon: str, value: str, horizons: list) -> DataFrame:
    """A row for each index, a column h_<horizon> for each horizon, with the mean value; null where there is none."""
    out = df.groupBy(index).pivot(horizon, horizons).agg(F.avg(value))
    return out.withColumnsRenamed({str(h): f"h_{h}" for h in horizons})


def centred_median(c: str, k: int, w: WindowSpec) -> Column:
    """The median of k rows around each; null where fewer are there or one is null."""
    frame = w.rowsBetween(-(k // 2), (k - 1) // 2)
    return F.when(F.count(c).over(frame) == k, F.percentile(c, F.lit(0.5)).over(frame))


def since_first(c: str, w: WindowSpec) -> Column:
    """Difference from the row before, 0 in the first: the time that each trial took of a running total."""
    return F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0).cast("double"))


def aligned(truth: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """Truth and predictions of the keys that both have; null keys match none."""
    return truth.join(predicted, list(keys))


def check_index(df: DataFrame, expected: Mapping[str, str]) -> None:
    """Raises where the frame doesn't have the expected key columns, of these types."""
    have = dict(df.dtypes)
    if missing := [c for c in expected if c not in have]:
        raise ValueError(f"missing key columns {missing}")
    if wrong := {c: have[c] for c, t in expected.items() if have[c] != t}:
        raise ValueError(f"key columns of another type {wrong}")


def env_variable(name: str, default: str | None = None, *, required: bool = False) -> str | None:
    """An environment variable, or the default; raises where a required one isn't set."""
    value = os.environ.get(name, default)
    if required and not value:
        raise ValueError(f"the environment variable {name} isn't set")
    return value


def check_settings(required: list[str], settings: Mapping) -> None:
    """Raises where required settings are missing or empty."""
    if missing := [k for k in required if settings.get(k) in (None, "")]:
        raise ValueError(f"missing settings {missing}")


def save_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_benchmark(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def save_bins(df: DataFrame, path: str) -> None:
    """Edges of demand levels, a JSON object a row."""
    df.write.mode("overwrite").json(path)


def trial_window(by: str = "trial", *groups: str) -> WindowSpec:
    return Window.partitionBy(*groups).orderBy(by)
