"""Splits by time: by row-weighted quantiles, by unique times, by position. All leave one frame with a column more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import micros
from .order import positions, quantiles, small, with_rank


def time_quantiles(df: DataFrame, time: str, shares: list[float]) -> DataFrame:
    """One row: the times, in microseconds, below which such shares of rows lie, interpolated."""
    q = quantiles(df, {"q": micros(F.col(time))}, shares)
    return q.select(*[F.element_at("q", i + 1).alias(f"_q{i}") for i in range(len(shares))])


def quantile_split(df: DataFrame, time: str, test: float = 0.2, val: float | None = None) -> DataFrame:
    """split: train up to the cut, then val, then test."""
    if not 0 < test < 1 or val is not None and not 0 < val < 1 - test:
        raise ValueError("shares lie between 0 and 1 and leave something to train on")
    shares = [1 - test - val, 1 - test] if val else [1 - test]
    t = micros(F.col(time))
    name = F.when(t <= F.col("_q0"), "train")
    name = name.when(t <= F.col("_q1"), "val").otherwise("test") if val else name.otherwise("test")
    cuts = time_quantiles(df, time, shares)
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", name).drop(*cuts.columns)  # one row


def temporal_split(df: DataFrame, time: str, test: float = 0.3) -> DataFrame:
    """split: train before the cut, test from it on."""
    cuts = time_quantiles(df, time, [1 - test])
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", F.when(micros(F.col(time)) < F.col("_q0"), "train").otherwise("test")).drop("_q0")


def burn_in_split(df: DataFrame, time: str, test: float = 0.1, burn: float = 0.1) -> DataFrame:
    """split: test is the last share; burn the first share of what is left, train the rest of it."""
    first = quantile_split(df, time, test)
    cut = time_quantiles(first.where("split = 'train'"), time, [burn])
    early = (F.col("split") == "train") & (micros(F.col(time)) <= F.col("_q0"))
    return first.crossJoin(F.broadcast(cut)).withColumn("split", F.when(early, "burn").otherwise(F.col("split"))).drop("_q0")


def _ranked_times(df: DataFrame, time: str) -> DataFrame:
    """The distinct times with their rank from 1 and their number: as many rows as periods."""
    times = positions(df.select(time).where(F.col(time).isNotNull()).distinct(), [time])
    return small(times.select(time, (F.col("_before") + 1).alias("_rank"), F.col("_total").alias("_n")))


def increments(df: DataFrame, time: str, k: int) -> DataFrame:
    """increment: the first of k growing shares of the unique times that holds the row. Share i holds all increments up to i."""
    cuts = [F.floor(F.col("_n") * F.lit(i / k)) for i in range(1, k + 1)]
    at = F.coalesce(*[F.when(F.col("_rank") <= c, F.lit(i + 1)) for i, c in enumerate(cuts)])
    return df.join(_ranked_times(df, time), time).withColumn("increment", at).drop("_rank", "_n")


def time_series_folds(df: DataFrame, time: str, k: int) -> DataFrame:
    """fold: of k, that in which the row's time is tested, 0 if it only trains; a fold trains on all times before its own."""
    size = F.floor(F.col("_n") / F.lit(k + 1))
    first = F.col("_n") - F.lit(k) * size
    fold = F.when(F.col("_rank") <= first, 0).otherwise(F.floor((F.col("_rank") - first - 1) / size) + 1)
    return df.join(_ranked_times(df, time), time).withColumn("fold", fold.cast("int")).drop("_rank", "_n")


def position_folds(df: DataFrame, order: tuple[str, ...], k: int = 5) -> DataFrame:
    """The same by the position of rows in an order, which tells rows apart: see order.with_rank()."""
    placed = with_rank(df, order, rank="_place", total="_n")
    size = F.floor(F.col("_n") / F.lit(k + 1))
    if df.limit(k + 1).count() <= k:
        raise ValueError(f"there are too few rows for {k} folds")
    first = F.col("_n") - F.lit(k) * size
    fold = F.when(F.col("_place") <= first, 0).otherwise(F.floor((F.col("_place") - first - 1) / size) + 1)
    return placed.withColumn("fold", fold.cast("int")).drop("_place", "_n")


def common_groups(a: DataFrame, b: DataFrame, groups: tuple[str, ...], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both frames without the groups that one of them lacks; strict raises instead."""
    both = a.select(*groups).intersect(b.select(*groups))
    if strict and not (a.select(*groups).distinct().exceptAll(both).isEmpty() and b.select(*groups).distinct().exceptAll(both).isEmpty()):
        raise ValueError("the frames don't have the same groups")
    return a.join(both, list(groups), "left_semi"), b.join(both, list(groups), "left_semi")
