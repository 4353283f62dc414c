"""Calendar features of a time column, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import cut

_PARTS = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute,
    "second": F.second, "dayofyear": F.dayofyear, "dayofweek": F.weekday, "weekday": F.weekday, "weekofyear": F.weekofyear,
}


def calendar_parts(ts: str, parts: tuple[str, ...]) -> dict[str, Column]:
    """Monday is day 0 of the week; weeks are ISO's."""
    if unknown := [p for p in parts if p not in _PARTS]:
        raise ValueError(f"unknown time features {unknown}; known: {sorted(_PARTS)}")
    return {p: _PARTS[p](F.col(ts)).cast("int") for p in parts}


def time_period(ts: str) -> Column:
    """0 night, 1 morning rush, 2 midday, 3 evening rush, 4 late."""
    return cut(F.hour(F.col(ts)), [0, 6, 9, 17, 20, 24])


def transit_flags(ts: str) -> dict[str, Column]:
    hour, work = F.hour(F.col(ts)), F.weekday(F.col(ts)) < 5
    spans = {"is_morning_rush": (7, 9), "is_evening_rush": (17, 20), "is_business_hours": (9, 18), "is_school_hours": (8, 15)}
    return {k: (hour.between(*v) & work).cast("int") for k, v in spans.items()} | {"is_weekend": (~work).cast("int")}


def custom_periods(ts: str, periods: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """is_{name} for hours from start to end, both included; a start after the end wraps round midnight."""
    hour = F.hour(F.col(ts))
    return {f"is_{k}": (hour.between(a, b) if a <= b else (hour >= a) | (hour <= b)).cast("int") for k, (a, b) in periods.items()}


def add_holiday_flags(df: DataFrame, ts: str, holidays: DataFrame, date: str = "date") -> DataFrame:
    """is_holiday, is_day_before_holiday, is_day_after_holiday, is_holiday_period. One lookup of a small table of days."""
    days = holidays.select(F.col(date).cast("date").alias("_d")).where("_d IS NOT NULL").distinct()
    around = days.select(F.explode(F.array(*[F.struct(F.date_add("_d", k).alias("day"), F.lit(k).alias("k")) for k in (-1, 0, 1)])).alias("x"))
    flag = lambda k: F.max((F.col("x.k") == k).cast("int"))
    table = around.groupBy(F.col("x.day").alias("_day")).agg(flag(0).alias("is_holiday"), flag(-1).alias("is_day_before_holiday"), flag(1).alias("is_day_after_holiday"))
    names = ["is_holiday", "is_day_before_holiday", "is_day_after_holiday"]
    out = df.join(table, F.to_date(F.col(ts)) == F.col("_day"), "left").drop("_day").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names})
    return out.withColumn("is_holiday_period", F.greatest(*names))


def rbf_features(feature: str, n: int, span: tuple[float, float]) -> dict[str, Column]:
    """n repeating radial kernels over the span: {feature}_rbf_{i}, i from 1."""
    low, high = span
    if n < 1 or high <= low:
        raise ValueError("an RBF needs at least one kernel and a span")
    u = (F.col(feature) - F.lit(float(low))) / F.lit(float(high - low))
    out = {}
    for i in range(n):
        d = F.abs(u - F.lit(i / n))
        d = F.when(d.isNotNull(), F.least(d, F.lit(1.0) - d))
        out[f"{feature}_rbf_{i + 1}"] = F.exp(-F.pow(d * F.lit(float(n)), F.lit(2.0)))
    return out


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    radius = 6378137.0
    return F.radians(lon) * radius, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * radius
