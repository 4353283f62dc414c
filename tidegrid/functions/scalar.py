"""Scalar expressions: rounding, clipping, bins and derived trip columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"s": 1, "sec": 1, "min": 60, "t": 60, "h": 3600, "d": 86400}


def freq_seconds(freq: str) -> int:
    """Seconds of a frequency such as 1h, 15min, 30s or 1D."""
    m = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", freq.strip())
    if not m or m[2].lower() not in _UNITS or m[1] == "0":
        raise ValueError(f"unknown frequency {freq!r}")
    return int(m[1] or 1) * _UNITS[m[2].lower()]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def floor_time(ts: Column, freq: str) -> Column:
    """The start of the period that a time lies in, counted from the epoch."""
    step = freq_seconds(freq) * 1_000_000
    return F.timestamp_micros(F.floor(micros(ts) / step) * step).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    """greatest and least skip nulls; a null stays null here."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def cut(c: Column, edges: list[float], labels: list | None = None, lowest: bool = True) -> Column:
    """Right-closed bins (e0, e1], (e1, e2]...; with lowest, e0 belongs to the first."""
    out = None
    for i, high in enumerate(edges[1:]):
        inside = (c >= edges[0] if lowest and i == 0 else c > edges[i]) & (c <= high if high != float("inf") else F.lit(True))
        value = F.lit(i if labels is None else labels[i])
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return out


def day_part(hour: Column) -> Column:
    return cut(hour, [0, 6, 12, 18, 24], ["Night", "Morning", "Afternoon", "Evening"])


def duration_class(minutes: Column) -> Column:
    return cut(minutes, [0, 15, 30, 60, float("inf")], ["Short", "Medium", "Long", "Very Long"])


def derived_trip_columns(start: str = "StartTime", from_col: str = "StartStationId", to_col: str = "EndStationId", minutes: str = "duration_minutes") -> dict[str, Column]:
    ts = F.col(start)
    return {
        "StartHour": F.hour(ts), "StartMonth": F.month(ts), "StartYear": F.year(ts), "StartDayOfWeek": F.weekday(ts),
        "IsRoundTrip": F.coalesce(F.col(from_col) == F.col(to_col), F.lit(False)).cast("int"),
        "TimeCategory": day_part(F.hour(ts)), "DurationCategory": duration_class(F.col(minutes)),
    }


def demand_prediction(c: Column, positive: bool = True, whole: bool = True) -> Column:
    """Predictions as demand: none below zero, rounded half to even."""
    c = F.when(c < 0, F.lit(0.0)).otherwise(c) if positive else c
    return F.rint(c).cast("long") if whole else c
