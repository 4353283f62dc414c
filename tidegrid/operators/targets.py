"""Forecasting targets for several horizons, with one window for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import window
from ..spec import PanelSpec


def horizon_targets(df: DataFrame, panel: PanelSpec, max_horizon: int, min_horizon: int = 1, shape: str = "long", drop_null: bool = True, whole: bool = False) -> DataFrame:
    """long: a row for each horizon with target_{c}, and horizon unless there is one only; wide: target_{c}_h{h}.

    Rows that lack a target go, if drop_null. In the long shape horizons are exploded after all leads are computed.
    """
    if not 1 <= min_horizon <= max_horizon:
        raise ValueError("1 <= min_horizon <= max_horizon must hold")
    if shape not in ("long", "wide"):
        raise ValueError(f"unknown shape {shape!r}")
    w, horizons = window(panel), range(min_horizon, max_horizon + 1)
    lead = lambda c, h: F.lead(c, h).over(w).cast("long") if whole else F.lead(c, h).over(w)
    if shape == "wide":
        names = {f"target_{c}_h{h}": lead(c, h) for h in horizons for c in panel.values}
        out = df.withColumns(names)
        return out.na.drop(subset=list(names)) if drop_null else out
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), *[lead(c, h).alias(f"target_{c}") for c in panel.values]) for h in horizons])
    out = df.withColumn("_t", each).withColumn("_t", F.explode("_t"))
    out = out.withColumns({k: F.col(f"_t.{k}") for k in ("horizon", *(f"target_{c}" for c in panel.values))}).drop("_t")
    if drop_null:
        out = out.na.drop(subset=[f"target_{c}" for c in panel.values])
    return out.drop("horizon") if min_horizon == max_horizon else out
