"""Metrics by group, in one aggregate; their quantiles, summaries and averages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import window
from ..spec import PanelSpec
from .order import join_null_safe, quantiles


def _over(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def naive_scale(train: DataFrame, panel: PanelSpec, y: str, season: int = 1) -> DataFrame:
    """By group: the mean absolute change over a season, the scale of MASE."""
    w = window(panel)
    return train.withColumn("_d", F.abs(F.col(y) - F.lag(y, season).over(w))).groupBy(*panel.groups).agg(F.avg("_d").alias("scale"))


def regression_metrics(df: DataFrame, groups: tuple[str, ...], y: str = "y", pred: str = "y_pred", scale: DataFrame | None = None, custom: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """r2, mae, rmse, smape and, with a scale by group, mase. A pair of zeros adds nothing to smape; a constant truth has no r2.

    custom: aggregates of (truth, prediction) as columns, by name.
    """
    t, p = F.col(y).cast("double"), F.col(pred).cast("double")
    size = F.abs(t) + F.abs(p)
    own = {k: f(t, p) for k, f in (custom or {}).items()}
    out = df.groupBy(*groups).agg(
        (1 - _over(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count(t))).alias("r2"), F.avg(F.abs(t - p)).alias("mae"), F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        F.avg(F.when(size == 0, 0.0).otherwise(2 * F.abs(t - p) / F.when(size != 0, size))).alias("smape"), *[c.alias(k) for k, c in own.items()],
    )
    if scale is None:
        return out.withColumn("mase", F.lit(None).cast("double"))
    return out.join(scale, list(groups), "left").withColumn("mase", _over(F.col("mae"), F.col("scale"))).drop("scale")


def classification_metrics(df: DataFrame, groups: tuple[str, ...], y: str = "y", pred: str = "y_pred") -> DataFrame:
    """accuracy and macro precision, recall, f1 over the classes that occur as truth or prediction; 0 where undefined."""
    cells = df.groupBy(*groups, F.col(y).alias("_t"), F.col(pred).alias("_p")).agg(F.count("*").alias("_n"))
    sides = cells.select(*groups, F.explode(F.array(F.struct(F.col("_t").alias("k"), F.lit(1).alias("t")), F.struct(F.col("_p").alias("k"), F.lit(0).alias("t")))).alias("s"), "_n", (F.col("_t") == F.col("_p")).alias("_hit"))
    by_class = sides.groupBy(*groups, F.col("s.k").alias("_k")).agg(F.sum(F.when(F.col("s.t") == 1, F.col("_n")).otherwise(0)).alias("true"), F.sum(F.when(F.col("s.t") == 0, F.col("_n")).otherwise(0)).alias("named"), F.sum(F.when(F.col("_hit") & (F.col("s.t") == 1), F.col("_n")).otherwise(0)).alias("hit"))
    rate = lambda b: F.when(b > 0, F.col("hit") / F.when(b > 0, b)).otherwise(0.0)
    scored = by_class.withColumns({"precision": rate(F.col("named")), "recall": rate(F.col("true"))})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / F.when(F.col("precision") + F.col("recall") > 0, F.col("precision") + F.col("recall"))).otherwise(0.0)
    return scored.withColumn("f1", f1).groupBy(*groups).agg(_over(F.sum("hit"), F.sum("true")).alias("accuracy"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def metric_quantiles(metrics: DataFrame, names: tuple[str, ...], keys: tuple[str, ...] = (), at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """keys, metric and a column q{percent} for each quantile of the metric over groups."""
    long = metrics.unpivot([F.col(k) for k in keys], list(names), "metric", "v") if keys else metrics.select(*names).unpivot([], list(names), "metric", "v")
    found = join_null_safe(long.select(*keys, "metric").distinct(), quantiles(long, {"_q": F.col("v")}, at, (*keys, "metric")), [*keys, "metric"], "left")
    return found.select(*keys, "metric", *[F.element_at("_q", i + 1).alias(f"q{round(100 * x)}") for i, x in enumerate(at)])


def mean_metrics(metrics: DataFrame, names: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over groups, null and NaN apart."""
    return metrics.groupBy(*keys).agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in names])


def timing_summary(runs: DataFrame) -> DataFrame:
    """By identifier and horizon: mean and deviation of times, first sizes, the first error in order of runs."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("run_id")))
    times = [f(c).alias(f"{c}_{n}") for c in ("train_time", "predict_time", "total_time") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return runs.groupBy("identifier", "horizon").agg(*times, *[first(c).alias(c) for c in ("train_size", "test_size", "error")])


def importance_table(rows: DataFrame, kind: str = "raw", top: int | None = None) -> DataFrame:
    """feature, importance: the mean over horizons; as it is, as log1p, or normalised to a sum of one; the top of them, if asked."""
    mean = rows.groupBy("feature").agg(F.avg("importance").alias("importance"))
    if kind == "log":
        mean = mean.withColumn("importance", F.log1p("importance"))
    elif kind == "normalised":
        mean = mean.withColumn("importance", _over(F.col("importance"), F.sum("importance").over(Window.partitionBy())))
    elif kind != "raw":
        raise ValueError(f"unknown kind {kind!r}")
    mean = mean.orderBy(F.col("importance").desc(), "feature")
    return mean.limit(top) if top else mean


def min_max_params(trials: DataFrame, columns: tuple[str, ...], id_col: str = "trial") -> DataFrame:
    """trial, param, value, scaled: wide parameters as rows, each param scaled to [0, 1]."""
    long = trials.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(id_col, list(columns), "param", "value")
    w = Window.partitionBy("param")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return long.withColumn("scaled", F.coalesce(_over(F.col("value") - low, high - low), F.lit(0.0)))
