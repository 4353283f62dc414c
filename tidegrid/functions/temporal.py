"""Window features of a panel as expressions. All of a panel share one window, so one exchange and one sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.order import join_null_safe, small
from ..spec import PanelSpec
from ..storage import written

STATS = ("mean", "sum", "min", "max", "count", "std", "var", "median", "skew", "kurt")


def window(panel: PanelSpec, *more: str) -> WindowSpec:
    """By group, in order of time. more: further partition columns, as split, where features restart there."""
    return Window.partitionBy(*panel.groups, *more).orderBy(panel.time, *panel.ties)


def lag_filled(c: str, k: int, w: WindowSpec, fill: bool = True) -> Column:
    """The value k rows before; where there is none yet, the first one of the group, if fill."""
    lagged = F.lag(c, k).over(w)
    if not fill:
        return lagged
    everywhere = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(lagged, F.first(c, ignorenulls=True).over(everywhere))


def add_lags_filled(df: DataFrame, columns: tuple[str, ...], lags: tuple[int, ...], w: WindowSpec) -> DataFrame:
    """{c}_lag_{k} where values may be null: the next lagged value that isn't. Two steps over the same window."""
    names = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags}
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumns(names).withColumns({n: F.first(n, ignorenulls=True).over(ahead) for n in names})


def rolling(c: str, k: int, stat: str, w: WindowSpec) -> Column:
    """Of the last k rows with this one, as many as there are; skew and kurt are corrected for bias, as std and var are."""
    frame = w.rowsBetween(-(k - 1), Window.currentRow)
    x = F.col(c)
    simple = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp}
    if stat in simple:
        return simple[stat](x).over(frame)
    n = F.count(x).over(frame).cast("double")
    if stat == "median":
        return F.percentile(x, F.lit(0.5)).over(frame)
    flat = F.var_pop(x).over(frame) < 1e-14
    if stat == "skew":
        return F.when((n >= 3) & flat, 0.0).when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x).over(frame))
    if stat == "kurt":
        return F.when((n >= 4) & flat, -3.0).when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(frame) + 6))
    raise ValueError(f"unknown statistic {stat!r}; known: {STATS}")


#: Rows of a stretch at most, and the logarithm that the weights of one may fall by: quotients of weights stay within a double.
STRETCH_ROWS, STRETCH_DECAY = 65_536, 500.0


def add_ewm(df: DataFrame, panel: PanelSpec, columns: tuple[str, ...], spans: tuple[int, ...], restart_at: tuple[str, ...] = ()) -> DataFrame:
    """{c}_ewm_{span}: exponentially weighted means in order of time, y = a * y' + (1 - a) * x; a null keeps y, and lets older weights decay.

    Each observation maps the mean before it to the mean after it, linearly. Rows are dealt to ranges of (groups, time), so that one
    long group is many tasks; within a range, stretches of some rows compose their maps by running sums. A short second pass composes the
    maps of stretches, by doubling, in order; then each row's mean is its own stretch's map of the mean before that. Linear in rows.
    Groups may be null. Rows that share a time, and ties, follow one another in any order.
    """
    own = [*panel.groups, *restart_at]
    keys = [*own, panel.time, *panel.ties]
    alphas = {s: 2.0 / (s + 1) for s in spans}
    rows = min([STRETCH_ROWS, *[max(1, int(STRETCH_DECAY / -math.log(1 - a))) for a in alphas.values() if a < 1]])
    dealt = df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    in_range = Window.partitionBy("_range", *own).orderBy(panel.time, *panel.ties)
    dealt = written(dealt.withColumn("_at", F.row_number().over(in_range) - 1), "ranges")  # places are data from here on
    dealt = dealt.withColumns({"_stretch": F.floor(F.col("_at") / rows), "_at": F.col("_at") % rows})
    stretch = ["_range", "_stretch"]
    for c in columns:
        seen = F.col(c).isNotNull()
        ends = dealt.groupBy(*own, *stretch).agg(F.count("*").alias("_rows"), F.max(F.when(seen, F.col("_at"))).alias("_seen"))
        order = Window.partitionBy(*own).orderBy(*stretch)
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        ends = ends.withColumn("_gap", F.col("_first") - F.last(F.col("_first") + F.col("_seen"), ignorenulls=True).over(earlier))  # null: nothing was seen
        out = join_null_safe(dealt, small(ends.select(*own, *stretch, "_gap")), [*own, *stretch])
        inside = Window.partitionBy(*stretch, *own).orderBy("_at")
        past, so_far = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        steps = F.col("_at") - F.coalesce(F.last(F.when(seen, F.col("_at")), ignorenulls=True).over(past), -F.col("_gap"))
        out = out.withColumn("_steps", F.when(seen, steps))
        logs, parts = {}, {}
        for s, a in alphas.items():
            # y = keep * y' + take * x; where the old weight is nothing, or there is no y', as if y' were 0 and x alone counted.
            decay = F.col("_steps") * math.log(1 - a) if a < 1 else F.lit(-math.inf)
            fresh = F.col("_steps").isNull() | (decay < -STRETCH_DECAY)
            weight = F.exp(decay)
            logs[f"_log_{s}"] = F.when(seen, F.when(fresh, 0.0).otherwise(decay - F.log(weight + a)))
            parts[f"_take_{s}"] = F.when(seen, F.when(fresh, 1.0).otherwise(a / (weight + a)) * F.col(c).cast("double"))
            parts[f"_fresh_{s}"] = F.when(seen, fresh)
        out = out.withColumns(logs | parts)
        # A fresh observation ends what came before in its stretch: sums run from there. Only the first can be one, save for span 1.
        out = out.withColumns({f"_from_{s}": F.coalesce(F.sum(F.col(f"_fresh_{s}").cast("int")).over(so_far), F.lit(0)) for s in spans})
        at = {s: Window.partitionBy(*stretch, *own, f"_from_{s}").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow) for s in spans}
        out = out.withColumns({f"_log_{s}": F.coalesce(F.sum(f"_log_{s}").over(at[s]), F.lit(0.0)) for s in spans})
        out = out.withColumns({f"_sum_{s}": F.coalesce(F.sum(F.col(f"_take_{s}") * F.exp(-F.col(f"_log_{s}"))).over(at[s]), F.lit(0.0)) for s in spans})
        out = written(out.drop("_gap", "_steps", *[f"_{x}_{s}" for s in spans for x in ("take", "fresh")]), "stretches")
        last = lambda x: F.max_by(x, "_at")
        maps = out.groupBy(*own, *stretch).agg(*[z for s in spans for z in (F.when(last(F.col(f"_from_{s}")) > 0, 0.0).otherwise(F.exp(last(F.col(f"_log_{s}")))).alias(f"_keep_{s}"), (last(F.col(f"_sum_{s}")) * F.exp(last(F.col(f"_log_{s}")))).alias(f"_add_{s}"))], F.max(seen).alias("_any"))
        most = maps.groupBy(*own).count().agg(F.max("count")).first()[0] or 1
        k = 1
        while k < most:  # each map composed with the k maps before it
            before = lambda x, k=k: F.lag(x, k).over(order)
            maps = maps.withColumns({f"_add_{s}": F.col(f"_add_{s}") + F.col(f"_keep_{s}") * F.coalesce(before(f"_add_{s}"), F.lit(0.0)) for s in spans} | {f"_keep_{s}": F.col(f"_keep_{s}") * F.coalesce(before(f"_keep_{s}"), F.lit(1.0)) for s in spans} | {"_any": F.col("_any") | F.coalesce(before("_any"), F.lit(False))})
            k *= 2
        carried = maps.select(*own, *stretch, *[F.coalesce(F.lag(f"_add_{s}").over(order), F.lit(0.0)).alias(f"_in_{s}") for s in spans], F.coalesce(F.lag("_any").over(order), F.lit(False)).alias("_known"))
        out = join_null_safe(out, small(carried), [*own, *stretch])
        known = F.col("_known") | F.coalesce(F.max(seen).over(Window.partitionBy(*stretch, *own).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False))
        mean = lambda s: F.exp(F.col(f"_log_{s}")) * (F.col(f"_sum_{s}") + F.when(F.col(f"_from_{s}") > 0, 0.0).otherwise(F.col(f"_in_{s}")))
        dealt = out.withColumns({f"{c}_ewm_{s}": F.when(known, mean(s)) for s in spans}).drop("_known", *[f"_{x}_{s}" for s in spans for x in ("log", "sum", "from", "in")])
    return dealt.drop("_range", "_stretch", "_at")


def difference(c: str, k: int, w: WindowSpec) -> Column:
    return F.col(c) - F.lag(c, k).over(w)


def difference_rate(c: str, k: int, w: WindowSpec) -> Column:
    return difference(c, k, w) - (F.lag(c, 1).over(w) - F.lag(c, k + 1).over(w))


def pct_change(c: str, k: int, w: WindowSpec) -> Column:
    """Relative change, within [-1, 1]; from zero it is the sign of the change, null if there is none."""
    now, before = F.col(c).cast("double"), F.lag(c, k).over(w).cast("double")
    rate = (now - before) / F.when(before != 0, before)
    return F.when(before == 0, F.when(now != 0, F.signum(now))).when(rate.isNotNull(), F.least(F.greatest(rate, F.lit(-1.0)), F.lit(1.0)))


def deviation(c: str, k: int, w: WindowSpec) -> Column:
    return F.col(c) - rolling(c, k, "mean", w)


def variation(c: str, k: int, w: WindowSpec) -> Column:
    mean = rolling(c, k, "mean", w)
    return rolling(c, k, "std", w) / F.when(mean != 0, mean)


def derivatives(c: str, k: int, w: WindowSpec, replacement: float | None = None) -> dict[str, Column]:
    out = {f"{c}_diff_{k}": difference(c, k, w), f"{c}_diff_rate_{k}": difference_rate(c, k, w), f"{c}_pct_change_{k}": pct_change(c, k, w), f"{c}_deviation_rolling_{k}": deviation(c, k, w), f"{c}_cv_rolling_{k}": variation(c, k, w)}
    return out if replacement is None else {n: F.coalesce(x, F.lit(replacement)) for n, x in out.items()}


def add_temporal(df: DataFrame, panel: PanelSpec, lags: tuple[int, ...] = (), windows: tuple[int, ...] = (), stats: tuple[str, ...] = ("mean",), diffs: tuple[int, ...] = (), restart_at: tuple[str, ...] = ()) -> DataFrame:
    """All lag, rolling and derivative features of a panel without null values, in one pass over one window."""
    w = window(panel, *restart_at)
    out = {}
    for c in panel.values:
        out |= {f"{c}_lag_{k}": lag_filled(c, k, w) for k in lags}
        out |= {f"{c}_rolling_{s}_{k}": rolling(c, k, s, w) for k in windows for s in stats}
        for k in diffs:
            out |= derivatives(c, k, w)
    return df.withColumns(out) if out else df


def check_times(df: DataFrame, panel: PanelSpec) -> DataFrame:
    """By group: rows, whether times repeat, missing times. Order needs no check: every window sorts."""
    w = window(panel)
    gap = df.withColumn("_same", (F.lag(panel.time).over(w) == F.col(panel.time)).cast("int"))
    return gap.groupBy(*panel.groups).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("_same"), F.lit(0)).cast("long").alias("n_repeated"), F.sum(F.col(panel.time).isNull().cast("long")).alias("n_null"))
