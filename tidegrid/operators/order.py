"""Exact order statistics over any number of rows: positions, ranks and quantiles, of all rows or by group.

Equal values are counted first. The counts are dealt to ranges of (groups, values), so a range has neither a whole hot group nor
all rows of a frequent value; sums of ranges give each one's first position, and positions within it are running sums. No task
holds all values, and nothing but the sum of a range meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Rows up to which a frame is broadcast to a join.
BROADCAST_ROWS = 100_000


def small(frame: DataFrame) -> DataFrame:
    """The frame, broadcast if a count shows that it is small."""
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with right's other columns; nulls among the keys are equal."""
    renamed = right.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, same, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def positions(df: DataFrame, order: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Each distinct value of the order columns in a group: how many rows have it (_n), come before it (_before), and are in the group (_total).

    Nulls come first, as in any ascending order. Evaluated. An empty frame gives no rows.
    """
    keys, before = [*groups, *order], (Window.unboundedPreceding, -1)
    dealt = df.groupBy(*keys).agg(F.count("*").alias("_n")).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    counts = written(dealt, "ranges")  # the ranges are data from here on
    of_range = counts.groupBy(*groups, "_range").agg(F.sum("_n").alias("_sum"))  # a row a range, and a group
    own = Window.partitionBy(*groups)
    firsts = of_range.select(*groups, "_range", F.coalesce(F.sum("_sum").over(own.orderBy("_range").rowsBetween(*before)), F.lit(0)).alias("_first"), F.sum("_sum").over(own).alias("_total"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_range", *groups).orderBy(*order).rowsBetween(*before)), F.lit(0))
    placed = join_null_safe(counts.withColumn("_inside", inside), small(firsts), [*groups, "_range"])
    return placed.select(*keys, "_n", (F.col("_first") + F.col("_inside")).alias("_before"), "_total")


def with_rank(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), rank: str = "_rank", total: str = "_total") -> DataFrame:
    """df with each row's place from 1 in its group's order, and the group's number of rows.

    Rows that are equal in all order columns follow one another in any order; only these meet in one task, so give ties that tell rows apart.
    """
    keys = [*groups, *order]
    found = positions(df, order, groups).select(*keys, F.col("_before").alias("_rows_before"), F.col("_total").alias("_rows_of_group"))
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return join_null_safe(df, small(found), keys).withColumn(rank, F.col("_rows_before") + again).withColumn(total, F.col("_rows_of_group")).drop("_rows_before", "_rows_of_group")


def quantiles(df: DataFrame, columns: dict[str, Column], shares: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """groups and, for each column by name, an array of its quantiles at these shares, interpolated between neighbours.

    Nulls don't count. A group without a value in any column has no row, one without a value in some column null there. Without
    groups there is one row, of nulls if there is no value.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), c.cast("double").alias("_v")) for i, c in enumerate(columns.values())])
    long = df.select(*groups, F.explode(cells).alias("_x")).select(*groups, "_x._c", "_x._v").where("_v IS NOT NULL")
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(s)) * (F.col("_total") - 1)).alias("at")) for k, s in enumerate(shares)]))
    near = positions(long, ["_v"], (*groups, "_c")).withColumn("_want", wanted)
    at, low, high = F.col("_want.at"), F.floor("_want.at"), F.ceil("_want.at")
    holds = lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_n"))
    near = near.where(holds(low) | holds(high)).groupBy(*groups, "_c", F.col("_want.k").alias("_k")).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_low"), F.max(F.when(holds(high), F.col("_v"))).alias("_high"), F.max(at).alias("_at")
    )
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_low") + (F.col("_at") - F.floor("_at")) * F.col("_high"))
    found = near.withColumn("_q", value)
    one = lambda i, k: F.max(F.when((F.col("_c") == i) & (F.col("_k") == k), F.col("_q")))
    whole = found.groupBy(*groups).agg(*[F.array(*[one(i, k) for k in range(len(shares))]).alias(name) for i, name in enumerate(columns)])
    return whole.withColumns({name: F.when(F.get(name, 0).isNotNull(), F.col(name)) for name in columns})
