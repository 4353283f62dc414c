"""Positions, ranks and quantiles against numpy, with nulls, ties and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import order


def frame(spark):
    rng = np.random.default_rng(4)
    rows = [(None if rng.random() < 0.1 else str(rng.choice(["hot", "hot", "hot", "b", "c"])), None if rng.random() < 0.1 else float(rng.choice([0, 0, 0, 1, 2.5, -3, rng.normal()])), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, v double, i long").repartition(7)


def test_ranks(spark):
    rows, df = frame(spark)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    got = {r["i"]: (r["_rank"], r["_total"]) for r in order.with_rank(df, ["v", "i"]).collect()}
    assert got == {r[2]: (k + 1, len(rows)) for k, r in enumerate(sorted(rows, key=key))}
    got = {r["i"]: (r["_rank"], r["_total"]) for r in order.with_rank(df, ["v", "i"], ["g"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == g], key=key)
        assert all(got[r[2]] == (k + 1, len(own)) for k, r in enumerate(own))
    # Without ties that tell rows apart ranks are still a numbering.
    assert sorted(r["_rank"] for r in order.with_rank(df, ["v"]).collect()) == list(range(1, len(rows) + 1))
    assert order.with_rank(df.where("i < 0"), ["v"], ["g"]).count() == 0


def test_quantiles(spark):
    rows, df = frame(spark)
    shares = (0, 0.1, 0.25, 0.5, 0.731, 1)
    got = order.quantiles(df, {"v": F.col("v"), "w": -F.col("v") * 2, "none": F.lit(None)}, shares).collect()
    v = [r[1] for r in rows if r[1] is not None]
    assert len(got) == 1 and got[0]["none"] is None
    assert got[0]["v"] == pytest.approx(np.quantile(v, shares)) and got[0]["w"] == pytest.approx(np.quantile(-2 * np.array(v), shares))
    for r in order.quantiles(df, {"v": F.col("v")}, shares, ["g"]).collect():
        assert r["v"] == pytest.approx(np.quantile([x[1] for x in rows if x[0] == r["g"] and x[1] is not None], shares))
    assert order.quantiles(df.where("i < 0"), {"v": F.col("v")}, shares).collect()[0]["v"] is None


def test_no_task_holds_a_hot_value_or_group(spark):
    """A third of all rows share a value and a group: counts of a range stay near the mean of all ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"), F.lit("hot").alias("g"), "id")
        found = order.positions(df, ["v", "id"], ["g"])
        assert found.count() == 60_000
        sizes = [r["count"] for r in df.groupBy("g", "v", "id").count().repartitionByRange("g", "v", "id").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
