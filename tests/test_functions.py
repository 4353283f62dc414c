import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import calendar, scalar, temporal
from tidegrid.operators import learned, split, targets
from tidegrid.spec import CleaningConfig, FeatureConfig, PanelSpec

SPEC = PanelSpec(("g",), "t", ("x",))


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    frames = []
    for g, n in (("a", 40), ("b", 33)):
        x = rng.integers(0, 6, n).astype(float)
        x[5:12] = 3
        frames.append(pd.DataFrame({"g": g, "t": pd.date_range("2024-01-01", periods=n, freq="h"), "x": x}))
    return pd.concat(frames, ignore_index=True)


def test_windows_match_pandas(spark, series):
    df = spark.createDataFrame(series)
    w = temporal.window(SPEC)
    cols = {s: temporal.rolling("x", 5, s, w) for s in temporal.STATS}
    got = df.select("g", "t", *[c.alias(n) for n, c in cols.items()], temporal.lag_filled("x", 3, w).alias("lag")).toPandas().sort_values(["g", "t"])
    by = series.sort_values(["g", "t"]).groupby("g")["x"]
    for s in ("mean", "sum", "min", "max", "count", "std", "var", "median", "skew", "kurt"):
        want = by.transform(lambda x, s=s: getattr(x.rolling(5, min_periods=1), s)())
        np.testing.assert_allclose(got[s].astype(float).to_numpy(), want.to_numpy(), atol=1e-6, err_msg=s)
    np.testing.assert_allclose(got["lag"].to_numpy(), by.transform(lambda x: x.shift(3).bfill()).to_numpy())


@pytest.mark.parametrize("rows", [None, 7])
def test_ewm_matches_pandas(spark, monkeypatch, rows):
    """Long and short groups, null at the start, long gaps, a null group, one group over many ranges and stretches."""
    if rows:
        monkeypatch.setattr(temporal, "STRETCH_ROWS", rows)
    rng = np.random.default_rng(9)
    frames = []
    for g, n in (("a", 3000), ("b", 1), ("c", 40), (None, 25), ("d", 900)):
        x = rng.normal(size=n) * 10
        x[rng.random(n) < 0.3] = np.nan
        if g == "d":
            x[:30] = np.nan
            x[100:800] = np.nan
        if g == "b":
            x[:] = np.nan
        frames.append(pd.DataFrame({"g": g, "t": pd.date_range("2024-01-01", periods=n, freq="h"), "x": x, "y": np.arange(n, dtype=float)}))
    whole = pd.concat(frames, ignore_index=True)
    rows = [(r.g, r.t.to_pydatetime(), None if np.isnan(r.x) else r.x, r.y) for r in whole.itertuples()]
    df = spark.createDataFrame(rows, "g string, t timestamp_ntz, x double, y double").repartition(5)
    spans = (1, 2, 3, 50, 10**6)
    got = temporal.add_ewm(df, PanelSpec(("g",), "t", ("x",)), ("x", "y"), spans).toPandas().sort_values(["g", "t"], na_position="last")
    whole = whole.sort_values(["g", "t"], na_position="last")
    for c in ("x", "y"):
        for s in spans:
            want = whole.groupby("g", dropna=False)[c].transform(lambda v, s=s: v.ewm(span=s, adjust=False).mean())
            np.testing.assert_allclose(got[f"{c}_ewm_{s}"].astype(float), want, rtol=1e-9, atol=1e-9, err_msg=f"{c} {s}")
    assert temporal.add_ewm(df.where("g = 'z'"), PanelSpec(("g",), "t", ("x",)), ("x",), (3,)).count() == 0


def test_derivatives_match_pandas(spark, series):
    df = spark.createDataFrame(series)
    w = temporal.window(SPEC)
    got = df.select("g", "t", *[c.alias(n) for n, c in temporal.derivatives("x", 2, w).items()]).toPandas().sort_values(["g", "t"])
    by = series.sort_values(["g", "t"]).groupby("g")["x"]
    np.testing.assert_allclose(got["x_diff_2"].astype(float), by.transform(lambda x: x.diff(2)))
    np.testing.assert_allclose(got["x_diff_rate_2"].astype(float), by.transform(lambda x: x.diff(2).diff()))
    want = by.transform(lambda x: x.pct_change(2).clip(-1, 1))
    np.testing.assert_allclose(got["x_pct_change_2"].astype(float), want)


def test_one_exchange_for_all_window_features(spark, series):
    df = temporal.add_temporal(spark.createDataFrame(series), SPEC, (1, 2), (3, 6), ("mean", "std"), (1, 4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_calendar_of_two_days(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 8, 30),), (dt.datetime(2020, 1, 2, 17, 45),)], "ts timestamp_ntz")
    days = spark.createDataFrame([("2020-01-01",)], "date string")
    got = calendar.add_holiday_flags(df, "ts", days).select("ts", *[c.alias(n) for n, c in (calendar.calendar_parts("ts", ("hour", "dayofweek")) | calendar.transit_flags("ts")).items()], calendar.time_period("ts").alias("time_period"), "is_holiday", "is_day_before_holiday", "is_day_after_holiday", "is_holiday_period").orderBy("ts").collect()
    assert [tuple(r)[1:] for r in got] == [(8, 2, 1, 0, 0, 1, 0, 1, 1, 0, 0, 1), (17, 3, 0, 1, 1, 0, 0, 2, 0, 0, 1, 1)]
    with pytest.raises(ValueError):
        calendar.calendar_parts("ts", ("fortnight",))


def test_targets_of_two_stations(spark):
    rows = [(s, dt.datetime(2024, 1, 1, h), v) for s, vs in ((1, (10, 20, 30)), (2, (15, 25, 35))) for h, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "station_id long, timestamp timestamp_ntz, inbound long")
    spec = PanelSpec(("station_id",), "timestamp", ("inbound",))
    got = {(r["station_id"], r["timestamp"].hour, r["horizon"], r["target_inbound"]) for r in targets.horizon_targets(df, spec, 2).collect()}
    assert got == {(1, 0, 1, 20), (1, 1, 1, 30), (1, 0, 2, 30), (2, 0, 1, 25), (2, 1, 1, 35), (2, 0, 2, 35)}
    every = targets.horizon_targets(df, spec, 2, drop_null=False)
    assert every.count() == 12 and every.where("target_inbound IS NULL").count() == 6
    assert "horizon" not in targets.horizon_targets(df, spec, 1).columns


def test_multiplier_ladder_and_labels():
    assert learned.multipliers(5) == [0.25, 0.5, 1, 2, 4] and learned.multipliers(4) == [0.25, 0.5, 1, 2] and learned.multipliers(3) == [0.5, 1, 2]
    assert learned.bin_labels(4) == ["Q0", "Q1", "Q2", "Q3"]
    for bad in ((0.1, 1), (0, 0.5), (0, 0.5, 0.5, 1), (0, 1.5, 1)):
        with pytest.raises(ValueError):
            learned.check_quantiles(bad)


def test_demand_levels_of_ten_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 0, 0, 1, 1, 2, 3, 4, 6, 9])], "i long, v long")
    levels = learned.demand_levels(df, "v", 3, (), ("i",))
    edges = learned.level_edges(levels, "v")
    assert edges.first()["edges"] == [-1, 1, 3, 4, float("inf")]
    assert [r["mask"] for r in learned.apply_levels(df, "v", edges).orderBy("i").collect()] == [0, 0, 0, 0, 0, 1, 1, 2, 3, 3]


def test_full_spectrum_is_twice_the_signal(spark, series):
    some = series[series["g"] == "a"]
    got = learned.Fourier(SPEC, 100).fit_transform(spark.createDataFrame(some)).orderBy("t").toPandas()
    np.testing.assert_allclose(got["fourier_x"], np.minimum(2 * some["x"], some["x"].max()), atol=1e-8)
    one = learned.Fourier(SPEC, 100, one_sided=True).fit_transform(spark.createDataFrame(some)).orderBy("t").toPandas()
    assert np.abs(one["fourier_x"] - some["x"].to_numpy()).max() < 0.5


def test_power_makes_values_more_even(spark):
    x = np.exp(np.random.default_rng(0).normal(size=2000))
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    for method in ("yeo-johnson", "box-cox"):
        got = learned.Power(("v",), method).fit_transform(df).toPandas()["v"]
        assert abs(got.mean()) < 1e-6 and abs(got.std() - 1) < 1e-2 and abs(got.skew()) < 0.2
    with pytest.raises(ValueError):
        learned.Power(("v",), "box-cox").fit(df.withColumn("v", F.col("v") - 5))


def test_splits_partition_rows(spark, series):
    df = spark.createDataFrame(series)
    got = split.quantile_split(df, "t", 0.2, 0.2).groupBy("split").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).toPandas().set_index("split")
    assert got["n"].sum() == len(series) and got.loc["train", "b"] < got.loc["val", "a"] and got.loc["val", "b"] < got.loc["test", "a"]
    with pytest.raises(ValueError):
        split.quantile_split(df, "t", 1.2)
    folds = split.position_folds(df, ("t", "g"), 5).groupBy("fold").count().toPandas().set_index("fold")["count"]
    assert folds.loc[1:].eq(len(series) // 6).all() and folds.sum() == len(series)


def test_settings_are_checked():
    with pytest.raises(ValueError):
        CleaningConfig(outliers="magic")
    with pytest.raises(ValueError):
        FeatureConfig(PanelSpec(("g",), "t", ()))
    with pytest.raises(ValueError):
        FeatureConfig(SPEC, lags=(0,))
    with pytest.raises(ValueError):
        scalar.freq_seconds("fortnight")


def test_predictions_as_demand(spark):
    df = spark.createDataFrame([(-1.2,), (0.5,), (1.5,), (2.5,), (None,)], "p double")
    assert [r[0] for r in df.select(scalar.demand_prediction(F.col("p"))).collect()] == [0, 0, 2, 2, None]
