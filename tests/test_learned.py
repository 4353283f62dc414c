"""Estimators by group, and saved models, against the same estimators fitted on each group alone."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidegrid.operators import learned
from tidegrid.plans import pipeline
from tidegrid.spec import FeatureConfig, PanelSpec

SPEC = PanelSpec(("g",), "t", ("x",))


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(12)
    rows = []
    for g, n, scale in (("a", 90, 1), ("b", 60, 50), (None, 45, 7)):
        x = np.round(rng.gamma(2, scale, n), 3) + 0.5
        rows += [(g, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), float(v), str(rng.choice(["p", "q", "r"] if g != "b" else ["p", "q"]))) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "g string, t timestamp_ntz, x double, k string")


ESTIMATORS = {
    "adjuster": lambda: learned.TrafficAdjuster(SPEC),
    "minmax": lambda: learned.MinMax(("x",)),
    "power": lambda: learned.Power(("x",)),
    "box_cox": lambda: learned.Power(("x",), "box-cox"),
    "fourier": lambda: learned.Fourier(SPEC, 5, smooth=True),
    "target": lambda: learned.TargetEncoder("k", ("x",)),
    "ordinal": lambda: learned.Ordinal("k"),
    "onehot": lambda: learned.OneHot("k"),
}


def frame(df, columns):
    return df.select("g", "t", *columns).toPandas().sort_values(["g", "t"], na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ESTIMATORS))
def test_each_group_as_if_alone(spark, panel, name, tmp_path):
    fitted = learned.ByGroup(ESTIMATORS[name](), ("g",)).fit(panel)
    got = frame(fitted.transform(panel), fitted.names())
    alone = []
    for g in ("a", "b", None):
        own = panel.where("g IS NULL") if g is None else panel.where(f"g = '{g}'")
        model = ESTIMATORS[name]().fit(own)
        part = frame(model.transform(own), model.names())
        alone.append(part.reindex(columns=got.columns))
    want = pd.concat(alone).sort_values(["g", "t"], na_position="last").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)
    # Saved and loaded, the same frame; other groups are named in an error, or get nulls.
    fitted.save(str(tmp_path / "m"))
    again = learned.load(spark, str(tmp_path / "m"))
    assert again.of == fitted.of and again.groups == ("g",)
    pd.testing.assert_frame_equal(frame(again.transform(panel), again.names()), got)
    others = panel.limit(3).selectExpr("'new' AS g", "t", "x", "k")
    with pytest.raises(learned.UnseenGroups, match="new"):
        again.transform(others)
    again.unseen = "null"
    assert again.transform(others).count() == 3


def test_settings_of_states(spark, panel, tmp_path):
    with pytest.raises(ValueError, match="no group columns"):
        learned.ByGroup(learned.MinMax(("x",)), ("nope",)).fit(panel)
    flat = panel.selectExpr("g", "t", "CASE WHEN g = 'b' THEN 1 ELSE x END AS x")
    with pytest.raises(ValueError, match="too few distinct quantiles.*'b'"):
        learned.ByGroup(learned.TrafficAdjuster(SPEC), ("g",)).fit(flat)
    more = panel.selectExpr("g", "t", "x", "'new' AS k")
    for kind in (learned.Ordinal("k", "error"), learned.OneHot("k")):
        with pytest.raises(ValueError, match="new"):
            kind.fit(panel).transform(more)
    assert {r["k"] for r in learned.Ordinal("k", unknown_value=-1.0).fit(panel).transform(more).collect()} == {-1.0}
    ignored = learned.OneHot("k", unknown="ignore").fit(panel).transform(more).first()
    assert (ignored["k_p"], ignored["k_q"], ignored["k_r"]) == (0, 0, 0)
    rare = learned.OneHot("k", most_categories=2, unknown="infrequent_if_exist").fit(panel)
    assert len(rare.names()) == 2 and rare.names()[1] == "k_other" and {r["k_other"] for r in rare.transform(more).collect()} == {1}
    known = rare.transform(panel).selectExpr("sum(k_other) AS o", f"sum(`{rare.names()[0]}`) AS p").first()
    assert known["o"] + known["p"] == panel.count() and known["o"] > 0
    learned.MinMax(("x",)).fit(panel).save(str(tmp_path / "v"))
    spark.createDataFrame([('{"version": 0}',)], "value string").write.mode("overwrite").text(str(tmp_path / "v" / "manifest"))
    with pytest.raises(ValueError, match="layout"):
        learned.load(spark, str(tmp_path / "v"))


def test_given_exponents(spark, panel):
    got = learned.Power(("x",), "box-cox", standardize=False, exponents=(0.5,)).fit_transform(panel).toPandas()["x"].sort_values().to_numpy()
    x = panel.toPandas()["x"].sort_values().to_numpy()
    np.testing.assert_allclose(got, (np.sqrt(x) - 1) / 0.5)


@pytest.mark.parametrize("by_group", [False, True])
def test_saved_pipeline_gives_the_same_frame(spark, panel, tmp_path, by_group):
    conf = FeatureConfig(
        SPEC, lags=(1, 2), windows=(3,), diffs=(2,), ewm=(3,), time_period=True, transit=True, periods={"lunch": (11, 14)}, holidays=("2024-01-02",), rbf={"hour": (4, (0, 23)), "time_period": (2, (0, 4))},
        harmonics=4, fourier_window=3, by_group=by_group, power=("x_rolling_mean_3",), target={"k": ("x",)}, ordinal=("x_magnitude",), onehot=("k",), unscaled=("is_weekend",),
    )
    nodes = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, degree double")
    model = pipeline.FeaturePipeline(conf, nodes).fit(panel)
    out = model.transform(panel)
    model.save(str(tmp_path / "p"), spark)
    again = pipeline.load(spark, str(tmp_path / "p"))
    assert again.of.config == conf
    columns = [c for c in out.columns if c not in ("g", "t")]
    got, want = frame(again.transform(panel), columns), frame(out, columns)
    pd.testing.assert_frame_equal(got, want, rtol=1e-12)
    assert {"x_ewm_3", "is_lunch", "is_holiday", "is_morning_rush", "time_period_rbf_1", "k_p", "k__target_0_enc", "fourier_x", "degree"} <= set(columns)
    scaled = want["x_lag_1"].astype(float)
    assert scaled.min() == 0 and scaled.max() == 1 and abs(want["x_rolling_mean_3"].mean()) < 1e-9 and set(want["x_magnitude"].dropna()) <= {0.0, 1.0, 2.0, 3.0, 4.0}
