"""Checks and sinks of reports."""

import pytest

from tidegrid.operators import reports


def test_checks(monkeypatch, spark):
    df = spark.createDataFrame([("a", 1)], "station string, time long")
    reports.check_index(df, {"station": "string", "time": "bigint"})
    with pytest.raises(ValueError, match="missing"):
        reports.check_index(df, {"horizon": "int"})
    with pytest.raises(ValueError, match="another type"):
        reports.check_index(df, {"time": "string"})
    monkeypatch.setenv("TIDEGRID_A", "x")
    assert reports.env_variable("TIDEGRID_A") == "x" and reports.env_variable("TIDEGRID_B", "y") == "y"
    with pytest.raises(ValueError):
        reports.env_variable("TIDEGRID_B", required=True)
    reports.check_settings(["a"], {"a": 0})
    with pytest.raises(ValueError):
        reports.check_settings(["a", "b"], {"a": 1, "b": ""})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    for name, save in (("p", reports.save_predictions), ("m", reports.save_metrics), ("b", reports.save_benchmark)):
        save(df, str(tmp_path / name))
        assert spark.read.option("header", True).schema("k string, v double").csv(str(tmp_path / name)).exceptAll(df).isEmpty()
    assert any(p.name.endswith(".gz") for p in (tmp_path / "b").iterdir())
    reports.save_bins(df, str(tmp_path / "bins"))
    assert spark.read.schema("k string, v double").json(str(tmp_path / "bins")).exceptAll(df).isEmpty()


def test_centred_median(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([5, 1, 9, 3, None, 2])], "trial int, v double")
    got = [r[0] for r in df.select("trial", reports.centred_median("v", 3, reports.trial_window()).alias("m")).orderBy("trial").select("m").collect()]
    assert got == [None, 5.0, 3.0, None, None, None]
