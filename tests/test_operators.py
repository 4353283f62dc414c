import datetime as dt
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import clean, graph, metrics, models, spatial
from tidegrid.plans import catalog
from tidegrid.plans.pipeline import FeaturePipeline, save_features
from tidegrid.sources import files
from tidegrid.spec import ColumnMapping, FeatureConfig, PanelSpec
from tidegrid.streaming.demand import stream_counts

T = dt.datetime


def trips(spark):
    rows = [
        (1, T(2024, 1, 1, 8), T(2024, 1, 1, 8, 30), "a", "b"), (1, T(2024, 1, 1, 8), T(2024, 1, 1, 8, 30), "a", "b"), (1, T(2024, 1, 1, 9), T(2024, 1, 1, 9, 30), "a", "b"),
        (2, T(2024, 1, 1, 10), T(2024, 1, 1, 9), "b", "c"), (3, T(2024, 1, 1, 8), T(2024, 1, 1, 8, 0, 59), "a", "b"), (4, T(2024, 1, 1), T(2024, 1, 2), "a", "c"),
        (5, T(2024, 1, 1, 8), T(2024, 1, 1, 8, 2), "a", "a"), (6, T(2024, 1, 1, 8), T(2024, 1, 1, 8, 3), "a", "a"), (7, None, None, "a", "b"), (8, T(2024, 1, 1, 8), None, "a", "b"), (9, T(2024, 1, 1, 8), T(2024, 1, 1, 9), None, "b"),
    ]
    return spark.createDataFrame(rows, "TripId long, StartTime timestamp_ntz, EndTime timestamp_ntz, StartStationId string, EndStationId string")


def test_cleaning_of_edge_rows(spark):
    steps = dict(clean.clean_steps(trips(spark)))
    assert {r["TripId"] for r in steps["missing"].collect()} == {1, 2, 3, 4, 5, 6, 8}
    dedup = steps["duplicates"].where("TripId = 1").collect()
    assert len(dedup) == 1 and dedup[0]["StartTime"].hour == 8
    times = {r["TripId"]: r for r in steps["times"].collect()}
    assert set(times) == {1, 2, 4, 5, 6} and times[2]["duration_minutes"] == 60 and times[4]["duration_minutes"] == 1440
    assert {r["TripId"] for r in steps["round_trips"].collect()} == {1, 2, 4, 6}
    done, audit = clean.clean_trips(trips(spark))
    assert all(clean.quality_checks(done).first().asDict().values())
    assert [r["step"] for r in audit.collect()] == ["input", "missing", "duplicates", "times", "round_trips", "outliers"]


def test_columns_and_times(spark):
    raw = spark.createDataFrame([("2024-01-01 08:00:00", "01/02/2024 09:00", "1", "2"), ("bad", "01/02/2024 10:00", "1", "x")], "started_at string, ended_at string, from_station string, to_station string")
    df = clean.canonical_columns(raw, ColumnMapping("started_at", "ended_at", "from_station", "to_station"))
    got = clean.parse_times(df, ["StartTime", "EndTime"]).collect()
    assert got[0]["StartTime"] == T(2024, 1, 1, 8) and got[1]["StartTime"] is None and got[0]["EndTime"] == T(2024, 1, 2, 9)
    with pytest.raises(ValueError, match="started_at"):
        clean.canonical_columns(raw, ColumnMapping())
    assert dict(files.numeric_if_all(df, ["StartStationId", "EndStationId"]).dtypes)["StartStationId"] == "bigint"
    assert dict(files.numeric_if_all(df, ["EndStationId"]).dtypes)["EndStationId"] == "string"


def test_months_of_paths():
    assert files.month_of("2016/1_January/") == "2016-01" and files.month_of("x/2016/12_December/a.csv") == "2016-12"
    assert files.month_of("201601-tripdata.zip") == "2016-01" and files.month_of("201613-x.zip") is None and files.month_of("a.csv") is None


def test_files_by_month(spark, tmp_path):
    root = tmp_path / "raw"
    (root / "2016" / "1_January").mkdir(parents=True)
    (root / "2016" / "1_January" / "a.csv").write_bytes("Starttime , Name\n2016-01-05 08:00:00,Zoë\nbad,b\n".encode("latin-1"))
    with zipfile.ZipFile(root / "201602-x.zip", "w") as z:
        z.writestr("one.csv", "starttime,name\n2016-02-01 00:00:00,x\n")
        z.writestr("two.csv", "starttime,other\n2016-02-02 00:00:00,y\n")
        z.writestr("__MACOSX/two.csv", "junk")
    frames, errors = files.load_months(spark, str(root))
    rows = {(r["name"], r["other"], r["yearmonth"]) for r in frames["all"].collect()}
    assert not errors and rows == {("Zoë", None, "2016-01"), ("b", None, None), ("x", None, "2016-02"), (None, "y", "2016-02")}
    assert [tuple(r) for r in files.source_summary(spark, str(root)).collect()] == [("2016-01", 1, 1), ("2016-02", 1, 2)]
    assert list(files.load_months(spark, str(root), ["2016-02", "2030-01"], merge=False)[0]) == ["2016-02"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "2", 5), ("3", "4", 6)], "StartStationId string, EndStationId string, v int").withColumn("split", F.lit("train")).withColumn("empty", F.lit(None).cast("int"))
    files.save_cleaned(df.drop("empty"), str(tmp_path / "c"), original={"v": "value"})
    back = spark.read.parquet(str(tmp_path / "c"))
    assert dict(back.dtypes)["StartStationId"] == "bigint" and "value" in back.columns and "v" in files.load_meta(spark, str(tmp_path / "c"))["columns"]
    save_features(df, str(tmp_path / "f"))
    got = files.load_features(spark, str(tmp_path / "f"), equals={"split": "train"})
    assert got.columns == ["StartStationId", "EndStationId", "v"] and got.count() == 2
    with pytest.raises(ValueError):
        save_features(df.where("v > 9"), str(tmp_path / "g"))
    assert files.read_backup_time(spark, str(tmp_path / "t")) is None
    files.write_backup_time(spark, str(tmp_path / "t"), T(2024, 1, 2, 3, 4, 5))
    assert files.read_backup_time(spark, str(tmp_path / "t")).isoformat() == "2024-01-02T03:04:05+00:00"
    assert files.feature_path(5, 24, "city", "x", "parquet") == "city_h5_w24_x.parquet"


def test_adjacency(spark):
    pts = spark.createDataFrame([("P1", 0.0, 0.0), ("P2", 400.0, 0.0), ("P3", 800.0, 0.0), ("P4", 9e4, 0.0)], "id string, x double, y double")
    got = {r["id"]: r["neighbours"] for r in spatial.adjacency_lists(pts, spatial.neighbours_within(pts, 500, "id"), "id").collect()}
    assert got == {"P1": ["P2"], "P2": ["P1", "P3"], "P3": ["P2"], "P4": []}
    ring = lambda a, b: f"POLYGON (({a} {b}, {a + 1} {b}, {a + 1} {b + 1}, {a} {b + 1}, {a} {b}))"
    polys = spark.createDataFrame([("A", ring(0, 0)), ("B", ring(1, 0)), ("C", ring(-1, 0)), ("D", ring(9, 9))], "id string, w string").select("id", spatial.parse_polygon(F.col("w")).alias("ring"))
    pairs = {tuple(r) for r in spatial.polygon_neighbours(polys, 2.0, "id").collect()}
    assert pairs == {("A", "B"), ("B", "A"), ("A", "C"), ("C", "A")}
    with pytest.raises(ValueError):
        spatial.neighbours_within(pts, None, "id")


def test_graph_of_a_path_and_a_triangle(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node long")
    edges = graph.undirected(spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 5), (3, 5), (5, 3), (2, 2)], "a long, b long"))
    assert {r["node"]: r["component"] for r in graph.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}
    assert {r["node"]: r["clustering"] for r in graph.clustering(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 0}
    cb = {r["node"]: r for r in graph.closeness_betweenness(nodes, edges).collect()}
    assert cb[1]["betweenness"] == pytest.approx(2 / 30) and cb[1]["closeness"] == pytest.approx(1.0 * 2 / 6) and cb[6]["closeness"] == 0
    pr = {r["node"]: r["pagerank"] for r in graph.pagerank(nodes, edges).collect()}
    assert sum(pr.values()) == pytest.approx(1) and pr[1] > pr[0] == pytest.approx(pr[2])
    ev = {r["node"]: r["eigenvector"] for r in graph.eigenvector(nodes, edges).collect()}
    assert ev[3] == 0 and ev[1] == pytest.approx(np.sqrt(0.5), abs=1e-3)


def test_graph_queries_take_all_points(spark, tmp_path):
    at = [0.0, 0.02, 0.04, 0.9, 0.92]
    rows = [(i, [x, 0.0]) for i, x in zip((3, 499, 500, 501, 70_000), at)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda q: {r[0]: r[1] for r in catalog.QUERIES[q](spark, str(tmp_path)).collect()}
    pairs = {tuple(r) for r in catalog.QUERIES["adjacency_radius"](spark, str(tmp_path)).collect()}
    assert pairs == {(3, 499), (499, 3), (499, 500), (500, 499), (501, 70_000), (70_000, 501)}
    assert run("adjacency_lists") == {3: "499", 499: "3,500", 500: "499", 501: "70000", 70_000: "501"}
    assert run("graph_components") == {3: 3, 499: 3, 500: 3, 501: 501, 70_000: 501}
    assert run("degree") == {3: 1, 499: 2, 500: 1, 501: 1, 70_000: 1} and set(run("clustering")) == set(run("node_features")) == {r[0] for r in rows}
    assert run("betweenness") == pytest.approx({3: 0, 499: 2 / 12, 500: 0, 501: 0, 70_000: 0})
    assert run("closeness") == pytest.approx({3: 1 / 3, 499: 0.5, 500: 1 / 3, 501: 0.25, 70_000: 0.25})
    assert run("eigenvector") == pytest.approx({3: 0.5, 499: 0.5**0.5, 500: 0.5, 501: 0, 70_000: 0}, abs=1e-3)


def test_models_learn_and_persist(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("f"), (F.col("id") % 2).cast("double").alias("k"), F.col("id")).withColumn("y", F.col("f") * 2)
    m = models.train(df, ["f", "k"], ["y"], "regression", "rf", {"n_estimators": 5, "max_depth": 5})
    got = metrics.regression_metrics(m.transform(df).withColumn("g", F.lit(1)), ("g",), "y", "pred_y").first()
    assert got["r2"] > 0.9 and got["mase"] is None
    m.save(str(tmp_path / "m"))
    again = models.Fitted.load(str(tmp_path / "m")).transform(df).agg(F.sum("pred_y")).first()[0]
    assert again == pytest.approx(m.transform(df).agg(F.sum("pred_y")).first()[0])
    assert m.importances().where("feature = 'f'").first()["importance"] > 0.5
    bench = models.Benchmark(lambda who, h: (df, df) if who == "a" else (df, df.select("nothing")), ["f"], "y", params={"n_estimators": 2}, warmups=0, runs=1)
    runs = {r["identifier"]: r for r in bench.run(spark, ["a", "b"], [1]).collect()}
    assert runs["a"]["error"] is None and runs["a"]["total_time"] > 0 and runs["b"]["error"]
    with pytest.raises(ValueError):
        models.estimator("regression", "magic")


@pytest.mark.parametrize("name, kind", [("gbt_forecast", "gbt"), ("rf_forecast", "rf"), ("rf_demand_levels", "rf"), ("scalability_curve", "rf")])
def test_model_queries_train_whole_models(spark, tmp_path, monkeypatch, name, kind):
    rows = [(f"e{i % 2}", T(2024, 1, 1) + dt.timedelta(hours=i // 2), float(i % 9)) for i in range(400)]
    spark.createDataFrame(rows, "event_type string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "events.parquet"))

    class Seen(Exception):
        pass

    def estimator(task, kind, params=None, seed=42):
        raise Seen(kind, params)

    monkeypatch.setattr(models, "estimator", estimator)
    with pytest.raises(Seen) as e:
        catalog.QUERIES[name](spark, str(tmp_path))
    assert e.value.args[0] == kind and e.value.args[1] == models.DEFAULTS


def test_search_closes_in():
    best, value, log = models.search(lambda p: (p["learning_rate"] - 0.1) ** 2, 30)
    assert abs(best["learning_rate"] - 0.1) < 0.05 and len(log) == 30 and value == min(x["value"] for x in log)
    assert models.shrink_space({"d": (0, 10, True)}, {"d": 9}) == {"d": (6, 10, True)}
    assert models.load_params('{"x": {"regression": {"5": {"a": 1}}}}', "x", "regression", 5) == {"a": 1} and models.load_params({}, "x", "regression", 5) == models.DEFAULTS


def test_forest_finds_what_lies_apart():
    x = np.r_[np.random.default_rng(0).normal(size=(300, 2)), [[12.0, 12.0], [-11.0, 9.0]]]
    s = clean.IsolationForest().fit(x).score(x)
    assert set(np.argsort(-s)[:2]) == {300, 301}


def test_forest_threshold_is_of_all_rows(spark):
    # A third of the rows are alike: a sample by their values holds all of them or none.
    df = spark.range(3000).select(F.col("id").alias("TripId"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("v"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(2)).alias("w")).cache()
    kept = clean.drop_outliers_forest(df, {"v": F.col("v"), "w": F.col("w")}, sample=300)
    ids = {r["TripId"] for r in kept.collect()}
    assert kept.columns == df.columns and abs(len(ids) - 2700) <= 3 and set(range(0, 3000, 3)) <= ids


def test_pipeline_reads_no_future(spark):
    rows = [("a", T(2024, 1, 1) + dt.timedelta(hours=i), float(i % 7 + i % 3)) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, t timestamp_ntz, x double")
    conf = FeatureConfig(PanelSpec(("g",), "t", ("x",)), lags=(1, 2), windows=(3,), diffs=(2,), harmonics=4, fourier_window=3)
    model = FeaturePipeline(conf).fit(df)
    cut = T(2024, 1, 3)
    whole = model.transform(df).where(F.col("t") <= F.lit(cut)).orderBy("t").toPandas()
    part = model.transform(df.where(F.col("t") <= F.lit(cut))).orderBy("t").toPandas()
    assert whole.equals(part) and {"x_lag_1", "x_rolling_mean_3", "x_diff_2", "fourier_x", "x_magnitude", "hour_rbf_1"} <= set(whole.columns)


def test_stream_counts(spark, tmp_path):
    rows = [(T(2024, 1, 1, h, m), s) for h in (8, 9) for m in (0, 30) for s in ("a", "b")]
    spark.createDataFrame(rows, "StartTime timestamp_ntz, StartStationId string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("StartTime timestamp_ntz, StartStationId string").parquet(str(tmp_path / "in"))
    q = stream_counts(stream, "StartTime", "StartStationId").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["timestamp"].hour, r["station_id"], r["departures"]) for r in spark.table("counts").collect()}
    assert got == {(8, "a", 2), (8, "b", 2), (9, "a", 2), (9, "b", 2)}


def test_points_are_searched_by_square(spark, monkeypatch):
    """No edge is a row, and squares dealt to several groups, batches of sources and equal places change nothing."""
    import numpy as np

    from tidegrid.operators import near

    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(0, 0.5, (25, 2)), np.zeros((4, 2)), rng.normal(5, 0.2, (6, 2)), [[2.0**40, -7.0]]])
    place = {int(k) * 3: (float(a), float(b)) for k, (a, b) in enumerate(xy)}
    rows = [(k, *p) for k, p in place.items()] + [(1, None, 0.0), (2, float("nan"), 0.0), (4, float("inf"), 0.0)]
    monkeypatch.setattr(near, "OWN", 3)
    got = near.Near(spark.createDataFrame(rows, "id long, x double, y double"), 0.5, "id")
    around = {a: sorted(b for b, q in place.items() if a != b and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 0.25) for a, p in place.items()}
    lists = {}
    for r in got.neighbours().collect():
        lists.setdefault(r["node"], []).extend(r["neighbours"])
    assert lists == around
    triangles = {a: sum(c in around[b] for b in n for c in n) // 2 for a, n in around.items()}
    assert {r["node"]: (r["d"], r["t"]) for r in got.triangles().collect()} == {a: (len(n), triangles[a]) for a, n in around.items()}
    steps, paths = {}, {}
    for s in place:
        steps[s, s], paths[s, s], front = 0, 1, [s]
        while front:
            new = {b for a in front for b in around[a] if (s, b) not in steps}
            for b in new:
                paths[s, b] = sum(paths[s, a] for a in front if b in around[a])
            steps |= {(s, b): steps[s, front[0]] + 1 for b in new}
            front = sorted(new)
    through = {v: sum(paths[s, v] * paths[v, t] / paths[s, t] for (s, t), k in steps.items() if v not in (s, t) and (s, v) in steps and (v, t) in steps and steps[s, v] + steps[v, t] == k) for v in place}
    for r in got.searched(True, at_once=800).collect():
        own = [k for (s, _), k in steps.items() if s == r["node"] and k]
        assert (r["far"], r["reached"], r["through"]) == pytest.approx((sum(own), len(own), through[r["node"]]))


def test_searches_keep_no_table_of_distances(spark, monkeypatch):
    """Crowded parts, several batches, pairs at the radius: sums equal those of all distances, and no level of searches is a table."""
    import numpy as np

    from tidegrid.operators import near

    rng, tables, write = np.random.default_rng(9), [], near.written
    xy = np.concatenate([rng.normal(0, 0.06, (60, 2)), rng.uniform(-1, 1, (90, 2)), rng.uniform(3, 4, (20, 2)), np.zeros((2, 2))])
    xy = np.round(xy / 0.05) * 0.05
    xy = np.concatenate([xy, [[1e300, 0.0]]])
    n = len(xy)
    with np.errstate(over="ignore"):
        linked = ((xy[:, None] - xy) ** 2).sum(axis=2) <= 0.25 * 0.25
    assert (near._near(xy[:-1, 0], xy[:-1, 1], xy[:-1, 0], xy[:-1, 1], 0.25) == linked[:-1, :-1]).all()
    np.fill_diagonal(linked, False)
    steps, paths, level = np.where(np.eye(n), 0, -1), np.eye(n), 0
    while (steps == level).any():
        got = np.where(steps == level, paths, 0) @ linked
        new = (got > 0) & (steps < 0)
        level += 1
        steps[new], paths[new] = level, got[new]
    through = np.zeros(n)
    for s in range(n):
        share = np.zeros(n)
        for k in range(steps[s].max(), 1, -1):
            back = linked @ np.where(steps[s] == k, (1 + share) / np.where(paths[s], paths[s], 1), 0)
            share = np.where(steps[s] == k - 1, back * paths[s], share)
        through += share
    monkeypatch.setattr(near, "written", lambda df, name: tables.append(name) or write(df, name))
    monkeypatch.setattr(near, "TILE", 20)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    got = near.Near(points, 0.25, "id")
    for between in (True, False):
        for r in got.searched(between, at_once=n * 40).collect():
            far = steps[r["node"]]
            assert (r["far"], r["reached"]) == (far[far > 0].sum(), (far > 0).sum())
            assert r["through"] == pytest.approx(through[r["node"]] if between else 0)
    assert sorted(set(tables)) == ["near", "searched", "sources"]


def test_sums_by_strips(spark):
    import numpy as np

    from tidegrid.operators import near

    rng = np.random.default_rng(7)
    for n, side, radius in ((1, 1, 0.5), (300, 4, 0.5), (800, 1, 1.0), (500, 0.1, 0.03)):
        for step in (None, radius / 5):  # a grid has many pairs at the radius
            x, y = rng.uniform(-side, side, (2, n)) + 3
            if step:
                x, y = np.round(x / step) * step, np.round(y / step) * step
            own, v = rng.random(n) < 0.5, rng.random(n) ** 8
            for values in (np.ones(n), v):
                want = np.zeros(n)
                for at, around, close in near.blocks(x, y, own, radius):
                    want[at] = close @ values[around]
                for pairs in (1000, 500_000):
                    got = near.strip_sums(x, y, own, radius, values, pairs)
                    assert (got == want).all() if values is not v else got == pytest.approx(want, rel=1e-12, abs=1e-15)
    x, y = rng.uniform(0, 1, (2, 2600))  # one square of so many points that its task takes strips
    assert len(x) ** 2 > near.MANY
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    d = (((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) <= 0.81).sum(axis=1) - 1
    assert {r["node"]: r["d"] for r in near.Near(points, 0.9, "id").degrees().collect()} == dict(enumerate(d.tolist()))
