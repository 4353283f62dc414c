"""Queries of metrics and models. The forecast that metrics look at is the value an hour before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, temporal
from ..operators import learned, metrics, models, reports, split
from ..sources import tables
from ..sources.tables import PANEL_SQL
from ..spec import PanelSpec, Task
from .register import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
SPEC = PanelSpec(("district_id",), "timestamp", ("crowd",))
GROUPS = ("district_id",)
FEATURES = ["hour", "dayofweek", "crowd_lag_1", "crowd_lag_24", "crowd_rolling_mean_24"]
_F = f"{PANEL_SQL}, f AS (SELECT * FROM (SELECT district_id, timestamp, crowd::DOUBLE AS y, lag(crowd, 1) OVER w::DOUBLE AS y_pred FROM panel WINDOW w AS (PARTITION BY district_id ORDER BY timestamp)) WHERE y_pred IS NOT NULL)"
_M = """m AS (SELECT district_id, 1 - sum(pow(y - y_pred, 2)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0) AS r2, avg(abs(y - y_pred)) AS mae, sqrt(avg(pow(y - y_pred, 2))) AS rmse,
avg(CASE WHEN abs(y) + abs(y_pred) = 0 THEN 0 ELSE 2 * abs(y - y_pred) / (abs(y) + abs(y_pred)) END) AS smape FROM f GROUP BY 1)"""


def _panel(spark, d):
    return tables.panel(spark, d).select("district_id", "timestamp", "crowd")


def _forecast(spark, d):
    w = temporal.window(SPEC)
    return _panel(spark, d).select("district_id", "timestamp", F.col("crowd").cast("double").alias("y"), F.lag("crowd").over(w).cast("double").alias("y_pred")).where("y_pred IS NOT NULL")


@query(f"""WITH {_F}, {_M}, s AS (SELECT district_id, avg(abs(crowd - b)) AS scale FROM (SELECT district_id, crowd, lag(crowd, 24) OVER (PARTITION BY district_id ORDER BY timestamp) AS b FROM panel) GROUP BY 1)
SELECT m.*, mae / nullif(scale, 0) AS mase FROM m JOIN s USING (district_id)""")
def regression_metrics(spark, d):
    scale = metrics.naive_scale(_panel(spark, d), SPEC, "crowd", 24)
    return metrics.regression_metrics(_forecast(spark, d), GROUPS, scale=scale)


_C = f"{_F}, c AS (SELECT district_id, least(floor(y / 2), 2)::BIGINT AS t, least(floor(y_pred / 2), 2)::BIGINT AS p FROM f)"


@query(f"""WITH {_C}, k AS (SELECT DISTINCT district_id, unnest([t, p]) AS k FROM c),
n AS (SELECT k.district_id, k, count(*) FILTER (t = k) AS n_t, count(*) FILTER (p = k) AS n_p, count(*) FILTER (t = k AND p = k) AS hit FROM k JOIN c USING (district_id) GROUP BY ALL),
r AS (SELECT *, coalesce(hit / nullif(n_p, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(n_t, 0)::DOUBLE, 0) AS recall FROM n)
SELECT district_id, sum(hit) / sum(n_t)::DOUBLE AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)) AS f1 FROM r GROUP BY 1""")
def classification_metrics(spark, d):
    level = lambda c: F.least(F.floor(F.col(c) / 2), F.lit(2)).cast("long")
    return metrics.classification_metrics(_forecast(spark, d).withColumns({"y": level("y"), "y_pred": level("y_pred")}), GROUPS)


@query(f"""WITH {_F}, {_M}, l AS (UNPIVOT (SELECT r2, mae, rmse, smape FROM m) ON r2, mae, rmse, smape INTO NAME metric VALUE v)
SELECT metric, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM l GROUP BY 1""")
def metric_quantiles(spark, d):
    return metrics.metric_quantiles(metrics.regression_metrics(_forecast(spark, d), GROUPS), ("r2", "mae", "rmse", "smape"))


@query(f"WITH {_F}, {_M} SELECT avg(r2) AS r2, avg(mae) AS mae, avg(rmse) AS rmse, avg(smape) AS smape FROM m")
def metric_means(spark, d):
    return metrics.mean_metrics(metrics.regression_metrics(_forecast(spark, d), GROUPS), ("r2", "mae", "rmse", "smape"))


_RUNS = "r AS (SELECT event_type AS identifier, (user_id % 3)::INTEGER AS horizon, event_id AS run_id, value AS train_time, value / 7 AS predict_time, value + value / 7 AS total_time, user_id AS train_size, event_id % 50 AS test_size, CASE WHEN event_id % 97 = 0 THEN 'E' || event_id END AS error FROM events)"


@query(f"""WITH {_RUNS} SELECT identifier, horizon, avg(train_time) AS train_time_mean, stddev_samp(train_time) AS train_time_std, avg(predict_time) AS predict_time_mean, stddev_samp(predict_time) AS predict_time_std,
avg(total_time) AS total_time_mean, stddev_samp(total_time) AS total_time_std, arg_min(train_size, run_id) AS train_size, arg_min(test_size, run_id) AS test_size, arg_min(error, run_id) FILTER (error IS NOT NULL) AS error FROM r GROUP BY ALL""")
def timing_summary(spark, d):
    e = tables.read(spark, d, "events")
    error = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("E"), F.col("event_id")))
    return metrics.timing_summary(e.select(F.col("event_type").alias("identifier"), (F.col("user_id") % 3).cast("int").alias("horizon"), F.col("event_id").alias("run_id"), F.col("value").alias("train_time"), (F.col("value") / 7).alias("predict_time"), (F.col("value") + F.col("value") / 7).alias("total_time"), F.col("user_id").alias("train_size"), (F.col("event_id") % 50).alias("test_size"), error.alias("error")))


@query("SELECT feature, importance FROM (SELECT p_brand AS feature, avg(p_retailprice) AS importance FROM part GROUP BY 1) ORDER BY importance DESC, feature LIMIT 10")
def importance_topk(spark, d):
    return metrics.importance_table(tables.read(spark, d, "part").select(F.col("p_brand").alias("feature"), F.col("p_retailprice").alias("importance")), top=10)


@query("SELECT feature, importance / sum(importance) OVER () AS importance FROM (SELECT p_brand AS feature, avg(p_retailprice) AS importance FROM part GROUP BY 1)")
def importance_normalised(spark, d):
    return metrics.importance_table(tables.read(spark, d, "part").select(F.col("p_brand").alias("feature"), F.col("p_retailprice").alias("importance")), "normalised")


@query("""SELECT trial, param, value, coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0) AS scaled FROM
(SELECT p_partkey AS trial, 'p_size' AS param, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part) WINDOW w AS (PARTITION BY param)""")
def trial_params(spark, d):
    return metrics.min_max_params(tables.read(spark, d, "part").withColumnRenamed("p_partkey", "trial"), ("p_size", "p_retailprice"))


@query(f"WITH {PANEL_SQL} SELECT district_id, timestamp, crowd FROM panel ORDER BY timestamp, district_id, crowd LIMIT 100")
def first_training_rows(spark, d):
    return reports.first_rows(_panel(spark, d), 100, "timestamp")


_TRIALS = "t AS (SELECT p_partkey AS trial, p_brand AS param, p_retailprice::DOUBLE AS value FROM part)"


def _trials(spark, d):
    return tables.read(spark, d, "part").select(F.col("p_partkey").alias("trial"), F.col("p_brand").alias("param"), F.col("p_retailprice").cast("double").alias("value"))


@query(f"WITH {_TRIALS} SELECT * FROM t WHERE value IS NOT NULL ORDER BY value DESC, trial LIMIT 20")
def best_trials(spark, d):
    return reports.best_trials(_trials(spark, d), 20, "value", "trial", largest=True)


@query(f"""WITH {_TRIALS}, w AS (SELECT *, count(value) OVER f AS n, quantile_cont(value, 0.5) OVER f AS m, lag(value) OVER (PARTITION BY param ORDER BY trial) AS b FROM t WINDOW f AS (PARTITION BY param ORDER BY trial ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT trial, param, CASE WHEN n = 5 THEN m END AS median, coalesce(value - b, 0) AS took FROM w""")
def smoothed_trials(spark, d):
    w = reports.trial_window("trial", "param")
    return _trials(spark, d).select("trial", "param", reports.centred_median("value", 5, w).alias("median"), reports.since_first("value", w).alias("took"))


@query(f"WITH {PANEL_SQL} SELECT district_id, avg(crowd) FILTER (hour(timestamp) % 4 = 0) AS h_0, avg(crowd) FILTER (hour(timestamp) % 4 = 1) AS h_1, avg(crowd) FILTER (hour(timestamp) % 4 = 3) AS h_3 FROM panel GROUP BY 1")
def metrics_by_horizon(spark, d):
    return reports.by_horizon(_panel(spark, d).withColumn("horizon", F.hour("timestamp") % 4), "district_id", "horizon", "crowd", [0, 1, 3])


@query(f"WITH {PANEL_SQL} SELECT p.district_id, p.timestamp, p.crowd AS y, q.crowd + 1 AS y_pred FROM panel p JOIN panel q ON p.district_id = q.district_id AND p.timestamp = q.timestamp WHERE hour(q.timestamp) % 2 = 0")
def aligned_predictions(spark, d):
    p = _panel(spark, d)
    truth = p.withColumnRenamed("crowd", "y")
    return reports.aligned(truth, p.where(F.hour("timestamp") % 2 == 0).select("district_id", "timestamp", (F.col("crowd") + 1).alias("y_pred")), "district_id", "timestamp")


def _supervised(spark, d):
    p = _panel(spark, d)
    p = p.withColumns(calendar.calendar_parts("timestamp", ("hour", "dayofweek")))
    p = temporal.add_temporal(p, SPEC, (1, 24), (24,), ("mean",))
    w = temporal.window(SPEC)
    p = p.withColumn("target_crowd", F.lead("crowd").over(w)).where("target_crowd IS NOT NULL")
    return split.quantile_split(p, "timestamp", 0.1)


def _fit_predict(spark, d, kind):
    s = _supervised(spark, d)
    m = models.train(s.where("split = 'train'"), FEATURES, ["target_crowd"], Task.REGRESSION, kind, models.DEFAULTS)
    return m.transform(s.where("split = 'test'"), positive=True, whole=True).select("district_id", "timestamp", "target_crowd", "pred_target_crowd")


@query()
def gbt_forecast(spark, d):
    return _fit_predict(spark, d, "gbt")


@query()
def rf_forecast(spark, d):
    return _fit_predict(spark, d, "rf")


@query()
def rf_demand_levels(spark, d):
    s = _supervised(spark, d)
    levels = learned.demand_levels(s.where("split = 'train'"), "target_crowd", 3, GROUPS, ("timestamp",))
    edges = learned.level_edges(levels, "target_crowd", GROUPS, upper_only=True)
    s = learned.apply_levels(s, "target_crowd", edges, GROUPS)
    m = models.train(s.where("split = 'train'"), FEATURES, ["mask"], Task.CLASSIFICATION, "rf", models.DEFAULTS)
    return m.transform(s.where("split = 'test'")).select("district_id", "timestamp", "mask", F.col("pred_mask").cast("int").alias("pred_mask"))


@query()
def scalability_curve(spark, d):
    s = split.increments(_supervised(spark, d), "timestamp", 3)
    return models.learning_curve(s, 3, FEATURES, "target_crowd", GROUPS, "rf", models.DEFAULTS)
