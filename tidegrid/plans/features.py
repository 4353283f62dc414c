"""Queries of targets, splits, calendar and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, temporal
from ..operators import split, targets
from ..sources import tables
from ..sources.tables import PANEL_SQL
from ..spec import PanelSpec
from .register import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
SPEC = PanelSpec(("district_id",), "timestamp", ("crowd",))
W_SQL = "WINDOW w AS (PARTITION BY district_id ORDER BY timestamp)"


def _panel(spark, d):
    return tables.panel(spark, d).select("district_id", "timestamp", "crowd")


_LEADS = ", ".join(f"lead(crowd, {h}) OVER w AS target_crowd_h{h}" for h in range(1, 5))


@query(f"""WITH {PANEL_SQL}, t AS (SELECT district_id, timestamp, crowd, {_LEADS} FROM panel {W_SQL})
SELECT district_id, timestamp, crowd, h::INTEGER AS horizon, target_crowd FROM ({' UNION ALL '.join(f'SELECT district_id, timestamp, crowd, {h} AS h, target_crowd_h{h} AS target_crowd FROM t' for h in range(1, 5))}) WHERE target_crowd IS NOT NULL""")
def targets_long(spark, d):
    return targets.horizon_targets(_panel(spark, d), SPEC, 4)


@query(f"WITH {PANEL_SQL}, t AS (SELECT district_id, timestamp, crowd, {_LEADS} FROM panel {W_SQL}) SELECT * FROM t WHERE {' AND '.join(f'target_crowd_h{h} IS NOT NULL' for h in range(1, 5))}")
def targets_wide(spark, d):
    return targets.horizon_targets(_panel(spark, d), SPEC, 4, shape="wide")


@query(f"WITH {PANEL_SQL} SELECT * FROM (SELECT district_id, timestamp, crowd, lead(crowd, 24) OVER w AS target_crowd FROM panel {W_SQL}) WHERE target_crowd IS NOT NULL")
def targets_single(spark, d):
    return targets.horizon_targets(_panel(spark, d), SPEC, 24, 24)


@query(f"""WITH {PANEL_SQL}, q AS (SELECT quantile_cont(epoch_us(timestamp)::DOUBLE, 0.7) AS a, quantile_cont(epoch_us(timestamp)::DOUBLE, 0.9) AS b FROM panel)
SELECT district_id, timestamp, crowd, CASE WHEN epoch_us(timestamp) <= a THEN 'train' WHEN epoch_us(timestamp) <= b THEN 'val' ELSE 'test' END AS split FROM panel, q""")
def split_quantile(spark, d):
    return split.quantile_split(_panel(spark, d), "timestamp", 0.1, 0.2)


@query(f"""WITH {PANEL_SQL}, q AS (SELECT quantile_cont(epoch_us(timestamp)::DOUBLE, 0.7) AS a FROM panel)
SELECT district_id, timestamp, crowd, CASE WHEN epoch_us(timestamp) < a THEN 'train' ELSE 'test' END AS split FROM panel, q""")
def temporal_split(spark, d):
    return split.temporal_split(_panel(spark, d), "timestamp", 0.3)


@query(f"""WITH {PANEL_SQL}, q AS (SELECT quantile_cont(epoch_us(timestamp)::DOUBLE, 0.9) AS a FROM panel),
r AS (SELECT quantile_cont(epoch_us(timestamp)::DOUBLE, 0.1) AS b FROM panel, q WHERE epoch_us(timestamp) <= a)
SELECT district_id, timestamp, crowd, CASE WHEN epoch_us(timestamp) > a THEN 'test' WHEN epoch_us(timestamp) <= b THEN 'burn' ELSE 'train' END AS split FROM panel, q, r""")
def burn_in_split(spark, d):
    return split.burn_in_split(_panel(spark, d), "timestamp")


_RANKS = f"WITH {PANEL_SQL}, t AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM panel))"


@query(f"{_RANKS} SELECT district_id, timestamp, crowd, CASE WHEN k <= floor(n * 0.2) THEN 1 WHEN k <= floor(n * 0.4) THEN 2 WHEN k <= floor(n * 0.6) THEN 3 WHEN k <= floor(n * 0.8) THEN 4 ELSE 5 END::INTEGER AS increment FROM panel JOIN t USING (timestamp)")
def increments(spark, d):
    return split.increments(_panel(spark, d), "timestamp", 5)


@query(f"{_RANKS} SELECT district_id, timestamp, crowd, CASE WHEN k <= n - 3 * (n // 4) THEN 0 ELSE (k - (n - 3 * (n // 4)) - 1) // (n // 4) + 1 END::INTEGER AS fold FROM panel JOIN t USING (timestamp)")
def tscv_folds(spark, d):
    return split.time_series_folds(_panel(spark, d), "timestamp", 3)


@query(f"""WITH {PANEL_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY timestamp, district_id) AS k, count(*) OVER () AS n FROM panel)
SELECT district_id, timestamp, crowd, CASE WHEN k <= n - 5 * (n // 6) THEN 0 ELSE (k - (n - 5 * (n // 6)) - 1) // (n // 6) + 1 END::INTEGER AS fold FROM r""")
def position_folds(spark, d):
    return split.position_folds(_panel(spark, d), ("timestamp", "district_id"), 5)


@query(f"WITH {PANEL_SQL} SELECT district_id, timestamp, crowd FROM panel WHERE district_id IN (SELECT event_type FROM events WHERE event_type LIKE '%i%')")
def common_groups(spark, d):
    some = tables.read(spark, d, "events", ["event_type"]).where("event_type LIKE '%i%'").select(F.col("event_type").alias("district_id"))
    return split.common_groups(_panel(spark, d), some, ("district_id",))[0]


@query("""SELECT event_id, year(ts)::INTEGER AS year, quarter(ts)::INTEGER AS quarter, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute,
second(ts)::INTEGER AS second, dayofyear(ts)::INTEGER AS dayofyear, (isodow(ts) - 1)::INTEGER AS dayofweek, weekofyear(ts)::INTEGER AS weekofyear FROM events""")
def calendar_parts(spark, d):
    parts = ("year", "quarter", "month", "day", "hour", "minute", "second", "dayofyear", "dayofweek", "weekofyear")
    return tables.read(spark, d, "events").select("event_id", *[c.alias(n) for n, c in calendar.calendar_parts("ts", parts).items()])


@query("SELECT event_id, CASE WHEN hour(ts) <= 6 THEN 0 WHEN hour(ts) <= 9 THEN 1 WHEN hour(ts) <= 17 THEN 2 WHEN hour(ts) <= 20 THEN 3 ELSE 4 END::INTEGER AS time_period FROM events")
def time_period(spark, d):
    return tables.read(spark, d, "events").select("event_id", calendar.time_period("ts").alias("time_period"))


_WORK = "isodow(ts) <= 5"


@query(f"""SELECT event_id, (hour(ts) BETWEEN 7 AND 9 AND {_WORK})::INTEGER AS is_morning_rush, (hour(ts) BETWEEN 17 AND 20 AND {_WORK})::INTEGER AS is_evening_rush,
(hour(ts) BETWEEN 9 AND 18 AND {_WORK})::INTEGER AS is_business_hours, (hour(ts) BETWEEN 8 AND 15 AND {_WORK})::INTEGER AS is_school_hours, (NOT {_WORK})::INTEGER AS is_weekend FROM events""")
def transit_flags(spark, d):
    return tables.read(spark, d, "events").select("event_id", *[c.alias(n) for n, c in calendar.transit_flags("ts").items()])


@query("SELECT event_id, (hour(ts) BETWEEN 11 AND 14)::INTEGER AS is_lunch, (hour(ts) >= 22 OR hour(ts) <= 5)::INTEGER AS is_night FROM events")
def custom_periods(spark, d):
    return tables.read(spark, d, "events").select("event_id", *[c.alias(n) for n, c in calendar.custom_periods("ts", {"lunch": (11, 14), "night": (22, 5)}).items()])


_HOLIDAYS = ["2024-01-01", "2024-01-15", "2024-01-16"]
_IN = lambda k: f"(ts::DATE + {k} IN ({', '.join(f"DATE '{h}'" for h in _HOLIDAYS)}))::INTEGER"


@query(f"SELECT event_id, {_IN(0)} AS is_holiday, {_IN(1)} AS is_day_before_holiday, {_IN(-1)} AS is_day_after_holiday, greatest({_IN(0)}, {_IN(1)}, {_IN(-1)}) AS is_holiday_period FROM events")
def holiday_flags(spark, d):
    days = spark.createDataFrame([(h,) for h in _HOLIDAYS], "date string")
    return calendar.add_holiday_flags(tables.read(spark, d, "events", ["event_id", "ts"]), "ts", days).drop("ts")


_RBF = ", ".join(f"exp(-pow(least(abs(h / 23.0::DOUBLE - {i / 12!r}::DOUBLE), 1 - abs(h / 23.0::DOUBLE - {i / 12!r}::DOUBLE)) * 12, 2)) AS hour_rbf_{i + 1}" for i in range(12))


@query(f"SELECT event_id, {_RBF} FROM (SELECT event_id, hour(ts) AS h FROM events)")
def rbf_encoding(spark, d):
    e = tables.read(spark, d, "events").select("event_id", F.hour("ts").alias("hour"))
    return e.select("event_id", *[c.alias(n) for n, c in calendar.rbf_features("hour", 12, (0, 23)).items()])


def _window_query(columns):
    return lambda spark, d: _panel(spark, d).select("district_id", "timestamp", *[c.alias(n) for n, c in columns(temporal.window(SPEC)).items()])


def _register(name, sql, columns):
    f = _window_query(columns)
    f.__name__ = name
    query(f"WITH {PANEL_SQL} SELECT district_id, timestamp, {sql} FROM panel {W_SQL}")(f)


_FRAME = lambda k: f"(PARTITION BY district_id ORDER BY timestamp ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
_register("lag_bfill", ", ".join(f"coalesce(lag(crowd, {k}) OVER w, first_value(crowd) OVER (PARTITION BY district_id ORDER BY timestamp)) AS crowd_lag_{k}" for k in (1, 24)), lambda w: {f"crowd_lag_{k}": temporal.lag_filled("crowd", k, w) for k in (1, 24)})
_SIMPLE = {"mean": "avg(crowd)", "sum": "sum(crowd)", "min": "min(crowd)", "max": "max(crowd)", "count": "count(crowd)", "std": "stddev_samp(crowd)", "var": "var_samp(crowd)"}
_CAST = {"sum": "::BIGINT"}
_register("rolling_stats", ", ".join(f"({x} OVER {_FRAME(k)}){_CAST.get(s, '')} AS crowd_rolling_{s}_{k}" for k in (3, 24) for s, x in _SIMPLE.items()), lambda w: {f"crowd_rolling_{s}_{k}": temporal.rolling("crowd", k, s, w) for k in (3, 24) for s in _SIMPLE})
_register("rolling_median", f"quantile_cont(crowd, 0.5) OVER {_FRAME(6)} AS crowd_rolling_median_6", lambda w: {"crowd_rolling_median_6": temporal.rolling("crowd", 6, "median", w)})
_register("rolling_skew_kurt", f"""CASE WHEN count(crowd) OVER {_FRAME(12)} >= 3 THEN CASE WHEN var_pop(crowd) OVER {_FRAME(12)} < 1e-14 THEN 0 ELSE round(skewness(crowd) OVER {_FRAME(12)} + 1e-9, 4) END END AS crowd_rolling_skew_12,
CASE WHEN count(crowd) OVER {_FRAME(12)} >= 4 THEN CASE WHEN var_pop(crowd) OVER {_FRAME(12)} < 1e-14 THEN -3 ELSE round(kurtosis(crowd) OVER {_FRAME(12)} + 1e-9, 4) END END AS crowd_rolling_kurt_12""", lambda w: {f"crowd_rolling_{s}_12": F.round(temporal.rolling("crowd", 12, s, w) + 1e-9, 4) for s in ("skew", "kurt")})
_register("diff_orders", ", ".join(f"crowd - lag(crowd, {k}) OVER w AS crowd_diff_{k}, (crowd - lag(crowd, {k}) OVER w) - (lag(crowd, 1) OVER w - lag(crowd, {k + 1}) OVER w) AS crowd_diff_rate_{k}" for k in (1, 24)), lambda w: {n: f("crowd", k, w) for k in (1, 24) for n, f in ((f"crowd_diff_{k}", temporal.difference), (f"crowd_diff_rate_{k}", temporal.difference_rate))})
_register("pct_change", ", ".join(f"CASE WHEN lag(crowd, {k}) OVER w <> 0 THEN greatest(least((crowd - lag(crowd, {k}) OVER w) / (lag(crowd, {k}) OVER w)::DOUBLE, 1), -1) END::DOUBLE AS crowd_pct_change_{k}" for k in (1, 24)), lambda w: {f"crowd_pct_change_{k}": temporal.pct_change("crowd", k, w) for k in (1, 24)})
_register("rolling_dev_cv", f"crowd - avg(crowd) OVER {_FRAME(24)} AS crowd_deviation_rolling_24, stddev_samp(crowd) OVER {_FRAME(24)} / nullif(avg(crowd) OVER {_FRAME(24)}, 0) AS crowd_cv_rolling_24", lambda w: {"crowd_deviation_rolling_24": temporal.deviation("crowd", 24, w), "crowd_cv_rolling_24": temporal.variation("crowd", 24, w)})


def _ewm_sql(x: str, span: int) -> str:
    """The mean as a fold over all rows so far: its value and the weight of what came before."""
    a, d = f"{2 / (span + 1)!r}::DOUBLE", f"{1 - 2 / (span + 1)!r}::DOUBLE"
    step = f"lambda p, e: {{'x': e.x, 'y': CASE WHEN p.y IS NULL THEN e.x WHEN e.x IS NULL THEN p.y ELSE (p.w * {d} * p.y + {a} * e.x) / (p.w * {d} + {a}) END, 'w': CASE WHEN e.x IS NOT NULL THEN 1::DOUBLE ELSE p.w * {d} END}}"
    return f"list_reduce([{{'x': NULL::DOUBLE, 'y': NULL::DOUBLE, 'w': NULL::DOUBLE}}] || list({{'x': {x}::DOUBLE, 'y': NULL::DOUBLE, 'w': NULL::DOUBLE}}) OVER (PARTITION BY district_id ORDER BY timestamp), {step}).y"


@query(f"WITH {PANEL_SQL} SELECT district_id, timestamp, {', '.join(f'{_ewm_sql("crowd", k)} AS crowd_ewm_{k}' for k in (3, 24))} FROM panel")
def ewm(spark, d):
    return temporal.add_ewm(_panel(spark, d), SPEC, ("crowd",), (3, 24)).drop("crowd")


@query(f"WITH {PANEL_SQL} SELECT district_id, timestamp, crowd, {_ewm_sql('crowd', 12)} AS crowd_ewm_12 FROM panel")
def ewm_batches(spark, d):
    return temporal.add_ewm(_panel(spark, d), SPEC, ("crowd",), (12,))


@query(f"""WITH {PANEL_SQL}, s AS (SELECT district_id, timestamp, CASE WHEN hour(timestamp) % 5 <> 0 AND day(timestamp) % 3 <> 1 THEN crowd END AS x FROM panel)
SELECT district_id, timestamp, x, {', '.join(f'{_ewm_sql("x", k)} AS x_ewm_{k}' for k in (1, 12, 200))} FROM s""")
def ewm_nulls(spark, d):
    p = _panel(spark, d).select("district_id", "timestamp", F.when((F.hour("timestamp") % 5 != 0) & (F.dayofmonth("timestamp") % 3 != 1), F.col("crowd")).alias("x"))
    return temporal.add_ewm(p, PanelSpec(("district_id",), "timestamp", ("x",)), ("x",), (1, 12, 200))


@query(f"""WITH {PANEL_SQL}, s AS (SELECT district_id, timestamp, CASE WHEN hour(timestamp) % 5 <> 0 THEN crowd END AS x FROM panel),
l AS (SELECT *, lag(x, 2) OVER w AS y FROM s {W_SQL})
SELECT district_id, timestamp, x, first_value(y IGNORE NULLS) OVER (PARTITION BY district_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x_lag_2 FROM l""")
def lag_bfill_nulls(spark, d):
    p = _panel(spark, d).select("district_id", "timestamp", F.when(F.hour("timestamp") % 5 != 0, F.col("crowd")).alias("x"))
    return temporal.add_lags_filled(p, ("x",), (2,), temporal.window(SPEC))


@query(f"WITH {PANEL_SQL} SELECT district_id, count(*) AS n_rows, count(timestamp) - count(DISTINCT timestamp) AS n_repeated, count(*) - count(timestamp) AS n_null FROM panel GROUP BY 1")
def time_checks(spark, d):
    return temporal.check_times(_panel(spark, d), SPEC)
