"""Queries of operators that learn a state, and of the whole feature pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..operators import learned
from ..sources import tables
from ..sources.tables import PANEL_SQL
from ..spec import FeatureConfig, PanelSpec
from . import pipeline
from .pipeline import FeaturePipeline
from .register import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
SPEC = PanelSpec(("district_id",), "timestamp", ("crowd",))


def _panel(spark, d):
    return tables.panel(spark, d).select("district_id", "timestamp", "crowd")


@query(f"""WITH {PANEL_SQL}, s AS (SELECT district_id, timestamp, crowd, coalesce(crowd - lag(crowd) OVER (PARTITION BY district_id ORDER BY timestamp), 0)::DOUBLE AS x FROM panel),
e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.3, 0.7, 1]))) AS e FROM s),
b AS (SELECT district_id, timestamp, crowd, len(list_filter(e, lambda v: x > v)) AS k, len(e) + 1 AS n FROM s, e)
SELECT district_id, timestamp, crowd, CASE n WHEN 5 THEN ['Very_Low', 'Low', 'Medium', 'High', 'Very_High'][k + 1] WHEN 4 THEN 'Q' || k ELSE ['Low', 'Medium', 'High'][k + 1] END AS crowd_magnitude,
crowd * pow(2.0::DOUBLE, k - n // 2) AS crowd_adjusted FROM b""")
def traffic_adjust(spark, d):
    return learned.TrafficAdjuster(SPEC).fit_transform(_panel(spark, d))


@query(f"""WITH {PANEL_SQL}, s AS (SELECT district_id, timestamp, crowd, coalesce(crowd - lag(crowd) OVER (PARTITION BY district_id ORDER BY timestamp), 0)::DOUBLE AS x FROM panel),
e AS (SELECT district_id, list_sort(list_distinct(quantile_cont(x, [0, 0.3, 0.7, 1]))) AS e FROM s GROUP BY 1),
b AS (SELECT district_id, timestamp, crowd, len(list_filter(e, lambda v: x > v)) AS k, len(e) + 1 AS n FROM s JOIN e USING (district_id))
SELECT district_id, timestamp, crowd, CASE n WHEN 5 THEN ['Very_Low', 'Low', 'Medium', 'High', 'Very_High'][k + 1] WHEN 4 THEN 'Q' || k ELSE ['Low', 'Medium', 'High'][k + 1] END AS crowd_magnitude,
crowd * pow(2.0::DOUBLE, k - n // 2) AS crowd_adjusted FROM b""")
def traffic_adjust_by_group(spark, d):
    return learned.ByGroup(learned.TrafficAdjuster(SPEC), ("district_id",)).fit_transform(_panel(spark, d))


def _scored(x: str, groups: bool) -> str:
    over = "PARTITION BY district_id" if groups else ""
    return f"WITH {PANEL_SQL}, x AS (SELECT district_id, timestamp, {x} AS x FROM panel WHERE crowd > 0) SELECT district_id, timestamp, (x - avg(x) OVER ({over})) / coalesce(nullif(stddev_pop(x) OVER ({over}), 0), 1) AS crowd FROM x"


@query(_scored("(sqrt(crowd) - 1) / 0.5::DOUBLE", False))
def box_cox_given(spark, d):
    return learned.Power(("crowd",), "box-cox", exponents=(0.5,)).fit_transform(_panel(spark, d).where("crowd > 0"))


@query(_scored("(pow(crowd + 1, 0.25::DOUBLE) - 1) / 0.25::DOUBLE", True))
def yeo_johnson_given_by_group(spark, d):
    return learned.ByGroup(learned.Power(("crowd",), exponents=(0.25,)), ("district_id",)).fit_transform(_panel(spark, d).where("crowd > 0"))


_LEVELS = f"""WITH {PANEL_SQL}, r AS (SELECT district_id, timestamp, crowd, row_number() OVER (PARTITION BY district_id ORDER BY crowd, timestamp) AS k, count(*) OVER (PARTITION BY district_id) AS n FROM panel),
l AS (SELECT district_id, timestamp, crowd, ((k > 1 + 0.3::DOUBLE * (n - 1))::INTEGER + (k > 1 + 0.7::DOUBLE * (n - 1))::INTEGER) AS level FROM r)"""


@query(f"{_LEVELS} SELECT district_id, timestamp, crowd, level::INTEGER AS level FROM l")
def demand_levels(spark, d):
    return learned.demand_levels(_panel(spark, d), "crowd", 3, ("district_id",), ("timestamp",))


@query(f"""WITH {PANEL_SQL}, r AS (SELECT district_id, timestamp, crowd, row_number() OVER (ORDER BY crowd, timestamp, district_id) AS k, count(*) OVER () AS n FROM panel)
SELECT district_id, timestamp, crowd, ((k > 1 + 0.25::DOUBLE * (n - 1))::INTEGER + (k > 1 + 0.4::DOUBLE * (n - 1))::INTEGER + (k > 1 + 0.85::DOUBLE * (n - 1))::INTEGER)::INTEGER AS level FROM r""")
def demand_levels_global(spark, d):
    return learned.demand_levels(_panel(spark, d), "crowd", 5, (), ("timestamp", "district_id"))


@query(f"""{_LEVELS}, e AS (SELECT district_id, level, min(crowd)::DOUBLE AS lo, max(crowd)::DOUBLE AS hi FROM l GROUP BY ALL),
x AS (SELECT district_id, list_sort(list_distinct(list_concat(list(lo), list(hi)))) AS x FROM e GROUP BY 1),
g AS (SELECT district_id, list_concat([-1::DOUBLE], x[2:-2]) AS edges FROM x)
SELECT district_id, timestamp, crowd, (len(list_filter(edges, lambda v: crowd > v)) - 1)::INTEGER AS mask FROM panel JOIN g USING (district_id)""")
def demand_level_mask(spark, d):
    p = _panel(spark, d)
    levels = learned.demand_levels(p, "crowd", 3, ("district_id",), ("timestamp",))
    return learned.apply_levels(p, "crowd", learned.level_edges(levels, "crowd", ("district_id",)), ("district_id",))


@query(f"WITH {PANEL_SQL} SELECT district_id, timestamp, (crowd - lo) / coalesce(nullif(hi - lo, 0), 1)::DOUBLE AS crowd FROM panel, (SELECT min(crowd) AS lo, max(crowd) AS hi FROM panel)")
def minmax(spark, d):
    return learned.MinMax(("crowd",)).fit_transform(_panel(spark, d))


@query(f"WITH {PANEL_SQL} SELECT district_id, timestamp, (crowd - lo) / coalesce(nullif(hi - lo, 0), 1)::DOUBLE AS crowd FROM panel JOIN (SELECT district_id, min(crowd) AS lo, max(crowd) AS hi FROM panel GROUP BY 1) USING (district_id)")
def minmax_by_group(spark, d):
    return learned.MinMax(("crowd",), ("district_id",)).fit_transform(_panel(spark, d))


def _encoded(share: str) -> str:
    return f"""WITH {PANEL_SQL}, a AS (SELECT avg(crowd) AS m FROM panel), c AS (SELECT district_id, count(*)::DOUBLE AS n, avg(crowd) AS v FROM panel GROUP BY 1)
SELECT district_id, timestamp, crowd, v * ({share}) + m * (1 - ({share})) AS district_id__target_0_enc FROM panel JOIN c USING (district_id), a"""


@query(_encoded("n / (n + 10)"))
def target_encode_additive(spark, d):
    return learned.TargetEncoder("district_id", ("crowd",)).fit_transform(_panel(spark, d))


@query(_encoded("1 / (1 + exp(-(n - 1) / 500))"))
def target_encode_exponential(spark, d):
    return learned.TargetEncoder("district_id", ("crowd",), 500.0, 1, "exponential").fit_transform(_panel(spark, d))


@query(f"WITH {PANEL_SQL} SELECT (dense_rank() OVER (ORDER BY district_id) - 1)::DOUBLE AS district_id, timestamp, crowd FROM panel")
def ordinal(spark, d):
    return learned.Ordinal("district_id").fit_transform(_panel(spark, d))


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INTEGER AS o_orderstatus_{v}" for v in "FOP") + " FROM orders")
def onehot(spark, d):
    o = tables.read(spark, d, "orders", ["o_orderkey", "o_orderstatus"])
    return learned.OneHot("o_orderstatus").fit_transform(o).drop("o_orderstatus")


@query()
def fourier(spark, d):
    return learned.Fourier(SPEC, 30).fit_transform(_panel(spark, d))


@query()
def yeo_johnson(spark, d):
    return learned.Power(("crowd",)).fit_transform(_panel(spark, d))


@query()
def box_cox(spark, d):
    return learned.Power(("crowd",), "box-cox").fit_transform(_panel(spark, d).where("crowd > 0"))


@query()
def feature_pipeline(spark, d):
    p = _panel(spark, d)
    return FeaturePipeline(FeatureConfig(SPEC)).fit(p).transform(p)


def _near(u: str, n: int) -> list[str]:
    """n kernels around a circle, by the distance of u to each one's centre."""
    return [f"exp(-pow(least(abs({u} - {i / n!r}::DOUBLE), 1 - abs({u} - {i / n!r}::DOUBLE)) * {n}, 2))" for i in range(n)]


_ROWS = lambda k: f"(PARTITION BY district_id ORDER BY timestamp ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
_FEATURES = {
    "hour": "hour(timestamp)", "dayofweek": "isodow(timestamp) - 1",
    **{f"hour_rbf_{i + 1}": x for i, x in enumerate(_near("hour(timestamp) / 23.0::DOUBLE", 12))},
    **{f"dayofweek_rbf_{i + 1}": x for i, x in enumerate(_near("(isodow(timestamp) - 1) / 6.0::DOUBLE", 7))},
    **{f"crowd_lag_{k}": f"coalesce(lag(crowd, {k}) OVER w, first_value(crowd) OVER w)" for k in (1, 24)},
    **{f"crowd_rolling_{n}_{k}": f"{f}(crowd) OVER {_ROWS(k)}" for k in (3, 24) for n, f in (("mean", "avg"), ("std", "stddev_samp"))},
    "crowd_diff_24": "crowd - lag(crowd, 24) OVER w", "crowd_diff_rate_24": "(crowd - lag(crowd, 24) OVER w) - (lag(crowd, 1) OVER w - lag(crowd, 25) OVER w)",
    "crowd_pct_change_24": "CASE WHEN lag(crowd, 24) OVER w IS NOT NULL THEN greatest(least((crowd - lag(crowd, 24) OVER w) / lag(crowd, 24) OVER w::DOUBLE, 1), -1) END",
    "crowd_deviation_rolling_24": f"crowd - avg(crowd) OVER {_ROWS(24)}", "crowd_cv_rolling_24": f"stddev_samp(crowd) OVER {_ROWS(24)} / nullif(avg(crowd) OVER {_ROWS(24)}, 0)",
    "crowd_adjusted": "crowd * pow(2.0::DOUBLE, k - n // 2)",
}
_SCALED = lambda c: f"({c} - min({c}) OVER ()) / coalesce(nullif(max({c}) OVER () - min({c}) OVER (), 0), 1)::DOUBLE AS {c}"


@query(f"""WITH {PANEL_SQL}, s AS (SELECT district_id, timestamp, crowd, coalesce(crowd - lag(crowd) OVER (PARTITION BY district_id ORDER BY timestamp), 0)::DOUBLE AS x FROM panel),
e AS (SELECT district_id, list_sort(list_distinct(quantile_cont(x, [0, 0.3, 0.7, 1]))) AS e FROM s GROUP BY 1),
b AS (SELECT district_id, timestamp, crowd, len(list_filter(e, lambda v: x > v)) AS k, len(e) + 1 AS n FROM s JOIN e USING (district_id)),
f AS (SELECT district_id, timestamp, crowd, CASE n WHEN 5 THEN ['Very_Low', 'Low', 'Medium', 'High', 'Very_High'][k + 1] WHEN 4 THEN 'Q' || k ELSE ['Low', 'Medium', 'High'][k + 1] END AS crowd_magnitude,
  {', '.join(f'{x} AS {n}' for n, x in _FEATURES.items())} FROM b WINDOW w AS (PARTITION BY district_id ORDER BY timestamp))
SELECT district_id, timestamp, crowd, crowd_magnitude, {', '.join(map(_SCALED, _FEATURES))} FROM f""")
def feature_pipeline_by_group(spark, d):
    """All but spectra, adjustment by group, saved and loaded before it is applied."""
    p = _panel(spark, d)
    path = storage.new_path(spark, "model")
    FeaturePipeline(FeatureConfig(SPEC, harmonics=0, by_group=True)).fit(p).save(path, spark)
    return pipeline.load(spark, path).transform(p)


@query("SELECT o_orderkey, " + ", ".join(f"o_{c}" for c in ("custkey", "totalprice")) + " FROM orders")
def numeric_selection(spark, d):
    o = tables.read(spark, d, "orders")
    return o.select(*learned.numeric_columns(o))
