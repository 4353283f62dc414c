"""The feature pipeline: node features, calendar and window features of a panel, then powers, encoders and scaling. Fitted once, applied to any frame, saved and loaded."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import calendar, temporal
from ..operators import learned
from ..spec import FeatureConfig
from ..storage import written


@dataclass
class FeaturePipeline:
    """fit() learns from the frame it gets, usually a burn-in; nodes: features by group, from operators.graph."""

    config: FeatureConfig
    nodes: DataFrame | None = None
    restart_at: tuple[str, ...] = ()

    def _raw(self, df: DataFrame) -> DataFrame:
        c, p = self.config, self.config.panel
        out = df
        if self.nodes is not None:
            features = [x for x in self.nodes.columns if x not in p.groups]
            out = out.join(learned.small(self.nodes), list(p.groups), "left").na.fill(0, subset=features)
        times = calendar.calendar_parts(p.time, c.time_parts) | ({"time_period": calendar.time_period(p.time)} if c.time_period else {})
        times |= (calendar.transit_flags(p.time) if c.transit else {}) | calendar.custom_periods(p.time, c.periods)
        out = out.withColumns(times) if times else out
        if c.holidays:
            days = df.sparkSession.createDataFrame([(d,) for d in c.holidays], "date string")
            out = calendar.add_holiday_flags(out, p.time, days)
        rbf = {n: x for f, (k, span) in c.rbf.items() for n, x in calendar.rbf_features(f, k, tuple(span)).items()}
        out = out.withColumns(rbf) if rbf else out
        out = temporal.add_temporal(out, p, c.lags, c.windows, c.stats, c.diffs, self.restart_at)
        return temporal.add_ewm(out, p, p.values, c.ewm, self.restart_at) if c.ewm else out

    def fit(self, df: DataFrame) -> FeatureModel:
        c, p = self.config, self.config.panel
        model = FeatureModel(self, [])
        by_group = (lambda e: learned.ByGroup(e, p.groups, c.unseen).fit(df)) if c.by_group else (lambda e: e.fit(df))
        # Spectra and adjustment are learned from values, what follows from the features that these make.
        if c.harmonics:
            model.steps.append(by_group(learned.Fourier(p, c.harmonics, smooth=True, window=c.fourier_window)))
        if c.quantiles:
            model.steps.append(by_group(learned.TrafficAdjuster(p, c.quantiles, use_diff=c.use_diff)))
        later: list[learned.Estimator] = []
        if c.power:
            later.append(learned.Power(c.power, c.power_method, c.standardize))
        later += [learned.TargetEncoder(x, targets, c.target_weight, smoothing=c.target_smoothing) for x, targets in c.target.items()]
        if c.scale:
            exact = {**dict.fromkeys(c.power if c.standardize else ()), **dict.fromkeys((*c.ordinal, *c.onehot, *c.target, *c.unscaled))}
            keep = (*p.groups, p.time, *p.values, *df.columns, *exact)
            later.append(learned.MinMax(tuple(x for x in learned.numeric_columns(model.transform(df), keep))))
        later += [learned.Ordinal(x, c.unknown_ordinal) for x in c.ordinal]
        later += [learned.OneHot(x, most_categories=c.most_categories, unknown=c.unknown_onehot) for x in c.onehot]
        wide = written(model.transform(df), "features") if later else df  # windows are evaluated once for all that is learned from them
        for estimator in later:
            model.steps.append(estimator.fit(wide))
            wide = model.steps[-1].transform(wide)
        return model


@dataclass
class FeatureModel:
    of: FeaturePipeline
    steps: list[learned.Fitted] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.of._raw(df)
        for s in self.steps:
            out = s.transform(out)
        return out

    def names(self, df: DataFrame) -> list[str]:
        return [c for c in self.transform(df).columns if c not in df.columns]

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """A manifest with the settings, the node table, and a folder for each step: its own manifest and state tables."""
        spark = spark or SparkSession.active()
        for i, s in enumerate(self.steps):
            s.save(f"{path}/step-{i}")
        nodes = self.of.nodes
        if nodes is not None:
            nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        learned.write_manifest(spark, path, {"version": learned.VERSION, "config": dataclasses.asdict(self.of.config), "restart_at": self.of.restart_at, "steps": len(self.steps), "nodes": nodes.schema.jsonValue() if nodes is not None else None})


def load(spark: SparkSession, path: str) -> FeatureModel:
    """A saved model: gives the same frame as the one that was saved. Tables are read when it is applied."""
    m = learned.read_manifest(spark, path)
    nodes = spark.read.schema(StructType.fromJson(m["nodes"])).parquet(f"{path}/nodes") if m["nodes"] else None
    pipeline = FeaturePipeline(learned.settings_of(FeatureConfig, m["config"]), nodes, tuple(m["restart_at"]))
    return FeatureModel(pipeline, [learned.load(spark, f"{path}/step-{i}") for i in range(m["steps"])])


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all, found in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if not counts[i]])


def save_features(df: DataFrame, path: str, split: str = "split", compression: str = "gzip") -> None:
    """Parquet, partitioned by split, without empty columns; an empty frame is an error."""
    if df.isEmpty():
        raise ValueError("there are no features to save")
    drop_null_columns(df).write.mode("overwrite").partitionBy(split).option("compression", compression).parquet(path)
