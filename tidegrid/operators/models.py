"""Models over DataFrames: a registry on pyspark.ml, one model an output, timed training and grids of runs, search."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import demand_prediction
from ..spec import Task

#: What a model gets where no tuned parameters are known.
DEFAULTS = {"n_estimators": 350, "learning_rate": 0.15, "max_depth": 6, "colsample": 0.9, "min_child_weight": 6}
_FEATURES, _LABEL = "_features", "_label"


def estimator(task: Task | str, kind: Any = "rf", params: dict | None = None, seed: int = 42) -> Any:
    """kind: "rf", "gbt" (also "xgb", "xgboost", "random_forest"), a callable that takes params, or an estimator with fit."""
    task, p = Task(task), dict(params or {})
    if not isinstance(kind, str):
        made = kind(p) if callable(kind) and not hasattr(kind, "fit") else kind
        if not hasattr(made, "fit"):
            raise TypeError("an estimator needs fit()")
        return made
    kind = {"xgb": "gbt", "xgboost": "gbt", "random_forest": "rf"}.get(kind, kind)
    trees, depth = int(p.get("n_estimators", 20)), int(p.get("max_depth", 5))
    share = str(p["colsample"]) if "colsample" in p else "auto"
    common = {"featuresCol": _FEATURES, "labelCol": _LABEL, "seed": seed, "maxDepth": depth, "minInstancesPerNode": max(1, int(p.get("min_child_weight", 1)))}
    if kind == "rf":
        made = RandomForestRegressor if task is Task.REGRESSION else RandomForestClassifier
        return made(numTrees=trees, featureSubsetStrategy=share, **common)
    if kind == "gbt":
        more = {"maxIter": trees, "stepSize": float(p.get("learning_rate", 0.1))} | ({"featureSubsetStrategy": share} if share != "auto" else {"featureSubsetStrategy": "all"})
        if task is Task.REGRESSION:
            return GBTRegressor(**common, **more)
        return OneVsRest(classifier=GBTClassifier(**common, **more), featuresCol=_FEATURES, labelCol=_LABEL)
    raise ValueError(f"unknown estimator {kind!r}")


@dataclass
class Fitted:
    """One model an output. transform() adds pred_{output}."""

    features: list[str]
    models: dict[str, Any]
    seconds: float = 0.0

    def transform(self, df: DataFrame, positive: bool = False, whole: bool = False) -> DataFrame:
        keep = df.columns
        out = VectorAssembler(inputCols=self.features, outputCol=_FEATURES, handleInvalid="keep").transform(df)
        for name, m in self.models.items():
            out = m.transform(out)
            p = F.col("prediction")
            p = demand_prediction(p, positive, whole) if positive or whole else p
            out = out.withColumn(f"pred_{name}", p).drop(*[c for c in out.columns if c not in (*keep, _FEATURES) and not c.startswith("pred_")])
        return out.drop(_FEATURES)

    def importances(self) -> DataFrame:
        """output, feature, importance; none from models that have none."""
        spark = SparkSession.getActiveSession()
        rows = []
        for name, m in self.models.items():
            parts = getattr(m, "models", [m])
            got = [p.featureImportances.toArray() for p in parts if hasattr(p, "featureImportances")]
            if got:
                rows += [(name, f, float(sum(g[i] for g in got) / len(got))) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "output string, feature string, importance double")

    def save(self, path: str) -> None:
        for name, m in self.models.items():
            PipelineModel([m]).write().overwrite().save(f"{path}/{name}")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps({"features": self.features, "outputs": list(self.models)}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")

    @classmethod
    def load(cls, path: str) -> Fitted:
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/_meta").first()[0])
        return cls(meta["features"], {n: PipelineModel.load(f"{path}/{n}").stages[0] for n in meta["outputs"]})


def train(df: DataFrame, features: list[str], outputs: list[str], task: Task | str, kind: Any = "rf", params: dict | None = None, per_output: dict[str, dict] | None = None, validation: str | None = None, seed: int = 42) -> Fitted:
    """One model for each output; rows without the output don't count. validation: a boolean column of rows that stop boosting early."""
    began = time.perf_counter()
    wide = VectorAssembler(inputCols=features, outputCol=_FEATURES, handleInvalid="keep").transform(df)
    models = {}
    for name in outputs:
        e = estimator(task, kind, (params or {}) | (per_output or {}).get(name, {}), seed)
        target = e.getClassifier() if isinstance(e, OneVsRest) else e
        if validation and hasattr(target, "setValidationIndicatorCol") and not isinstance(e, OneVsRest):
            target.setValidationIndicatorCol(validation)
        models[name] = e.fit(wide.where(F.col(name).isNotNull()).withColumn(_LABEL, F.col(name).cast("double")))
    return Fitted(features, models, time.perf_counter() - began)


def load_params(source: dict | str, dataset: str, task: str, horizon: int) -> dict:
    """Parameters by dataset, task and horizon from a dict or JSON text; DEFAULTS where there are none."""
    table = json.loads(source) if isinstance(source, str) else source
    return table.get(dataset, {}).get(task, {}).get(str(horizon), DEFAULTS)


def load_models(spark: SparkSession, root: str) -> dict[tuple[str, int], Fitted]:
    """(group, horizon): model, of folders {group}_{horizon}."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    out = {}
    for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at):
        if m := re.fullmatch(r"(.+)_(\d+)", s.getPath().getName()):
            out[m[1], int(m[2])] = Fitted.load(s.getPath().toString())
    return out


@dataclass
class Benchmark:
    """Runs of identifiers x horizons, warm-ups first; an error ends its run, not the grid."""

    load: Callable[[str, int], tuple[DataFrame, DataFrame]]
    features: list[str]
    output: str
    task: Task = Task.REGRESSION
    kind: Any = "rf"
    params: dict = field(default_factory=dict)
    warmups: int = 1
    runs: int = 3

    def run(self, spark: SparkSession, identifiers: list[str], horizons: list[int]) -> DataFrame:
        rows = []
        for who in identifiers:
            for h in horizons:
                for k in range(-self.warmups, self.runs):
                    row: dict = {"identifier": who, "horizon": h, "run_id": k}
                    try:
                        first, second = self.load(who, h)
                        row |= {"train_size": first.count(), "test_size": second.count()}
                        fitted = train(first, self.features, [self.output], self.task, self.kind, self.params)
                        began = time.perf_counter()
                        fitted.transform(second, positive=self.task is Task.REGRESSION).agg(F.sum(f"pred_{self.output}")).collect()
                        row |= {"train_time": fitted.seconds, "predict_time": time.perf_counter() - began}
                        row["total_time"] = row["train_time"] + row["predict_time"]
                    except Exception as e:  # the grid goes on; the run tells what it was
                        row["error"] = f"{type(e).__name__}: {e}"[:300]
                    if k >= 0:
                        rows.append(row)
        schema = "identifier string, horizon int, run_id int, train_time double, predict_time double, total_time double, train_size long, test_size long, error string"
        return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema)


#: Bounds that a search starts from; (low, high, whole numbers).
SPACE = {"n_estimators": (10, 60, True), "max_depth": (2, 8, True), "learning_rate": (0.03, 0.3, False), "colsample": (0.5, 1.0, False), "min_child_weight": (1, 10, True)}


def shrink_space(space: dict[str, tuple], best: dict, factor: float = 0.5) -> dict[str, tuple]:
    """Bounds of factor times the width around the best values, within the old ones."""
    out = {}
    for k, (low, high, whole) in space.items():
        half = (high - low) * factor / 2
        a, b = max(low, best[k] - half), min(high, best[k] + half)
        out[k] = (round(a), max(round(a), round(b)), True) if whole else (a, b, False)
    return out


def search(objective: Callable[[dict], float], trials: int = 10, space: dict[str, tuple] | None = None, shrink_every: int = 5, seed: int = 42) -> tuple[dict, float, list[dict]]:
    """Random search for the least objective, in bounds that close in on the best; gives the best, its value and all trials with the champion's gain."""
    rng, space = random.Random(seed), dict(space or SPACE)
    best, value, log = None, float("inf"), []
    for t in range(trials):
        p = {k: rng.randint(a, b) if whole else rng.uniform(a, b) for k, (a, b, whole) in space.items()}
        v = objective(p)
        gain = (value - v) / value if best is not None and v < value and value else None
        if v < value:
            best, value = p, v
        log.append({"trial": t, "value": v, "gain": gain, **p})
        if (t + 1) % shrink_every == 0 and best:
            space = shrink_space(space, best)
    return best, value, log


def cross_validated_rmse(df: DataFrame, folds: int, features: list[str], output: str, groups: tuple[str, ...], kind: Any, params: dict) -> float:
    """Mean over folds (column fold, see operators.split) of the median over groups of the RMSE."""
    total = []
    for k in range(1, folds + 1):
        fitted = train(df.where(F.col("fold") < k), features, [output], Task.REGRESSION, kind, params)
        p = fitted.transform(df.where(F.col("fold") == k))
        by = p.groupBy(*groups).agg(F.sqrt(F.avg((F.col(output) - F.col(f"pred_{output}")) ** 2)).alias("rmse"))
        total.append(by.agg(F.median("rmse")).first()[0])
    return sum(total) / len(total)


def learning_curve(df: DataFrame, increments: int, features: list[str], output: str, groups: tuple[str, ...], kind: Any = "rf", params: dict | None = None) -> DataFrame:
    """increment, mean r2, mae, rmse, smape over groups: trained on all earlier increments, tested on the next (column increment)."""
    from .metrics import mean_metrics, regression_metrics

    out = None
    for k in range(1, increments):
        fitted = train(df.where(F.col("increment") <= k), features, [output], Task.REGRESSION, kind, params)
        m = regression_metrics(fitted.transform(df.where(F.col("increment") == k + 1)), groups, output, f"pred_{output}")
        one = mean_metrics(m, ("r2", "mae", "rmse", "smape")).select(F.lit(k).alias("increment"), "*")
        out = one if out is None else out.unionByName(one)
    return out
