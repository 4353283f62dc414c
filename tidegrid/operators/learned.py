"""Operators that learn a state from a frame and apply it to others, as a whole or by group.

An estimator says which tables it learns, keyed by the groups it's given, and which columns it adds from them. fit() evaluates the
tables once. ByGroup fits any estimator for each group on its own, in the same few passes; a fitted model can be saved and loaded.
"""

from __future__ import annotations

import abc
import dataclasses
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.temporal import window
from ..spec import PanelSpec
from ..storage import written
from .order import join_null_safe, positions, quantiles, small, with_rank

#: The layout of saved models.
VERSION = 1
State = dict[str, DataFrame]


def attach(df: DataFrame, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """df with a state's columns: by its keys, nulls being equal, or those of its one row."""
    return join_null_safe(df, small(table), keys, "left") if keys else df.crossJoin(F.broadcast(table))


class Model(abc.ABC):
    @abc.abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    @abc.abstractmethod
    def names(self) -> list[str]:
        """The columns that transform() adds or replaces."""


class Estimator(abc.ABC):
    @abc.abstractmethod
    def learn(self, df: DataFrame, groups: tuple[str, ...] = ()) -> State:
        """Tables of a row a group, or a row a group and category."""

    @abc.abstractmethod
    def apply(self, df: DataFrame, state: State, groups: tuple[str, ...] = ()) -> DataFrame: ...

    @abc.abstractmethod
    def names(self, state: State) -> list[str]: ...

    def fit(self, df: DataFrame) -> Fitted:
        return Fitted(self, {name: written(t, name) for name, t in self.learn(df).items()})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class UnseenGroups(KeyError):
    """Groups that a model wasn't fitted for."""


@dataclass
class Fitted(Model):
    """An estimator with its state. unseen: rows of groups that weren't fitted raise an error that names them, or get nulls."""

    of: Estimator
    state: State
    groups: tuple[str, ...] = ()
    unseen: str = "error"

    def transform(self, df: DataFrame) -> DataFrame:
        if self.groups and self.unseen == "error":
            others = join_null_safe(df.select(*self.groups).distinct(), small(self.state["groups"]), self.groups, "left_anti")
            if found := others.limit(10).collect():
                raise UnseenGroups(f"never fitted: {', '.join(str(tuple(r)) for r in found)}")
        return self.of.apply(df, self.state, self.groups)

    def names(self) -> list[str]:
        return self.of.names(self.state)

    def save(self, path: str) -> None:
        """A manifest with settings and schemas, and a Parquet table for each of the state's. Overwrites what is there."""
        spark = next(iter(self.state.values())).sparkSession
        for name, t in self.state.items():
            t.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest = {"version": VERSION, "estimator": type(self.of).__name__, "settings": dataclasses.asdict(self.of), "groups": self.groups, "unseen": self.unseen, "tables": {n: t.schema.jsonValue() for n, t in self.state.items()}}
        write_manifest(spark, path, manifest)


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if manifest["version"] != VERSION:
        raise ValueError(f"{path} has layout {manifest['version']}, not {VERSION}")
    return manifest


def settings_of(kind: type, values: dict):
    """A dataclass of settings from what JSON makes of it: lists become tuples, panels PanelSpec."""
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, list) else v
    return kind(**{k: PanelSpec(**{a: plain(b) for a, b in v.items()}) if k == "panel" else {a: plain(b) for a, b in v.items()} if isinstance(v, dict) else plain(v) for k, v in values.items()})


def load(spark: SparkSession, path: str) -> Fitted:
    """A saved model. Its tables are read when it is applied."""
    m = read_manifest(spark, path)
    kinds = {k.__name__: k for k in Estimator.__subclasses__()}
    if m["estimator"] not in kinds:
        raise ValueError(f"unknown estimator {m['estimator']!r}")
    state = {n: spark.read.schema(StructType.fromJson(t)).parquet(f"{path}/{n}") for n, t in m["tables"].items()}
    return Fitted(settings_of(kinds[m["estimator"]], m["settings"]), state, tuple(m["groups"]), m["unseen"])


class ByGroup:
    """Fits an estimator for each group on its own: one keyed table of states for all, joined when it is applied."""

    def __init__(self, base: Estimator, groups: tuple[str, ...], unseen: str = "error") -> None:
        if not groups or unseen not in ("error", "null"):
            raise ValueError("groups must be named; unseen is error or null")
        self.base, self.groups, self.unseen = base, tuple(groups), unseen

    def fit(self, df: DataFrame) -> Fitted:
        if lacking := [g for g in self.groups if g not in df.columns]:
            raise ValueError(f"no group columns {lacking}")
        tables = {**self.base.learn(df, self.groups), "groups": df.select(*self.groups).distinct()}
        return Fitted(self.base, {n: written(t, n) for n, t in tables.items()}, self.groups, self.unseen)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def check_quantiles(q: tuple[float, ...]) -> None:
    if len(q) < 2 or q[0] != 0 or q[-1] != 1 or any(not 0 <= x <= 1 for x in q) or any(b <= a for a, b in zip(q, q[1:])):
        raise ValueError("quantiles start at 0, end at 1 and rise")


def bin_labels(n: int) -> list[str]:
    named = {3: ["Low", "Medium", "High"], 5: ["Very_Low", "Low", "Medium", "High", "Very_High"]}
    return named.get(n, [f"Q{i}" for i in range(n)])


def multipliers(n: int, scale: float = 2.0) -> list[float]:
    """scale to the powers around 0: of 5, two below and two above."""
    return [scale ** (i - n // 2) for i in range(n)]


def bin_of(x: Column, edges: Column) -> Column:
    """The bin of x between open ends: the number of edges below it."""
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: x > e)))


@dataclass
class TrafficAdjuster(Estimator):
    """Bins by quantiles of the values, or of their differences, each with a label and a factor: {c}_magnitude, {c}_adjusted."""

    panel: PanelSpec
    quantiles: tuple[float, ...] = (0, 0.3, 0.7, 1)
    scale: float = 2.0
    use_diff: bool = True

    def __post_init__(self) -> None:
        check_quantiles(self.quantiles)

    def _signals(self, df: DataFrame) -> DataFrame:
        w = window(self.panel)
        value = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0)) if self.use_diff else F.col(c)
        return df.withColumns({f"_s_{c}": value(c).cast("double") for c in self.panel.values})

    def learn(self, df: DataFrame, groups: tuple[str, ...] = ()) -> State:
        values = self.panel.values
        found = quantiles(self._signals(df), {f"_e_{c}": F.col(f"_s_{c}") for c in values}, self.quantiles, groups)
        state = written(found.withColumns({f"_e_{c}": F.array_sort(F.array_distinct(f"_e_{c}")) for c in values}), "edges")
        few = {c: [tuple(r) for r in state.where(F.coalesce(F.size(f"_e_{c}"), F.lit(0)) <= 2).select(*(groups or (F.lit("all").alias("rows"),))).limit(5).collect()] for c in values}
        if few := {c: r for c, r in few.items() if r}:
            raise ValueError(f"too few distinct quantiles: {few}")
        return {"edges": state}

    def apply(self, df: DataFrame, state: State, groups: tuple[str, ...] = ()) -> DataFrame:
        out, labels = attach(self._signals(df), state["edges"], groups), {}
        for c in self.panel.values:
            n = F.size(f"_e_{c}") + 1  # the ends are open
            k = bin_of(F.col(f"_s_{c}"), F.col(f"_e_{c}"))
            named = [(i, F.get(F.array(*map(F.lit, bin_labels(i))), k)) for i in range(3, len(self.quantiles) + 2)]
            label = F.when(n == named[0][0], named[0][1])
            for i, x in named[1:]:
                label = label.when(n == i, x)
            labels |= {f"{c}_magnitude": label, f"{c}_adjusted": F.col(c) * F.pow(F.lit(float(self.scale)), (k - F.floor(n / 2)).cast("double"))}
        return out.withColumns(labels).drop(*[f"_{x}_{c}" for c in self.panel.values for x in "se"])

    def names(self, state: State) -> list[str]:
        return [f"{c}_{x}" for c in self.panel.values for x in ("magnitude", "adjusted")]


#: Shares at which three and five demand levels are cut. The latter make four bins.
LEVEL_SHARES = {3: (0, 0.3, 0.7, 1), 5: (0, 0.25, 0.4, 0.85, 1)}


def demand_levels(df: DataFrame, value: str, classes: int = 3, groups: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """df with level, from 0: cut at shares of the rank, ties in the given order, so that levels have about those shares.

    Ranks are those of all rows, or of a group's: see order.with_rank(). No task sorts all rows, a hot group, or a frequent value.
    """
    ranked = with_rank(df, (value, *ties), groups, "_r", "_n")
    level = F.lit(0)
    for s in LEVEL_SHARES[classes][1:-1]:
        level = level + (F.col("_r") > F.lit(1.0) + F.lit(float(s)) * (F.col("_n") - 1)).cast("int")
    return ranked.withColumn("level", level).drop("_r", "_n")


def level_edges(levels: DataFrame, value: str, groups: tuple[str, ...] = (), upper_only: bool = False) -> DataFrame:
    """edges by group: -1, the least and greatest values of levels between the first and the last, open end.

    Two levels may share no edge, so there can be more bins than levels; upper_only takes upper ends alone, one bin a level.
    """
    ends = levels.groupBy(*groups, "level").agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    values = F.collect_set("hi") if upper_only else F.array_union(F.collect_set("lo"), F.collect_set("hi"))
    cut = F.slice("_x", 1 if upper_only else 2, F.greatest(F.size("_x") - (1 if upper_only else 2), F.lit(0)))
    edges = F.concat(F.array(F.lit(-1.0)), cut, F.array(F.lit(float("inf"))))
    return ends.groupBy(*groups).agg(F.array_sort(values).alias("_x")).withColumn("edges", edges).drop("_x")


def apply_levels(df: DataFrame, value: str, edges: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """df with mask: the right-closed bin of the value among its group's edges, from 0."""
    out = df.join(small(edges), list(groups), "left") if groups else df.crossJoin(F.broadcast(edges))  # one row
    mask = F.size(F.filter("edges", lambda e: F.col(value) > e)) - 1
    return out.withColumn("mask", F.when(F.col(value).isNotNull() & F.col("edges").isNotNull(), mask)).drop("edges")


@dataclass
class MinMax(Estimator):
    """Columns scaled to [0, 1] by their least and greatest value; one of a single value becomes 0."""

    columns: tuple[str, ...]
    groups: tuple[str, ...] = ()

    def learn(self, df: DataFrame, groups: tuple[str, ...] = ()) -> State:
        own = (*groups, *(g for g in self.groups if g not in groups))
        return {"spans": df.groupBy(*own).agg(*[x for c in self.columns for x in (F.min(c).cast("double").alias(f"_lo_{c}"), F.max(c).cast("double").alias(f"_hi_{c}"))])}

    def apply(self, df: DataFrame, state: State, groups: tuple[str, ...] = ()) -> DataFrame:
        out = attach(df, state["spans"], (*groups, *(g for g in self.groups if g not in groups)))
        span = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        scaled = {c: (F.col(c) - F.col(f"_lo_{c}")) / F.when(span(c) != 0, span(c)).otherwise(1.0) for c in self.columns}
        return out.withColumns(scaled).drop(*[f"_{e}_{c}" for c in self.columns for e in ("lo", "hi")])

    def names(self, state: State) -> list[str]:
        return list(self.columns)


@dataclass
class TargetEncoder(Estimator):
    """Mean target of each category, shrunk to the overall mean: additive by count/(count + prior_weight), or exponential, 1/(1 + exp(-(count - min_samples)/prior_weight)).

    A category that wasn't seen, or is null, gets the overall mean.
    """

    column: str
    targets: tuple[str, ...]
    prior_weight: float = 10.0
    min_samples: int = 1
    smoothing: str = "additive"

    def __post_init__(self) -> None:
        if self.smoothing not in ("additive", "exponential") or self.prior_weight <= 0:
            raise ValueError("smoothing is additive or exponential, with a positive weight")

    def learn(self, df: DataFrame, groups: tuple[str, ...] = ()) -> State:
        own, names = tuple(g for g in groups if g != self.column), self.names({})
        overall = df.groupBy(*own).agg(*[F.avg(t).alias(f"_m_{i}") for i, t in enumerate(self.targets)])
        n = F.col("_n").cast("double")
        share = n / (n + self.prior_weight) if self.smoothing == "additive" else 1 / (1 + F.exp(-(n - self.min_samples) / self.prior_weight))
        means = df.where(F.col(self.column).isNotNull()).groupBy(*own, self.column).agg(F.count("*").alias("_n"), *[F.avg(t).alias(f"_c_{i}") for i, t in enumerate(self.targets)])
        encoded = attach(means, overall, own).select(*own, self.column, *[(F.col(f"_c_{i}") * share + F.col(f"_m_{i}") * (1 - share)).alias(x) for i, x in enumerate(names)])
        return {"overall": overall, "categories": encoded}

    def apply(self, df: DataFrame, state: State, groups: tuple[str, ...] = ()) -> DataFrame:
        own = tuple(g for g in groups if g != self.column)
        out = attach(attach(df, state["categories"], (*own, self.column)), state["overall"], own)
        return out.withColumns({x: F.coalesce(x, f"_m_{i}") for i, x in enumerate(self.names({}))}).drop(*[f"_m_{i}" for i in range(len(self.targets))])

    def names(self, state: State) -> list[str]:
        return [f"{self.column}__target_{i}_enc" for i in range(len(self.targets))]


def _unknown(df: DataFrame, known: DataFrame, keys: tuple[str, ...]) -> None:
    """Raises an error that names categories which a fitted group hasn't got."""
    *own, column = keys
    df = join_null_safe(df, small(known.select(*own).distinct()), own, "left_semi") if own else df
    others = join_null_safe(df.where(F.col(column).isNotNull()).select(*keys).distinct(), small(known.select(*keys)), keys, "left_anti")
    if found := others.limit(10).collect():
        raise ValueError(f"unknown categories of {column}: {', '.join(str(tuple(r) if len(keys) > 1 else r[0]) for r in found)}")


@dataclass
class Ordinal(Estimator):
    """{c}: the place of the category in ascending order, null for null. unknown: categories that weren't seen raise an error, or get unknown_value."""

    column: str
    unknown: str = "use_encoded_value"
    unknown_value: float | None = None

    def __post_init__(self) -> None:
        if self.unknown not in ("error", "use_encoded_value"):
            raise ValueError("unknown is error or use_encoded_value")

    def learn(self, df: DataFrame, groups: tuple[str, ...] = ()) -> State:
        own = tuple(g for g in groups if g != self.column)
        placed = positions(df.where(F.col(self.column).isNotNull()).select(*own, self.column).distinct(), [self.column], own)
        return {"codes": placed.select(*own, self.column, F.col("_before").cast("double").alias("_code"))}

    def apply(self, df: DataFrame, state: State, groups: tuple[str, ...] = ()) -> DataFrame:
        keys = (*(g for g in groups if g != self.column), self.column)
        if self.unknown == "error":
            _unknown(df, state["codes"], keys)
        code = F.coalesce("_code", F.lit(self.unknown_value).cast("double")) if self.unknown_value is not None else F.col("_code")
        return attach(df, state["codes"], keys).withColumn(self.column, F.when(F.col(self.column).isNotNull(), code)).drop("_code")

    def names(self, state: State) -> list[str]:
        return [self.column]


@dataclass
class OneHot(Estimator):
    """{c}_{v}: 1 or 0. Of two categories, if drop_if_binary, only the second has a column; beyond most_categories the rarest share {c}_other.

    unknown: categories that weren't seen raise an error, are 0 in all columns (ignore), or count as rare ones where there are such
    (infrequent_if_exist). By group, a column is null where the group's own encoding has no such column.
    """

    column: str
    drop_if_binary: bool = True
    most_categories: int = 50
    unknown: str = "error"

    def __post_init__(self) -> None:
        if self.unknown not in ("error", "ignore", "infrequent_if_exist"):
            raise ValueError("unknown is error, ignore or infrequent_if_exist")

    def learn(self, df: DataFrame, groups: tuple[str, ...] = ()) -> State:
        own = tuple(g for g in groups if g != self.column)
        counts = df.where(F.col(self.column).isNotNull()).groupBy(*own, self.column).agg(F.count("*").alias("_n"))
        ranked = with_rank(counts.withColumn("_less", -F.col("_n")), ("_less", self.column), own, "_r", "_t")  # the most frequent first
        many = F.col("_t") > self.most_categories
        ranked = attach(ranked, counts.groupBy(*own).agg(F.max(self.column).alias("_top")), own)
        alone = F.when(many, F.col("_r") < self.most_categories).when((F.col("_t") == 2) & F.lit(self.drop_if_binary), F.col(self.column) == F.col("_top")).otherwise(True)
        return {"categories": ranked.select(*own, self.column, alone.alias("_alone"), (many & ~alone).alias("_rare"))}

    def _values(self, state: State) -> list:
        rows = state["categories"].where("_alone").select(self.column).distinct().orderBy(self.column).limit(10_000).collect()
        if len(rows) == 10_000:
            raise ValueError(f"{self.column} has too many categories for a column each")
        return [r[0] for r in rows]

    def apply(self, df: DataFrame, state: State, groups: tuple[str, ...] = ()) -> DataFrame:
        own = tuple(g for g in groups if g != self.column)
        if self.unknown == "error":
            _unknown(df, state["categories"], (*own, self.column))
        c, values, rare = F.col(self.column), self._values(state), self._rare(state)
        if own:  # which columns a group has, and its rare categories
            of_group = state["categories"].groupBy(*own).agg(F.collect_set(F.when(F.col("_alone"), F.col(self.column))).alias("_has"), F.collect_set(F.col(self.column)).alias("_known"), F.max("_rare").alias("_any_rare"))
            out = attach(df, of_group, own)
            has, known, any_rare = (lambda v: F.array_contains("_has", F.lit(v))), F.array_contains("_known", c), F.col("_any_rare")
        else:
            has, any_rare = (lambda v: F.lit(True)), F.lit(rare)
            known, out = F.col("_alone").isNotNull(), attach(df, state["categories"], (self.column,))
        cols = {f"{self.column}_{v}": F.when(has(v), F.coalesce((c == F.lit(v)).cast("int"), F.lit(0))) for v in values}
        if rare:
            other = ~c.isin(values) & (known | F.lit(self.unknown == "infrequent_if_exist")) if not own else ~F.array_contains("_has", c) & (known | F.lit(self.unknown == "infrequent_if_exist"))
            cols[f"{self.column}_other"] = F.when(any_rare, F.coalesce(other.cast("int"), F.lit(0)))
        return out.withColumns(cols).drop("_has", "_known", "_any_rare", "_alone", "_rare")

    def _rare(self, state: State) -> bool:
        return not state["categories"].where("_rare").isEmpty()

    def names(self, state: State) -> list[str]:
        return [f"{self.column}_{v}" for v in self._values(state)] + ([f"{self.column}_other"] if self._rare(state) else [])


@dataclass
class Fourier(Estimator):
    """Spectrum of each group's series: the strongest bins by amplitude, optionally of its rolling mean; transform() carries them on from t = 0.

    one_sided drops the conjugates, whose amplitudes the two-sided form counts twice, and the constant likewise.
    """

    panel: PanelSpec
    harmonics: int = 10
    smooth: bool = False
    detrend: bool = False
    window: int = 6
    one_sided: bool = False
    t_offset: int = 0

    def _groups(self, groups: tuple[str, ...]) -> list[str]:
        return [*self.panel.groups, *(g for g in groups if g not in self.panel.groups)]

    def learn(self, df: DataFrame, groups: tuple[str, ...] = ()) -> State:
        p, k, own = self.panel, self.harmonics, self._groups(groups)
        smooth, detrend, width, one_sided = self.smooth, self.detrend, self.window, self.one_sided
        schema = ", ".join(f"{g} {dict(df.dtypes)[g]}" for g in own) + ", value string, amplitude double, phase double, frequency double, most double"

        def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([p.time, *p.ties], kind="stable")
            out = []
            for c in p.values:
                x = pdf[c].astype("float64").fillna(0.0)
                most = float(x.max())
                if smooth:
                    mean = x.rolling(width, min_periods=1).mean()
                    x = x - mean if detrend else mean
                f, freq = np.fft.fft(x.to_numpy()), np.fft.fftfreq(len(x))
                amplitude = np.abs(f) * 2 / len(x)
                if one_sided:
                    amplitude = np.where(freq < 0, 0.0, np.where(freq == 0, amplitude / 2, amplitude))
                for i in np.argsort(-amplitude, kind="stable")[:k]:
                    out.append((*(pdf[g].iloc[0] for g in own), c, amplitude[i], np.angle(f[i]), freq[i], most))
            return pd.DataFrame(out, columns=[*own, "value", "amplitude", "phase", "frequency", "most"])

        some = df.select(*own, p.time, *p.ties, *p.values)
        waves = some.groupBy(*own).applyInPandas(spectrum, schema).groupBy(*own, "value").agg(F.collect_list(F.struct("amplitude", "phase", "frequency")).alias("w"), F.first("most").alias("most"))
        return {"waves": waves.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("value", F.struct("w", "most").alias("s")))).alias("_waves"))}

    def apply(self, df: DataFrame, state: State, groups: tuple[str, ...] = ()) -> DataFrame:
        """fourier_{c}: the sum of waves, within 0 and the greatest value seen. A group that wasn't fitted has null."""
        own = self._groups(groups)
        place = F.row_number().over(Window.partitionBy(*own).orderBy(self.panel.time, *self.panel.ties))
        out = attach(df.withColumn("_t", (place - 1 + self.t_offset).cast("double")), state["waves"], tuple(own))
        cols = {}
        for c in self.panel.values:
            s = F.col("_waves")[c]
            total = F.aggregate(s["w"], F.lit(0.0), lambda a, x: a + x["amplitude"] * F.cos(F.lit(2 * np.pi) * x["frequency"] * F.col("_t") + x["phase"]))
            cols[f"fourier_{c}"] = F.when(total.isNotNull(), F.least(F.greatest(total, F.lit(0.0)), s["most"]))
        return out.withColumns(cols).drop("_t", "_waves")

    def names(self, state: State) -> list[str]:
        return [f"fourier_{c}" for c in self.panel.values]


@dataclass
class Power(Estimator):
    """Yeo-Johnson or Box-Cox by the likeliest exponent, or by given ones, then mean 0 and deviation 1.

    The exponent comes from passes over grids around the best so far, of which all groups have their own.
    """

    columns: tuple[str, ...]
    method: str = "yeo-johnson"
    standardize: bool = True
    exponents: tuple[float, ...] | None = None

    def __post_init__(self) -> None:
        if self.method not in ("yeo-johnson", "box-cox"):
            raise ValueError(f"unknown method {self.method!r}")

    def _expr(self, x: Column, lam: Column) -> Column:
        raised = lambda y, e: (F.pow(y, e) - 1) / F.when(F.abs(e) >= 1e-9, e)
        if self.method == "box-cox":
            return F.when(F.abs(lam) < 1e-9, F.log(x)).otherwise(raised(x, lam))
        up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise(raised(x + 1, lam))
        down = F.when(F.abs(lam - 2) < 1e-9, -F.log1p(-x)).otherwise(-raised(1 - x, 2 - lam))
        return F.when(x >= 0, up).when(x < 0, down)

    def learn(self, df: DataFrame, groups: tuple[str, ...] = ()) -> State:
        cols = {i: F.col(c).cast("double") for i, c in enumerate(self.columns)}
        lam = lambda i: F.col(f"_lam_{i}")
        if self.method == "box-cox":
            low = df.agg(*[F.min(c).alias(str(i)) for i, c in enumerate(self.columns)]).first()
            if bad := [c for i, c in enumerate(self.columns) if low[str(i)] is None or low[str(i)] <= 0]:
                raise ValueError(f"Box-Cox needs positive values: {bad}")
        first = self.exponents or (0.0,) * len(self.columns)
        found = df.groupBy(*groups).agg(*[F.lit(float(e)).alias(f"_lam_{i}") for i, e in enumerate(first)])
        step = 0.5
        for _ in range(0 if self.exponents else 4):
            log = lambda i: F.log(cols[i]) if self.method == "box-cox" else F.signum(cols[i]) * F.log1p(F.abs(cols[i]))
            tried = attach(df, found, groups).groupBy(*groups).agg(
                *[F.first(f"_lam_{i}").alias(f"_lam_{i}") for i in cols], *[F.avg(log(i)).alias(f"_log_{i}") for i in cols],
                *[F.var_pop(self._expr(cols[i], lam(i) + step * k)).alias(f"_var_{i}_{k + 8}") for i in cols for k in range(-8, 9)],
            )
            likely = lambda i, k: -0.5 * F.log(F.greatest(F.coalesce(f"_var_{i}_{k + 8}", F.lit(0.0)), F.lit(1e-300))) + (lam(i) + step * k - 1) * F.coalesce(f"_log_{i}", F.lit(0.0))
            best = lambda i: F.array_max(F.array(*[F.struct(likely(i, k).alias("l"), F.lit(-k).alias("k")) for k in range(-8, 9)]))["k"]
            found = written(tried.select(*groups, *[(lam(i) - step * best(i)).alias(f"_lam_{i}") for i in cols]), "exponents")
            step /= 8
        stats = attach(df, found, groups).groupBy(*groups).agg(*[x for i in cols for x in (F.first(lam(i)).alias(f"_lam_{i}"), F.avg(self._expr(cols[i], lam(i))).alias(f"_mean_{i}"), F.stddev_pop(self._expr(cols[i], lam(i))).alias(f"_std_{i}"))])
        return {"exponents": stats}

    def apply(self, df: DataFrame, state: State, groups: tuple[str, ...] = ()) -> DataFrame:
        out, found = attach(df, state["exponents"], groups), {}
        for i, c in enumerate(self.columns):
            x, std = self._expr(F.col(c).cast("double"), F.col(f"_lam_{i}")), F.col(f"_std_{i}")
            found[c] = (x - F.coalesce(f"_mean_{i}", F.lit(0.0))) / F.when(std != 0, std).otherwise(1.0) if self.standardize else x
        return out.withColumns(found).drop(*[f"_{x}_{i}" for x in ("lam", "mean", "std") for i in range(len(self.columns))])

    def names(self, state: State) -> list[str]:
        return list(self.columns)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    kinds = ("int", "bigint", "smallint", "tinyint", "float", "double")
    return [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and c not in exclude]
