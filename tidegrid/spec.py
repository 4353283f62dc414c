"""Column roles and settings, passed to every operator instead of global constants."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Task(str, Enum):
    REGRESSION = "regression"
    CLASSIFICATION = "classification"


class FileFormat(str, Enum):
    PARQUET = "parquet"
    CSV = "csv"
    ORC = "orc"
    JSON = "json"


@dataclass(frozen=True)
class PanelSpec:
    """Which columns of a panel are its groups, its time and its values."""

    groups: tuple[str, ...]
    time: str
    values: tuple[str, ...] = ()
    ties: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.groups or not self.time:
            raise ValueError("a panel needs groups and a time column")


@dataclass(frozen=True)
class ColumnMapping:
    """Names in the source of the canonical trip columns; the last four may be missing."""

    start_time: str = "StartTime"
    end_time: str = "EndTime"
    start_station: str = "StartStationId"
    end_station: str = "EndStationId"
    trip_id: str | None = None
    user_id: str | None = None
    bike_id: str | None = None
    duration: str | None = None

    def renames(self) -> dict[str, str]:
        canonical = {"start_time": "StartTime", "end_time": "EndTime", "start_station": "StartStationId", "end_station": "EndStationId", "trip_id": "TripId", "user_id": "UserId", "bike_id": "BikeId", "duration": "ExistingTripDuration"}
        return {getattr(self, k): v for k, v in canonical.items() if getattr(self, k) is not None}


@dataclass(frozen=True)
class CleaningConfig:
    min_minutes: float = 0.5
    max_minutes: float = 1440.0
    min_round_trip_minutes: float = 3.0
    outliers: str = "iqr"
    iqr_factor: float = 1.5
    max_z: float = 3.0
    contamination: float = 0.1

    def __post_init__(self) -> None:
        if self.outliers not in ("iqr", "zscore", "isolation_forest", "none"):
            raise ValueError(f"unknown outlier method {self.outliers!r}")
        if not 0 <= self.min_minutes < self.max_minutes:
            raise ValueError("0 <= min_minutes < max_minutes must hold")


@dataclass(frozen=True)
class FeatureConfig:
    """What the feature pipeline derives. rbf names time parts or time_period with kernels and span.

    by_group: adjustment and spectra are learned for each group of the panel on its own. power, target, ordinal and onehot columns are
    those of the panel or derived ones; scaling leaves out what is encoded, what standardised powers made, and `unscaled`.
    """

    panel: PanelSpec
    lags: tuple[int, ...] = (1, 24)
    windows: tuple[int, ...] = (3, 24)
    stats: tuple[str, ...] = ("mean", "std")
    diffs: tuple[int, ...] = (24,)
    ewm: tuple[int, ...] = ()
    time_parts: tuple[str, ...] = ("hour", "dayofweek")
    time_period: bool = False
    transit: bool = False
    periods: dict[str, tuple[int, int]] = field(default_factory=dict)
    holidays: tuple[str, ...] = ()
    rbf: dict[str, tuple[int, tuple[float, float]]] = field(default_factory=lambda: {"hour": (12, (0, 23)), "dayofweek": (7, (0, 6))})
    harmonics: int = 30
    fourier_window: int = 24
    quantiles: tuple[float, ...] | None = (0, 0.3, 0.7, 1)
    use_diff: bool = True
    by_group: bool = False
    unseen: str = "error"
    power: tuple[str, ...] = ()
    power_method: str = "yeo-johnson"
    standardize: bool = True
    target: dict[str, tuple[str, ...]] = field(default_factory=dict)
    target_weight: float = 10.0
    target_smoothing: str = "additive"
    ordinal: tuple[str, ...] = ()
    unknown_ordinal: str = "use_encoded_value"
    onehot: tuple[str, ...] = ()
    unknown_onehot: str = "error"
    most_categories: int = 50
    scale: bool = True
    unscaled: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.panel.values:
            raise ValueError("the panel names no value columns")
        if any(k < 1 for k in (*self.lags, *self.windows, *self.diffs, *self.ewm)):
            raise ValueError("lags, windows, diffs and spans are at least 1")
        if unknown := set(self.rbf) - set(self.time_parts) - ({"time_period"} if self.time_period else set()):
            raise ValueError(f"RBF features {sorted(unknown)} aren't among the time parts")
        if both := set(self.ordinal) & set(self.onehot):
            raise ValueError(f"{sorted(both)} are encoded twice")
        if self.unseen not in ("error", "null"):
            raise ValueError("unseen is error or null")
