"""Study configuration: frozen dataclasses, read from YAML or JSON text and hashed."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field


class ConfigError(ValueError):
    """A configuration that is incomplete or contradicts itself."""


@dataclass(frozen=True)
class FeatureConfig:
    return_windows: tuple[int, ...] = (5, 10, 20)
    volatility_windows: tuple[int, ...] = (5, 10, 20)
    trend_windows: tuple[int, ...] = (10, 20, 60)
    volume_window: int = 20
    days_per_year: int = 252


@dataclass(frozen=True)
class TargetConfig:
    horizon: int = 5

    @property
    def column(self) -> str:
        return f"forward_return_{self.horizon}d"


@dataclass(frozen=True)
class RegimeConfig:
    volatility_column: str = "volatility_20d"
    threshold_column: str = "historical_volatility_threshold_20d"
    min_history: int = 252
    equality_rule: str = "HighVol"


@dataclass(frozen=True)
class FoldConfig:
    n_folds: int = 6
    min_train: int = 1260
    horizon: int = 5
    min_first_train: int = 1000
    max_gap_days: int = 7


@dataclass(frozen=True)
class ModelConfig:
    seed: int = 42
    constant_std: float = 1e-6
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    features: FeatureConfig = FeatureConfig()
    target: TargetConfig = TargetConfig()
    regime: RegimeConfig = RegimeConfig()
    folds: FoldConfig = FoldConfig()
    model: ModelConfig = ModelConfig()

    def __post_init__(self) -> None:
        if self.regime.equality_rule not in ("HighVol", "LowVol"):
            raise ConfigError(f"equality_rule {self.regime.equality_rule!r} is neither HighVol nor LowVol")
        if self.target.horizon != self.folds.horizon:
            raise ConfigError("the folds' horizon is not the target's")
        if self.regime.volatility_column not in feature_names(self.features):
            raise ConfigError(f"{self.regime.volatility_column} is not a feature")

    def hash(self) -> str:
        text = json.dumps(dataclasses.asdict(self), sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()


def feature_names(f: FeatureConfig = FeatureConfig()) -> list[str]:
    return [
        "return_1d",
        *(f"return_{n}d" for n in f.return_windows),
        *(f"volatility_{n}d" for n in f.volatility_windows),
        *(f"trend_{n}d" for n in f.trend_windows),
        f"volume_ratio_{f.volume_window}d",
    ]


SECTIONS = {"features": FeatureConfig, "target": TargetConfig, "regime": RegimeConfig, "folds": FoldConfig, "model": ModelConfig}


def parse(values: dict) -> Config:
    """Config of a nested dictionary; every section must be there, numbers may be strings."""
    missing = [s for s in SECTIONS if not isinstance(values.get(s), dict)]
    if missing:
        raise ConfigError(f"sections missing: {', '.join(missing)}")
    made = {}
    for name, kind in SECTIONS.items():
        known = {f.name: f for f in dataclasses.fields(kind)}
        unknown = set(values[name]) - set(known)
        if unknown:
            raise ConfigError(f"{name}: unknown {', '.join(sorted(unknown))}")
        base = kind()
        made[name] = kind(**{k: _like(getattr(base, k), v, f"{name}.{k}") for k, v in values[name].items()})
    return Config(**made)


def _like(sample: object, value: object, where: str) -> object:
    try:
        if isinstance(sample, tuple):
            return tuple(int(v) for v in value)
        if isinstance(sample, dict):
            return dict(value)
        return type(sample)(value)
    except (TypeError, ValueError) as error:
        raise ConfigError(f"{where}: {value!r}") from error


def load(path: str) -> Config:
    """Config of a JSON file, or a YAML file where a YAML parser is installed."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        return parse(json.loads(text))
    import yaml

    return parse(yaml.safe_load(text))
