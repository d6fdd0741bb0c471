"""Settings, read from YAML with defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class BuildConfig:
    raw_csv: str = "data/raw/rows.csv"
    processed_dir: str = "data/processed"
    outputs_dir: str = "data/outputs"
    cache_dir: str = "data/cache"


@dataclass(frozen=True)
class SieveConfig:
    """threshold_method: iqr or quantile; global_threshold_method: quantile or iqr."""

    threshold_method: str = "iqr"
    iqr_k: float = 1.5
    quantile_q: float = 0.05
    min_category_samples: int = 8
    global_threshold_method: str = "quantile"
    global_quantile_q: float = 0.10
    batch_size: int = 16
    device: str = "cpu"


#: What the sieve can't do without, by section.
MANDATORY = {"data": ("processed_dir", "outputs_dir", "cache_dir"), "models": ("clip_model_name",)}


def _read(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def missing(path: str | Path) -> list[str]:
    """Mandatory keys that a YAML file lacks, as section.key."""
    given = _read(path)
    return [f"{section}.{key}" for section, keys in MANDATORY.items() for key in keys if (given.get(section) or {}).get(key) is None]


def model_name(path: str | Path) -> str | None:
    """The model that a YAML file names, for whoever makes it (see sources.embedding)."""
    return (_read(path).get("models") or {}).get("clip_model_name")


def load(path: str | Path, strict: bool = False) -> tuple[BuildConfig, SieveConfig]:
    """The sections data and sieve of a YAML file; unknown keys are left alone, absent ones take the defaults, or with
    strict are an error where they are mandatory."""
    given = _read(path)
    if strict and (gone := missing(path)):
        raise ValueError(f"{path} lacks {', '.join(gone)}")

    def section(kind, name):
        own = given.get(name) or {}
        return kind(**{f.name: type(f.default)(own[f.name]) for f in fields(kind) if own.get(f.name) is not None})

    return section(BuildConfig, "data"), section(SieveConfig, "sieve")
