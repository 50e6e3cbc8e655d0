"""Configuration from YAML, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml


# The keys of the configuration file and the defaults of its parameters.
@dataclass(frozen=True)
class Paths:
    project_root: Path
    dataset_root: Path
    models_root: Path
    output_root: Path


@dataclass(frozen=True)
class ModelSpec:
    name: str
    provider: str
    model_id: str | None = None
    device: str | None = None
    dtype: str = "float32"


@dataclass(frozen=True)
class KnnSettings:
    k: int = 10


@dataclass(frozen=True)
class CommunitySettings:
    resolution: float = 1.0
    seed: int | None = 42


@dataclass(frozen=True)
class LayoutSettings:
    n_neighbors: int = 100
    min_dist: float = 0.1
    seed: int | None = 42
    metric: str = "cosine"


@dataclass(frozen=True)
class Settings:
    knn: KnnSettings = field(default_factory=KnnSettings)
    leiden: CommunitySettings = field(default_factory=CommunitySettings)
    umap: LayoutSettings = field(default_factory=LayoutSettings)


@dataclass(frozen=True)
class Dataset:
    name: str
    root: Path
    audio_dir: Path
    path_pattern: str
    metadata: dict[str, Any]


@dataclass(frozen=True)
class Config:
    paths: Paths
    models: dict[str, ModelSpec]
    datasets: dict[str, Dataset]
    parameters: Settings


def _section(raw: dict, name: str, where: str) -> dict:
    value = raw.get(name)
    if not isinstance(value, dict):
        raise ValueError(f"{where} needs a section {name!r}")
    return value


def _is_path(key: str) -> bool:
    return key in ("path", "files") or key.endswith(("_file", "_dir", "_path"))


def _resolved(value: Any, root: Path, key: str = "") -> Any:
    """Nested metadata with its paths below ``root``; strings in lists are paths whatever their key."""
    if isinstance(value, dict):
        return {k: _resolved(v, root, k) for k, v in value.items()}
    if isinstance(value, list):
        return [root / v if isinstance(v, str) else _resolved(v, root) for v in value]
    return root / value if isinstance(value, str) and _is_path(key) else value


def _document(path: Path) -> dict:
    """The mapping that a YAML file holds; whatever is wrong with the file is a ValueError."""
    with_path = f"{path} doesn't hold a mapping"
    try:
        with path.open(encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except Exception as e:
        raise ValueError(f"{with_path}: {e}") from e
    if isinstance(found, dict):
        return found
    raise ValueError(with_path)


def load_config(path: str | Path) -> Config:
    """Paths are relative to the file's folder (the project) or to the project (the rest). All three sections are required."""
    path = Path(path)
    raw = _document(path)
    given = _section(raw, "paths", str(path))
    if missing := [k for k in Paths.__dataclass_fields__ if k not in given]:
        raise ValueError(f"paths lack {', '.join(missing)}")
    project = (path.resolve().parent / str(given["project_root"])).resolve()
    paths = Paths(project, *((project / str(given[k])).resolve() for k in ("dataset_root", "models_root", "output_root")))
    models = {}
    for name, spec in _section(raw, "models", str(path)).items():
        if not isinstance(spec, dict) or "provider" not in spec:
            raise ValueError(f"model {name!r} needs a provider")
        models[name] = ModelSpec(name, str(spec["provider"]), spec.get("model_id"), spec.get("device"), spec.get("dtype", "float32"))
    datasets = {}
    for name, spec in _section(raw, "datasets", str(path)).items():
        if "root" not in _section(raw["datasets"], name, "datasets"):
            raise ValueError(f"dataset {name!r} needs a root")
        root = paths.dataset_root / str(spec["root"])
        audio = _section(spec, "audio", name)
        if "dir" not in audio or "path" not in audio:
            raise ValueError(f"audio of {name!r} needs dir and path")
        datasets[name] = Dataset(name, root, root / str(audio["dir"]), str(audio["path"]), _resolved(spec.get("metadata") or {}, root))
    given = raw.get("parameters") or {}
    if not isinstance(given, dict):
        raise ValueError("parameters must be a mapping")
    parts = {"knn": KnnSettings, "leiden": CommunitySettings, "umap": LayoutSettings}
    return Config(paths, models, datasets, Settings(**{k: kind(**(given.get(k) or {})) for k, kind in parts.items()}))


def split_file(metadata: dict[str, Any], split: str) -> Path:
    """The file of a split named train, val or test."""
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split!r}")
    value = metadata.get("split", {}).get(f"{split}_file")
    if not isinstance(value, Path):
        raise ValueError(f"no file is configured for split {split!r}")
    return value
