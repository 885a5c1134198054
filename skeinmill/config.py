"""Settings as frozen dataclasses with overrides from a mapping or a YAML-like file."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Chunking:
    strategy: str = "recursive"
    chunk_size: int = 512
    chunk_overlap: int = 64


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    rerank_candidates: int = 20
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    rrf_k: int = 60


@dataclass(frozen=True)
class Generation:
    max_context_tokens: int = 3500


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)


def override(base: Any, values: dict[str, Any]) -> Any:
    """A copy with nested values replaced; an unknown key or a section that isn't a mapping raises."""
    names = {f.name: getattr(base, f.name) for f in dataclasses.fields(base)}
    changes = {}
    for key, value in values.items():
        if key not in names:
            raise KeyError(f"unknown setting {key!r}")
        if dataclasses.is_dataclass(names[key]):
            if not isinstance(value, dict):
                raise TypeError(f"setting {key!r} takes a mapping")
            value = override(names[key], value)
        changes[key] = value
    return dataclasses.replace(base, **changes)


def load(path: str | Path) -> Settings:
    """Settings from a JSON or YAML file whose top is a mapping; an empty file changes nothing."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        values = yaml.safe_load(text)
    else:
        values = json.loads(text or "{}")
    if values is None:
        values = {}
    if not isinstance(values, dict):
        raise TypeError("the settings file must hold a mapping")
    return override(Settings(), values)
