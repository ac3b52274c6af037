"""Settings: defaults, overlaid by a YAML or JSON file, overlaid by environment variables LODEGRAPH_<SECTION>_<NAME>."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields


@dataclass
class Parsing:
    max_file_size_mb: int = 25
    include_tests: bool = False
    include_docs: bool = False


@dataclass
class Embedding:
    provider: str = "hashing"
    dimension: int = 384
    max_text_length: int = 8192

    def __post_init__(self) -> None:
        if self.provider not in ("hashing", "custom"):
            raise ValueError(f"unknown embedding provider {self.provider!r}")


@dataclass
class Retrieval:
    max_results: int = 20
    threshold: float = 0.3
    hops: int = 2
    cache_seconds: int = 3600

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1 or not 1 <= self.max_results <= 1000:
            raise ValueError("threshold must be in 0..1 and max_results in 1..1000")


@dataclass
class Config:
    root: str = "graph"
    parsing: Parsing = field(default_factory=Parsing)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)


def merged(base: dict, over: Mapping) -> dict:
    """Two nested mappings as one; the second wins, section by section."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def _typed(value: str, like: object) -> object:
    if isinstance(like, bool):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return type(like)(value)


def load_config(path: str | None = None, env: Mapping[str, str] | None = None) -> Config:
    env = os.environ if env is None else env
    values = asdict(Config())
    if path:
        with open(path) as f:
            text = f.read()
        if path.endswith(".json"):
            given = json.loads(text)
        else:
            import yaml

            given = yaml.safe_load(text)
        unknown = set(given or {}) - set(values)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        values = merged(values, given or {})
    for section, content in list(values.items()):
        if isinstance(content, dict):
            for name, like in list(content.items()):
                if (got := env.get(f"LODEGRAPH_{section}_{name}".upper())) is not None:
                    values[section][name] = _typed(got, like)
        elif (got := env.get(f"LODEGRAPH_{section}".upper())) is not None:
            values[section] = got
    kinds = {"parsing": Parsing, "embedding": Embedding, "retrieval": Retrieval}
    return Config(**{f.name: kinds[f.name](**values[f.name]) if f.name in kinds else values[f.name] for f in fields(Config)})
