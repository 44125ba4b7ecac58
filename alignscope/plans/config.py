"""The run configuration: a YAML file as dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class DatasetConfig:
    name: str
    path: str
    loader: str = "openea"
    fold: int = 1
    match_ratio: float | None = None
    seed: int = 42
    skip_matchers: list[str] = field(default_factory=list)


@dataclass
class MatcherConfig:
    name: str
    params: dict = field(default_factory=dict)


@dataclass
class RunConfig:
    datasets: list[DatasetConfig]
    metrics: list[str]
    matchers: list[MatcherConfig]
    output: str = "results"
    eval_split: str = "test"
    seed_split: str = "train"


def matcher(entry) -> MatcherConfig:
    """A bare name, or a mapping with name and params."""
    return MatcherConfig(entry) if isinstance(entry, str) else MatcherConfig(entry["name"], dict(entry.get("params") or {}))


def from_dict(raw: dict) -> RunConfig:
    return RunConfig(
        [DatasetConfig(**d) for d in raw.get("datasets", [])],
        list(raw.get("metrics", [])),
        [matcher(m) for m in raw.get("matchers", [])],
        raw.get("output", "results"),
        raw.get("eval_split", "test"),
        raw.get("seed_split", "train"),
    )


def load_config(path: str) -> RunConfig:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {})
