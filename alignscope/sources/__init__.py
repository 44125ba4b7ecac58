"""Loaders by name."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import SparkSession

from ..model import KGPair
from .openea import OpenEALoader
from .store import StoredLoader
from .tables import TablesLoader


class Loader(Protocol):
    """What a loader offers; options such as a fold go to its constructor."""

    supported_formats: tuple[str, ...]

    def load(self, spark: SparkSession, path: str) -> KGPair: ...


LOADERS: dict[str, type[Loader]] = {"openea": OpenEALoader, "tables": TablesLoader, "stored": StoredLoader}


def get_loader(name: str, **options) -> Loader:
    if name not in LOADERS:
        raise ValueError(f"Unknown loader {name!r}; known: {sorted(LOADERS)}")
    return LOADERS[name](**options)
