"""Folders of benchmark datasets: which are there, which are whole, and a configuration that names them all."""

from __future__ import annotations

import os
import urllib.request
import zipfile

from pyspark.sql import SparkSession

from ..sources.openea import exists
from ..sources.paris import files

#: What a dataset consists of.
REQUIRED = ("rel_triples_1", "rel_triples_2", "attr_triples_1", "attr_triples_2", "ent_links")


def found(spark: SparkSession, root: str) -> dict[str, str]:
    """Name to path of every folder below root that has ent_links."""
    return {p.rstrip("/").rsplit("/", 1)[-1]: p for p, _, is_dir in sorted(files(spark, root)) if is_dir and exists(spark, f"{p}/ent_links")}


def missing_files(spark: SparkSession, path: str) -> list[str]:
    """Required files of a dataset that are not there or empty."""
    return [f for f in REQUIRED if not exists(spark, f"{path}/{f}")]


def extended_config(spark: SparkSession, root: str, base: dict | None = None) -> dict:
    """base with every dataset below root, as a mapping that plans.config reads."""
    return (base or {}) | {"datasets": [{"name": name, "path": path} for name, path in found(spark, root).items()]}


def write_config(config: dict, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(config, f, sort_keys=False, allow_unicode=True)


def fetch(url: str, target: str, wanted: set[str] | None = None) -> list[str]:
    """Loads a zip file unless it is there, and unpacks its datasets (or the wanted ones) beside it; returns their names."""
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    if not os.path.exists(target):
        part = f"{target}.part"
        urllib.request.urlretrieve(url, part)
        os.replace(part, target)
    root, names = os.path.dirname(os.path.abspath(target)), set()
    with zipfile.ZipFile(target) as z:
        for member in z.namelist():
            folders = member.split("/")[:-1]
            if (name := next((f for f in folders if wanted is None or f in wanted), None)) and ".." not in folders:
                z.extract(member, root)
                names.add(name)
    return sorted(names)
