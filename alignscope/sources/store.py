"""A pair kept as parquet: written once, read by every query with column pruning and pushed filters."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..model import ALIGN, ATTR, REL, KGPair
from ..storage import remove_at_exit, shared_folder, stored  # noqa: F401


def save(pair: KGPair, path: str) -> KGPair:
    """Writes rel, attr and align below path, and returns the pair that reads them."""
    for name in ("rel", "attr", "align"):
        getattr(pair, name).write.mode("overwrite").parquet(f"{path}/{name}")
    return StoredLoader(pair.name).load(pair.rel.sparkSession, path)


def save_temporarily(pair: KGPair) -> KGPair:
    """The same in the shared folder, removed when the driver's JVM ends."""
    spark = pair.rel.sparkSession
    path = f"{shared_folder(spark)}/pair-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return save(pair, path)


class StoredLoader:
    supported_formats = ("parquet",)

    def __init__(self, name: str = "stored"):
        self.name = name

    def load(self, spark: SparkSession, path: str) -> KGPair:
        frames = (spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("rel", REL), ("attr", ATTR), ("align", ALIGN)))
        return KGPair(self.name, *frames)
