"""The session of a run, and the core metric groups timed as one job."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..model import KGPair
from ..operators import metrics as P
from ..sources import get_loader

CORE = ("basic_stats", "degree_distribution", "property_distribution")


def get_session(app: str = "alignscope", master: str | None = None, memory: str | None = None, partitions: int | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """A session with adaptive plans and skew joins; what is not given is left to spark-submit and the cluster's defaults."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    given = {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": partitions, "spark.checkpoint.dir": checkpoint_dir}
    for key, value in given.items():
        if value is not None:
            b = b.config(key, str(value))
    return (b.master(master) if master else b).getOrCreate()


def core_metrics(pair: KGPair) -> DataFrame:
    """(dataset, metric, key, value) of the core groups."""
    out = None
    for name in CORE:
        rows = P.scalars(pair, name)
        out = rows if out is None else out.union(rows)
    return out


def timed_core(spark: SparkSession, path: str, loader: str = "openea", **options) -> tuple[dict[str, float | None], float]:
    """({metric.key: value}, seconds) of loading a dataset and computing its core metrics; a bounded number of values."""
    began = time.time()
    rows = core_metrics(get_loader(loader, **options).load(spark, path)).collect()
    return {f"{r.metric}.{r.key}": r.value for r in rows}, time.time() - began
