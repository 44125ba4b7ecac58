"""The output folder of an external fixpoint aligner: numbered <n>_eqv.tsv files of entity, entity, score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literals as L
from ..model import KGPair


def files(spark: SparkSession, folder: str) -> list[tuple[str, int, bool]]:
    """(path, size, whether a folder) of what lies in a folder, asked of Spark's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(folder)
    return [(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in fs.listStatus(p)]


def read_equivalences(spark: SparkSession, folder: str, pair: KGPair | None = None) -> DataFrame:
    """(e1, e2, score) of the non-empty file with the highest number, the best e2 of each e1 (ties: the least).

    Angle brackets are stripped and mapped IRIs turned back; a score that is no number counts as 0. With a pair, rows
    whose ends are no entities of its graphs go. A folder without such a file gives no rows.
    """
    numbered = [(int(m[1]), path) for path, size, _ in files(spark, folder) if size and (m := re.search(r"(?:^|/)(\d+)_eqv\.tsv$", path))]
    if not numbered:
        return spark.createDataFrame([], "e1 string, e2 string, score double")
    parts = F.split("value", "\t")
    name = lambda i: L.from_iri(F.regexp_replace(F.get(parts, F.lit(i)), r"^<|>$", ""))
    score = F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0))
    t = spark.read.text(max(numbered)[1]).where(F.size(parts) >= 2).select(name(0).alias("e1"), name(1).alias("e2"), score.alias("score"))
    if pair is not None:
        for i in (1, 2):
            t = t.join(pair.entities().where(F.col("kg") == f"kg{i}").select(F.col("entity").alias(f"e{i}")), f"e{i}", "left_semi")
    best = t.groupBy("e1").agg(F.max("score").alias("score"))
    return t.join(best, ["e1", "score"]).groupBy("e1", "score").agg(F.min("e2").alias("e2")).select("e1", "e2", "score")
