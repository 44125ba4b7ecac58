"""Benchmark directories of tab-separated triples: rel_triples_1/2, attr_triples_1/2, ent_links, 721_5fold/<fold>/*_links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KGPair


def split_text(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Lines split at tabs; missing fields are empty, further tabs stay in the last field, empty lines are dropped."""
    parts = F.split("value", "\t", len(columns))
    lines = spark.read.text(paths).where(F.length("value") > 0)
    return lines.select(*(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists with something in it, asked of Spark's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getContentSummary(p).getLength() > 0


def is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


class OpenEALoader:
    supported_formats = ("openea",)

    def __init__(self, fold: int = 1):
        self.fold = fold

    def load(self, spark: SparkSession, path: str) -> KGPair:
        path = str(path).rstrip("/")
        if not is_dir(spark, path):
            raise FileNotFoundError(path)

        def table(stem: str, columns: list[str], schema: str) -> DataFrame:
            out = []
            for i in (1, 2):
                if exists(spark, f"{path}/{stem}_{i}"):
                    out.append(split_text(spark, [f"{path}/{stem}_{i}"], columns).select(F.lit(f"kg{i}").alias("kg"), *columns))
            frame = out[0] if out else spark.createDataFrame([], schema)
            return frame.union(out[1]) if len(out) > 1 else frame

        rel = table("rel_triples", ["head", "relation", "tail"], "kg string, head string, relation string, tail string")
        attr = table("attr_triples", ["head", "attribute", "literal"], "kg string, head string, attribute string, literal string")
        return KGPair(path.rsplit("/", 1)[-1], rel, attr, self.alignment(spark, path), {"fold": self.fold})

    def alignment(self, spark: SparkSession, path: str) -> DataFrame:
        """The splits of the fold, or all links where it has none."""
        out = None
        for name in ("train", "valid", "test"):
            file = f"{path}/721_5fold/{self.fold}/{name}_links"
            if exists(spark, file):
                part = split_text(spark, [file], ["e1", "e2"]).withColumn("split", F.lit(name))
                out = part if out is None else out.union(part)
        if out is None and exists(spark, f"{path}/ent_links"):
            out = split_text(spark, [f"{path}/ent_links"], ["e1", "e2"]).withColumn("split", F.lit("all"))
        return out if out is not None else spark.createDataFrame([], "e1 string, e2 string, split string")
