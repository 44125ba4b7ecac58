"""Tables in the folder that all machines share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one below the warehouse, removed when the driver's JVM ends.

    Both lie where every machine of a cluster sees them; a machine's own temporary folder is never used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_alignscope-{spark.sparkContext.applicationId}"
        remove_at_exit(spark, base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(df: DataFrame, label: str = "frame") -> DataFrame:
    """df written once to the shared folder as parquet and read back: cuts lineage, keeps columns prunable, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffles(spark: SparkSession) -> int:
    """How many shuffles Spark keeps the files of."""
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that are no longer referenced, instead of at its next collection.

    A frame that just ended is often held until a second collection, and files go on a thread of their own: collects until
    two collections in a row free nothing.
    """
    seen = [shuffles(spark)]
    while len(seen) < 12 and len(set(seen[-3:])) > 1 or len(seen) < 4:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
        seen.append(shuffles(spark))
