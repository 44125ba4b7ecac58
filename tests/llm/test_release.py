"""Shuffle files of finished steps go before the next step writes its own."""

import gc
import time

from alignscope.llm import common, suffix_dedup

from . import cases


def kept(spark) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def settled(spark) -> int:
    for _ in range(6):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return kept(spark)


def test_suffix_dedup_holds_no_shuffles_before_the_texts_are_joined(spark):
    docs = cases.documents(spark).select("doc_id", "text").where("doc_id is not null")
    before = settled(spark)
    masks = suffix_dedup.repeated_strings(docs)
    assert kept(spark) <= before
    assert masks.count() > 0


def test_release_drops_only_what_is_not_referenced(spark):
    before = settled(spark)
    held = spark.range(100).repartition(5, "id").localCheckpoint(eager=False)
    held.count()
    mine = kept(spark)
    common.stored(spark.range(1000).groupBy((common.F.col("id") % 7).alias("k")).count().repartition(3, "k"), "gone")
    common.release(spark)
    assert before < mine and kept(spark) <= mine
    assert held.count() == 100
