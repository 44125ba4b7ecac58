"""Why each test entity was missed: a cascade of causes that depends on the matcher's family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..model import KGPair
from . import graph as G
from .numbered import digest, largest_roots, number, numbers, value_sets

#: The classes in the order of reports; those that no method of the family could solve.
CLASSES = ("correct", "true_negative", "false_on_unmatched", "no_signal", "structurally_unreachable", "no_shared_literal", "abstained", "wrong_candidate")
UNSOLVABLE = ("no_signal", "structurally_unreachable", "no_shared_literal")
NO_ERROR = ("correct", "true_negative")


def features(pair: KGPair, split: str = "test", largest: DataFrame | None = None) -> DataFrame:
    """Per entity of the split: gold partner, degrees, attributes, shared values, both sides in the largest component; set: the digest of its values."""
    t = pair.split(split).groupBy("e1").agg(F.max("e2").alias("e2_gold"))
    sets = value_sets(pair)
    table, seed = numbers(pair)
    roots = largest_roots(pair) if largest is None else None
    if roots is None:
        largest = G.largest_component(pair) if largest is None else largest
    for i, e in ((1, "e1"), (2, "e2_gold")):
        kg, mark = f"kg{i}", F.col("root") == (roots or {}).get(f"kg{i}")
        own = table.where(F.col("id").bitwiseAND(F.lit(1)) == i - 1).select(F.col("id").alias("_id"), F.col("degree").alias(f"degree_{kg}"), *([mark.alias(f"in{i}")] if roots else []))
        t = t.withColumn("_id", number(seed, F.lit(kg), F.col(e))).join(own, "_id", "left").drop("_id")
        t = t.join(sets.where(F.col("kg") == kg).select(F.col("entity").alias(e), F.col("n_attr").alias(f"n_attr_{kg}"), F.col("has").alias(f"_has{i}")), e, "left")
        if not roots:
            t = t.join(largest.where(F.col("kg") == kg).select(F.col("entity").alias(e), F.lit(True).alias(f"in{i}")), e, "left")
    shared = F.when(F.col("e2_gold") != "", F.size(F.array_intersect("_has1", "_has2"))).cast("long")
    t = t.withColumns({"shared_literals": F.when(shared > 0, shared), "set": digest("_has1")})
    t = t.select("e1", "e2_gold", "degree_kg1", "degree_kg2", "n_attr_kg1", "shared_literals", "in1", "in2", "set")
    return t.na.fill(0, ["degree_kg1", "degree_kg2", "n_attr_kg1", "shared_literals"]).na.fill(False, ["in1", "in2"])


def classify(facts: DataFrame, predictions: DataFrame, family: str = "holistic") -> DataFrame:
    """(e1, e2_gold, e2_pred, has_gold, degrees, n_attr_kg1, shared_literals, error_class)."""
    order = W.partitionBy("e1").orderBy(F.desc("score"), "e2")
    best = predictions.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("e1", F.col("e2").alias("e2_pred"))
    t = facts.join(best, "e1", "left")
    gold, silent = F.col("e2_gold") != "", F.col("e2_pred").isNull()
    cut_off = (F.col("degree_kg1") == 0) | (F.col("degree_kg2") == 0) | ~(F.col("in1") & F.col("in2"))
    apart = F.col("shared_literals") == 0
    cause = (
        F.when(gold & (F.col("e2_pred") == F.col("e2_gold")), "correct")
        .when(~gold & ~silent, "false_on_unmatched")
        .when(~gold, "true_negative")
        .when((F.col("degree_kg1") == 0) & (F.col("n_attr_kg1") == 0), "no_signal")
    )
    if family == "structural":
        cause = cause.when(cut_off, "structurally_unreachable")
    elif family == "value":
        cause = cause.when(apart, "no_shared_literal")
    else:
        cause = cause.when(cut_off & apart, "structurally_unreachable")
    cause = cause.when(silent, "abstained").otherwise("wrong_candidate")
    return t.select("e1", "e2_gold", "e2_pred", gold.alias("has_gold"), "degree_kg1", "degree_kg2", "n_attr_kg1", "shared_literals", cause.alias("error_class"))


def summarize(classified: DataFrame, dataset: str, matcher: str) -> DataFrame:
    """(dataset, matcher, error_class, n, share), all classes."""
    classes = classified.sparkSession.createDataFrame([(c,) for c in CLASSES], "error_class string")
    n = classified.groupBy("error_class").agg(F.count("*").alias("n"))
    t = classes.join(n, "error_class", "left").na.fill(0)
    return t.select(F.lit(dataset).alias("dataset"), F.lit(matcher).alias("matcher"), "error_class", "n", ratio(F.col("n"), F.sum("n").over(W.partitionBy())).alias("share"))


def solvability(summary: DataFrame) -> DataFrame:
    """Per (dataset, matcher): errors, those no method of the family could avoid, and both shares (4 digits)."""
    wrong, lost = ~F.col("error_class").isin(*NO_ERROR), F.col("error_class").isin(*UNSOLVABLE)
    t = summary.groupBy("dataset", "matcher").agg(F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("n_errors"), F.sum(F.when(lost, F.col("n")).otherwise(0)).alias("n_unsolvable"))
    share = ratio("n_unsolvable", "n_errors")
    return t.select("*", F.round(share, 4).alias("unsolvable_share"), F.when(F.col("n_errors") == 0, 0.0).otherwise(F.round(1 - share, 4)).alias("method_share"))


def examples(classified: DataFrame, k: int = 3) -> DataFrame:
    """The k entities of each error class whose degrees differ most."""
    gap = F.abs(F.col("degree_kg1") - F.col("degree_kg2"))
    rank = F.row_number().over(W.partitionBy("error_class").orderBy(F.desc(gap), "e1"))
    t = classified.where(~F.col("error_class").isin(*NO_ERROR)).withColumns({"degree_gap": gap, "rank": rank.cast("long")})
    return t.where(F.col("rank") <= k).select("error_class", "rank", "e1", "e2_gold", "e2_pred", "degree_gap")


def mean_shares(summaries: DataFrame) -> DataFrame:
    """Per matcher the mean share of each class, a column per class in report order."""
    return summaries.groupBy("matcher").pivot("error_class", list(CLASSES)).agg(F.avg("share"))
