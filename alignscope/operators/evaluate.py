"""Scores of predictions, sweeps over thresholds, seeds and folds, and benchmark variants with partnerless entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..model import KGPair
from ..storage import stored

GRID = tuple(i / 10 for i in range(10))
SEED_FRACTIONS = (0.05, 0.1, 0.25, 0.5, 0.75, 1.0)


def _harmonic(p, r):
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def _scores(t: DataFrame, keys: list[str]) -> DataFrame:
    """From n_gold, n_unmatched, n_universe, n_predicted, n_correct, n_false_on_unmatched."""
    p, r = ratio("n_correct", "n_predicted"), ratio("n_correct", "n_gold")
    cover = ratio("n_predicted", "n_universe")
    return t.select(
        *keys, "n_gold", "n_unmatched", "n_predicted", "n_correct", "n_false_on_unmatched", p.alias("precision"), r.alias("recall"), _harmonic(p, r).alias("f1"), r.alias("hits_at_1"), cover.alias("coverage"), (1 - cover).alias("abstain_rate")
    )


def _judged(predictions: DataFrame, pair: KGPair, split: str) -> tuple[DataFrame, DataFrame]:
    """Best prediction per e1 of the split with correct and unmatched marks; and one row of sizes."""
    scope = pair.split(split)
    sizes = scope.agg(F.countDistinct(F.when(F.col("e2") != "", F.struct("e1", "e2"))).alias("n_gold"), F.countDistinct(F.when(F.col("e2") == "", F.col("e1"))).alias("n_unmatched"), F.countDistinct("e1").alias("n_universe"))
    order = W.partitionBy("e1").orderBy(F.desc("score"), "e2")
    best = predictions.join(scope.select("e1").distinct(), "e1", "left_semi").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    gold = scope.select("e1", F.col("e2").alias("g")).distinct()
    judged = best.join(gold, "e1").groupBy("e1", "e2", "score").agg(F.max((F.col("g") == F.col("e2")).cast("int")).alias("correct"), F.max((F.col("g") == "").cast("int")).alias("unmatched"))
    return judged, sizes


def _counted(judged: DataFrame) -> list:
    return [F.count("e1").alias("n_predicted"), F.coalesce(F.sum("correct"), F.lit(0)).alias("n_correct"), F.coalesce(F.sum("unmatched"), F.lit(0)).alias("n_false_on_unmatched")]


def evaluate(predictions: DataFrame, pair: KGPair, split: str = "test") -> DataFrame:
    """One row. Predictions for entities outside the split are ignored; those for partnerless ones are wrong."""
    judged, sizes = _judged(predictions, pair, split)
    return _scores(judged.agg(*_counted(judged)).crossJoin(sizes), [])


def threshold_sweep(candidates: DataFrame, pair: KGPair, split: str = "valid", grid=GRID) -> DataFrame:
    """A row per threshold, from candidates computed once: a best candidate counts up to its score."""
    judged, sizes = _judged(candidates, pair, split)
    steps = pair.align.sparkSession.createDataFrame([(float(g),) for g in grid], "threshold double")
    t = F.broadcast(steps).join(judged, F.col("score") >= F.col("threshold"), "left").groupBy("threshold").agg(*_counted(judged))
    return _scores(t.crossJoin(sizes), ["threshold"])


def threshold_choice(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys the threshold with the best F1, the lowest of equals."""
    order = W.partitionBy(*keys).orderBy(F.desc(F.round("f1", 9)), "threshold") if keys else W.orderBy(F.desc(F.round("f1", 9)), "threshold")
    return sweep.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, "threshold", "f1")


def _numbered(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with _r, their place (from 1) by the columns, and _n, their number.

    Rows are sorted in ranges, and only the ranges' sizes meet in one place.
    """
    t = stored(rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    sizes = t.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_size").over(W.partitionBy())})
    return t.join(F.broadcast(sizes), "_part").withColumn("_r", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_size", "_first", "_before")


def _rank(seed: int, *columns: str):
    """A portable random order: the digest of the row with the seed."""
    return F.md5(F.concat_ws("|", *columns, F.lit(str(seed))))


def seed_subsets(seeds: DataFrame, fractions=SEED_FRACTIONS, seed: int = 42) -> DataFrame:
    """(fraction, e1, e2): nested subsets; a fraction has round(n * fraction) seeds, half to even, one at least."""
    ranked = seeds.select("e1", "e2").distinct().withColumn("h", _rank(seed, "e1", "e2"))
    t = _numbered(ranked, "h", "e1", "e2")
    steps = seeds.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double")
    return t.join(F.broadcast(steps), F.col("_r") <= F.greatest(F.rint(F.col("_n") * F.col("fraction")), F.lit(1.0))).select("fraction", "e1", "e2")


def seed_size_sweep(pair: KGPair, matcher, fractions=SEED_FRACTIONS, seed: int = 42, split: str = "test") -> DataFrame:
    """(fraction, n_seeds, scores): the matcher run and evaluated with each nested subset of the training pairs.

    A matcher is anything with match(pair, seeds). Predictions are stored before they are judged, so each run is one plan.
    """
    subsets = stored(seed_subsets(pair.matched("train"), fractions, seed), "seeds")
    counts = subsets.groupBy("fraction").agg(F.count("*").alias("n_seeds"))
    out = None
    for f in fractions:
        found = stored(matcher.match(pair, subsets.where(F.col("fraction") == float(f)).select("e1", "e2")), "predictions")
        row = evaluate(found, pair, split).withColumn("fraction", F.lit(float(f)))
        out = row if out is None else out.union(row)
    return out.join(F.broadcast(counts), "fraction", "left").na.fill(0, ["n_seeds"])


def threshold_means(sweeps: DataFrame) -> DataFrame:
    """(matcher, threshold, f1): mean F1 over datasets of sweeps with dataset, matcher, threshold, f1.

    threshold_choice() of it, by matcher, is the threshold that serves all datasets best.
    """
    return sweeps.groupBy("matcher", "threshold").agg(F.avg("f1").alias("f1"))


def seed_sizes(pair: KGPair, fractions=SEED_FRACTIONS, seed: int = 42) -> DataFrame:
    """(fraction, n_seeds, share_of_entities)."""
    n = pair.entities().where("kg = 'kg1'").agg(F.count("*").alias("n"))
    t = seed_subsets(pair.matched("train"), fractions, seed).groupBy("fraction").agg(F.count("*").alias("n_seeds"))
    return t.crossJoin(n).select("fraction", "n_seeds", ratio("n_seeds", "n").alias("share_of_entities"))


def inject_non_matches(pair: KGPair, match_ratio: float = 0.5, seed: int = 42) -> KGPair:
    """Keeps round(n * ratio) gold pairs; of the others half lose their kg1 entity and the rest their kg2 entity.

    Entities of kg1 without a partner stay in the alignment with an empty e2. The input is not changed.
    """
    if not 0 < match_ratio <= 1:
        raise ValueError(f"match_ratio must lie in (0, 1], not {match_ratio}")
    pairs = pair.matched().groupBy("e1", "e2").agg(F.min("split").alias("split")).withColumn("h", _rank(seed, "e1", "e2"))
    t = _numbered(pairs, "h", "e1", "e2")
    keep = F.rint(F.col("_n") * match_ratio)
    half = F.floor((F.col("_n") - keep) / 2)
    role = F.when(F.col("_r") <= keep, "keep").when(F.col("_r") <= keep + half, "drop1").otherwise("drop2")
    t = t.select("e1", "e2", "split", role.alias("role"))
    gone = t.where("role = 'drop1'").select(F.lit("kg1").alias("kg"), F.col("e1").alias("entity")).union(t.where("role = 'drop2'").select(F.lit("kg2"), "e2"))
    align = t.where("role = 'keep'").select("e1", "e2", "split").union(t.where("role = 'drop2'").select("e1", F.lit(""), "split")).union(pair.unmatched().select("e1", "e2", "split"))
    without = lambda df, c: df.join(gone.select("kg", F.col("entity").alias(c)), ["kg", c], "left_anti").select(*df.columns)
    return pair.with_frames(rel=without(without(pair.rel, "head"), "tail"), attr=without(pair.attr, "head"), align=align, meta=pair.meta | {"match_ratio": match_ratio, "seed": seed})


def variant_summary(original: KGPair, variant: KGPair) -> DataFrame:
    """(version, n_matched, n_unmatched, n_rel_triples, n_attr_triples)."""
    out = None
    for name, p in (("original", original), ("variant", variant)):
        row = p.align.agg(F.count_if(F.col("e2") != "").alias("n_matched"), F.count_if(F.col("e2") == "").alias("n_unmatched")).crossJoin(p.rel.agg(F.count("*").alias("n_rel_triples"))).crossJoin(p.attr.agg(F.count("*").alias("n_attr_triples")))
        row = row.select(F.lit(name).alias("version"), "*")
        out = row if out is None else out.union(row)
    return out


def fold_variance(scores: DataFrame) -> DataFrame:
    """Per (dataset, matcher) over folds: mean, sample deviation, least and largest F1, precision, number of folds."""
    return scores.groupBy("dataset", "matcher").agg(F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std"), F.min("f1").alias("f1_min"), F.max("f1").alias("f1_max"), F.avg("precision").alias("precision_mean"), F.stddev_samp("precision").alias("precision_std"), F.count("*").alias("n_folds"))


def spread(variance: DataFrame) -> DataFrame:
    """Per matcher: deviation of mean F1 across datasets beside the mean deviation across folds."""
    across = variance.groupBy("matcher").agg(F.stddev_samp("f1_mean").alias("spread_across_datasets"), F.count("*").alias("n_datasets"))
    within = variance.groupBy("matcher").agg(F.avg("f1_std").alias("mean_fold_std"))
    return across.join(within, "matcher", "left")
