"""Reports across datasets: comparison tables, correlations with corrections, controlled contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats as S

#: The columns of the headline table.
HEADLINE = (
    "basic_stats.kg1.n_entities", "basic_stats.kg2.n_entities", "basic_stats.kg1.n_rel_triples", "basic_stats.kg2.n_rel_triples", "basic_stats.kg1.n_attr_triples", "basic_stats.kg2.n_attr_triples",
    "basic_stats.n_alignments", "basic_stats.size_asymmetry", "degree_distribution.kg1.total.mean", "degree_distribution.kg2.total.mean", "degree_distribution.kg1.share_isolated", "degree_distribution.kg2.share_isolated",
    "connectivity.kg1.share_largest_cc", "connectivity.kg2.share_largest_cc", "attribute_completeness.kg1.share_entities_with_attribute", "attribute_completeness.kg2.share_entities_with_attribute",
    "schema_heterogeneity.property.jaccard", "aligned_consistency.degree_spearman", "alignment_metrics.bijective_share", "alignment_reachability.both_in_lcc.share",
)


def comparison(scalars: DataFrame) -> DataFrame:
    """A row per dataset, a column per metric.key, by name."""
    long = scalars.select("dataset", F.concat_ws(".", "metric", "key").alias("name"), "value")
    names = sorted(r.name for r in long.select("name").distinct().collect())
    return long.groupBy("dataset").pivot("name", names).agg(F.first("value"))


def headline(table: DataFrame) -> DataFrame:
    return table.select("dataset", *(F.col(f"`{c}`") for c in HEADLINE if c in table.columns))


def score_matrix(scores: DataFrame) -> DataFrame:
    """A row per dataset, a column per matcher, F1 with 4 digits."""
    return scores.groupBy("dataset").pivot("matcher").agg(F.round(F.first("f1"), 4))


def merge_scores(scores: DataFrame, table: DataFrame) -> DataFrame:
    return scores.join(table, "dataset", "left")


def _long(merged: DataFrame, columns: list[str], target: str, per_matcher: bool) -> DataFrame:
    cell = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns)))
    t = merged.select((F.col("matcher") if per_matcher else F.lit("__all__")).alias("matcher"), F.col(target).cast("double").alias("y"), cell.alias("c")).select("matcher", "c.metric", "c.x", "y")
    return t.where("x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")


def spearman(merged: DataFrame, columns: list[str], target: str = "f1", per_matcher: bool = True) -> DataFrame:
    """(matcher, metric, spearman_rho, n_datasets) of groups with 4 rows and 3 distinct values at least."""
    keys = ["matcher", "metric"]
    t = S.mid_ranks(S.mid_ranks(_long(merged, columns, target, per_matcher), keys, "x", "rx"), keys, "y", "ry")
    t = t.groupBy(*keys).agg(F.round(S.correlation("rx", "ry"), 12).alias("spearman_rho"), F.count("*").alias("n_datasets"), F.countDistinct("x").alias("_d"))
    return t.where("n_datasets >= 4 and _d >= 3 and spearman_rho is not null").drop("_d")


def correlate(merged: DataFrame, columns: list[str], target: str = "f1", per_matcher: bool = True) -> DataFrame:
    """spearman() with p values (from Student's t, on the driver: one row per matcher and metric) and corrections."""
    rows = [(r.matcher, r.metric, r.spearman_rho, S.correlation_p(r.spearman_rho, r.n_datasets), r.n_datasets) for r in spearman(merged, columns, target, per_matcher).collect()]
    found = merged.sparkSession.createDataFrame(rows, "matcher string, metric string, spearman_rho double, p_value double, n_datasets long")
    return adjust_p_values(found.withColumn("abs_rho", F.abs("spearman_rho")))


def adjust_p_values(frame: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg over all rows (a small table: one row per test)."""
    order = [F.col("p_value"), *(F.col(c) for c in ("matcher", "metric") if c in frame.columns)]
    t = frame.withColumns({"n_tests": F.count("*").over(W.partitionBy()), "_r": F.row_number().over(W.orderBy(*order))})
    t = t.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p_value") * F.col("n_tests")))
    down = W.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("p_fdr", F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("n_tests") / F.col("_r")).over(down)))
    return t.withColumns({"survives_bonferroni": F.col("p_bonferroni") <= alpha, "survives_fdr": F.col("p_fdr") <= alpha}).drop("_r")


def top_drivers(correlations: DataFrame, k: int = 8) -> DataFrame:
    """The k metrics of each matcher with the largest absolute correlation."""
    rank = F.row_number().over(W.partitionBy("matcher").orderBy(F.desc("abs_rho"), "metric"))
    return correlations.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def rho_matrix(correlations: DataFrame) -> DataFrame:
    metrics = sorted(r.metric for r in correlations.select("metric").distinct().collect())
    return correlations.groupBy("matcher").pivot("metric", metrics).agg(F.first("spearman_rho"))


#: Dataset names such as EN_FR_15K_V1: pair, scale, density.
FACTORS = r"^([A-Z]+_[A-Z]+)_([0-9]+K)_(V[0-9]+)$"


def annotate(scores: DataFrame) -> DataFrame:
    """Adds pair, scale, density from the dataset's name; other names go."""
    parts = {n: F.regexp_extract("dataset", FACTORS, i) for i, n in enumerate(("pair", "scale", "density"), 1)}
    return scores.where(F.col("dataset").rlike(FACTORS)).withColumns(parts)


def contrast(annotated: DataFrame, factor: str, low: str, high: str) -> DataFrame:
    """Per matcher: mean F1 at both levels, their difference, and pairs of datasets that differ in the factor alone."""
    others = ["matcher", *(f for f in ("pair", "scale", "density") if f != factor)]
    t = annotated.groupBy(*others).pivot(factor, [low, high]).agg(F.first("f1")).where(F.col(low).isNotNull() & F.col(high).isNotNull())
    return t.groupBy("matcher").agg(F.round(F.avg(low), 3).alias("f1_low"), F.round(F.avg(high), 3).alias("f1_high"), F.round(F.avg(F.col(high) - F.col(low)), 3).alias("delta"), F.count("*").alias("n_pairs"))


def f1_by_pair(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy("pair").pivot("matcher").agg(F.round(F.avg("f1"), 3))


def equivalence(one: DataFrame, two: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(metric, value_1, value_2, abs_diff, match) by metric key; a missing second value is no match."""
    t = one.select("metric", F.col("value").alias("value_1")).join(two.select("metric", F.col("value").alias("value_2")), "metric", "left")
    diff = F.abs(F.col("value_1") - F.col("value_2"))
    return t.select("metric", "value_1", "value_2", diff.alias("abs_diff"), F.coalesce(diff <= tolerance * F.greatest(F.lit(1.0), F.abs("value_1")), F.lit(False)).alias("match"))
