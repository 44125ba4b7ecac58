"""Statistics as aggregations. Distributions are compressed to (value, count) first, so windows run over distinct values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b as double, 0 where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def compressed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per keys: n, mean, median, std (population), min, max, p25, p75, p95, p99, skew, kurtosis (bias-corrected), gini."""
    by, up = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    t = compressed(df, keys, value)
    t = t.withColumns({"_m": F.sum(F.col("v") * F.col("c")).over(by) / F.sum("c").over(by), "_b": F.coalesce(F.sum("c").over(up), F.lit(0))})
    d = F.col("v") - F.col("_m")
    t = t.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.first("_m").alias("mean"),
        F.percentile("v", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75, 0.95, 0.99))), F.col("c")).alias("_p"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        *((F.sum(F.pow(d, k) * F.col("c")) / F.sum("c")).alias(f"_m{k}") for k in (2, 3, 4)),
        F.sum("v").alias("_unused"),
        F.sum(F.col("v") * F.col("c")).alias("_total"),
        F.sum(F.col("v") * (F.col("c") * F.col("_b") + F.col("c") * (F.col("c") + 1) / 2)).alias("_ranked"),
    )
    n = F.col("n").cast("double")
    g1 = F.col("_m3") / F.pow("_m2", F.lit(1.5))
    g2 = F.col("_m4") / F.pow("_m2", F.lit(2.0)) - 3
    flat = F.col("_m2") <= 1e-18
    return t.select(
        *keys,
        "n",
        "mean",
        F.col("_p")[1].alias("median"),
        F.sqrt("_m2").alias("std"),
        "min",
        "max",
        F.col("_p")[0].alias("p25"),
        F.col("_p")[2].alias("p75"),
        F.col("_p")[3].alias("p95"),
        F.col("_p")[4].alias("p99"),
        F.when(flat | (n <= 2), 0.0).otherwise(g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).alias("skew"),
        F.when(flat | (n <= 3), 0.0).otherwise((n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        F.when(F.col("_total") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 2 * F.col("_ranked") / (n * F.col("_total")) - (n + 1) / n)).alias("gini"),
    )


def entropies(counts: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Per keys of a table of counts: entropy in bits over positive counts, and normalised by log2 of their number."""
    total = F.sum(count).over(W.partitionBy(*keys))
    p = F.col("_p")
    t = counts.where(F.col(count) > 0).withColumn("_p", F.col(count) / total)
    h = -F.sum(p * F.log2(p))
    return t.groupBy(*keys).agg(h.alias("entropy"), F.when(F.count("*") > 1, h / F.log2(F.count("*").cast("double"))).otherwise(0.0).alias("entropy_norm"))


def concentration(counts: DataFrame, keys: list[str], count: str = "n", k: int = 10) -> DataFrame:
    """Per keys: share of the k largest counts (ties do not matter to the sum)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(count)))
    t = counts.withColumn("_r", rank)
    return t.groupBy(*keys).agg(ratio(F.sum(F.when(F.col("_r") <= k, F.col(count)).otherwise(0)), F.sum(count)).alias("top_share"))


def long_tail_share(counts: DataFrame, keys: list[str], count: str = "n", percent: int = 1) -> DataFrame:
    """Per keys: share of items with less than `percent` % of all, in whole numbers."""
    total = F.sum(count).over(W.partitionBy(*keys))
    return counts.withColumn("_t", 100 * F.col(count) < percent * total).groupBy(*keys).agg(F.avg(F.col("_t").cast("double")).alias("long_tail_share"))


def powerlaw(df: DataFrame, keys: list[str], value: str, xmin: float = 1.0, least: int = 50) -> DataFrame:
    """Per keys: alpha of the tail from xmin (maximum likelihood), null where the tail has fewer than `least` values."""
    tail = F.when(F.col(value) >= xmin, F.log(F.col(value) / (xmin - 0.5)))
    return df.groupBy(*keys).agg(F.when(F.count(tail) >= least, 1 + F.count(tail) / F.sum(tail)).alias("alpha"), F.lit(xmin).alias("xmin"))


def log_edges(top: float, bins: int = 20) -> list[float]:
    """Edges of the histogram: rounded log-spaced points without repeats, and one past the last."""
    hi = math.log10(max(top, 2))
    edges = sorted({float(round(10 ** (hi * i / (bins - 1)))) for i in range(bins)})
    return [*edges, edges[-1] + 1]


def log_histogram(df: DataFrame, keys: list[str], value: str, bins: int = 20) -> DataFrame:
    """(keys, bin_lower, bin_upper, count): zero has a bin of its own; bins are half open, the last closed; empty ones go.

    The driver sees one maximum per key.
    """
    counts = compressed(df, keys, value)
    tops = counts.groupBy(*keys).agg(F.max("v").alias("top"))
    edges = df.sparkSession.createDataFrame(
        [(*(r[k] for k in keys), lo, hi, i == n - 1) for r in tops.collect() for e in [log_edges(r.top, bins)] for n in [len(e) - 1] for i, (lo, hi) in enumerate(zip(e, e[1:], strict=False))],
        ", ".join(f"{k} string" for k in keys) + ", bin_lower double, bin_upper double, last boolean",
    )
    zero = counts.where("v = 0").select(*keys, F.lit(0.0).alias("bin_lower"), F.lit(0.0).alias("bin_upper"), F.col("c").alias("count"))
    inside = (F.col("v") >= F.col("bin_lower")) & ((F.col("v") < F.col("bin_upper")) | F.col("last") & (F.col("v") == F.col("bin_upper")))
    rest = counts.where("v > 0").join(F.broadcast(edges), keys).where(inside).groupBy(*keys, "bin_lower", "bin_upper").agg(F.sum("c").alias("count"))
    return zero.union(rest)


def correlation(a: str, b: str) -> Column:
    """Pearson, null where a side is constant or there are fewer than 3 rows."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.when(F.count("*") >= 3, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def mid_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds tie-averaged ranks, from windows over distinct values joined back."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    up = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranks = counts.withColumn(out, F.coalesce(F.sum("_c").over(up), F.lit(0)) + (F.col("_c") + 1) / 2).drop("_c")
    return df.join(ranks, [*keys, value])


# ---------------------------------------------------------------- p-values, on the driver for small results


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(rho: float | None, n: int) -> float | None:
    """Two-sided p of a correlation under Student's t with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))
