"""Entities as numbers: components and degrees of a pair without moving or storing a name; sets of values by entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KGPair
from ..storage import release, stored
from .graph import SMALL, NodesRepeat, component_roots
from .metrics import literal_values


def value_sets(pair: KGPair) -> DataFrame:
    """(kg, entity, n_attr, has): an entity's attribute triples, and its distinct normalised values in order; stored once."""

    def make():
        t = literal_values(pair).repartition("kg", "entity").groupBy("kg", "entity")
        return t.agg(F.count("*").alias("n_attr"), F.sort_array(F.collect_set(F.when(F.col("value") != "", F.col("value")))).alias("has"))

    if "value_sets" not in pair.kept:
        pair.kept["value_sets"] = stored(make(), "value_sets")
        release(pair.rel.sparkSession)
    return pair.kept["value_sets"]


def kept_classes(pair: KGPair, max_df_ratio: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(kg, set, c) and (c, value, df, w): what matching.value_classes() has, by digests of whole sets of values instead of entities.

    Entities with equal sets have equal kept values, so sets are counted first and values are weighed by their counts.
    """

    def found():
        sets = stored(value_sets(pair).where(F.size("has") > 0).groupBy("kg", "has").agg(F.count("*").alias("n")), "sets")
        n = numbers(pair)[0].count()
        top = max(int(max_df_ratio * n), 2)
        df = sets.select(F.explode("has").alias("value"), "n").groupBy("value").agg(F.sum("n").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= top))
        df = stored(df, "frequencies")
        t = sets.select("kg", digest("has").alias("set"), F.explode("has").alias("value")).join(F.broadcast(df) if df.count() <= SMALL else df, "value")
        t = t.withColumn("idf", F.log(F.lit(float(n)) / F.col("df")) + 1).groupBy("kg", "set").agg(F.sort_array(F.collect_list(F.struct("value", "df", "idf"))).alias("kept"))
        return t.withColumn("c", digest("kept.value"))

    classes = pair.once(f"set_classes{max_df_ratio}", found)

    def weighed():
        t = classes.groupBy("c").agg(F.first("kept").alias("kept"))
        norm = F.sqrt(F.aggregate("kept", F.lit(0.0), lambda total, x: total + x["idf"] * x["idf"]))
        t = t.select("c", norm.alias("norm"), F.explode("kept").alias("x"))
        return t.select("c", "x.value", "x.df", (F.col("x.idf") / F.col("norm")).alias("w"))

    return classes.select("kg", "set", "c"), pair.once(f"set_weights{max_df_ratio}", weighed)


def digest(values):
    return F.md5(F.to_json(values))


def number(seed: int, kg, name):
    """A number of an entity: a hash whose last bit tells the graph."""
    return F.shiftleft(F.xxhash64(F.lit(seed), name), 1).bitwiseOR((kg == "kg2").cast("long"))


def numbers(pair: KGPair) -> tuple[DataFrame, int]:
    """(id, root, degree) of every entity: its number(), the least number of its component, its triples' ends; and the seed.

    No name is moved or stored. Numbers are checked by a second hash of the names and seeded anew should two entities meet.
    """
    zero, one, none = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(None).cast("long")

    def make(seed):
        check = lambda kg, c: F.xxhash64(F.lit(seed), F.lit("check"), kg, c)
        kg, head, tail = F.col("kg"), F.coalesce("head", "tail"), F.when(F.col("head").isNotNull(), F.col("tail"))
        ends = lambda a, b, w: [number(seed, kg, a).alias("a"), F.when(b.isNotNull(), number(seed, kg, b)).alias("b"), check(kg, a).alias("ca"), F.when(b.isNotNull(), check(kg, b)).alias("cb"), w.alias("w")]
        said = pair.align.select(F.lit("kg1").alias("kg"), F.col("e1").alias("entity")).union(pair.align.where("e2 <> ''").select(F.lit("kg2"), "e2"))
        lone = value_sets(pair).select("kg", "entity").union(said).where("entity is not null")
        edges = pair.rel.where("head is not null or tail is not null").select("kg", head.alias("head"), tail.alias("tail")).select(*ends(F.col("head"), F.col("tail"), one))
        edges = edges.union(lone.select(number(seed, kg, F.col("entity")), none, check(kg, F.col("entity")), none, zero))
        return component_roots(edges).select(F.col("a").alias("id"), F.col("b").alias("root"), F.col("n").alias("degree"))

    for seed in range(100):
        try:
            if "numbers" not in pair.kept:
                pair.kept["numbers"], pair.meta["seed of numbers"] = stored(make(seed), "numbers"), seed
                release(pair.rel.sparkSession)
            return pair.kept["numbers"], pair.meta["seed of numbers"]
        except NodesRepeat:
            continue
    raise ValueError("nodes repeat")


def largest_roots(pair: KGPair) -> dict[str, int] | None:
    """The root of the largest component of each graph; None where ties or graphs without an edge need names."""
    t = numbers(pair)[0].groupBy("root").agg(F.count("*").alias("n")).groupBy(F.col("root").bitwiseAND(F.lit(1)).alias("side"), "n").agg(F.count("*").alias("k"), F.min("root").alias("root"))
    best = {f"kg{r.side + 1}": r.b for r in t.groupBy("side").agg(F.max(F.struct("n", "k", "root")).alias("b")).collect()}
    if len(best) < 2 or any(b.k > 1 or b.n < 2 for b in best.values()):
        return None
    return {kg: b.root for kg, b in best.items()}
