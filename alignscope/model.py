"""The data model: a pair of knowledge graphs as three long DataFrames, and a gold alignment.

Both graphs live in the same frames, told apart by `kg` (kg1, kg2), so that one job profiles both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import stored

REL = "kg string, head string, relation string, tail string"
ATTR = "kg string, head string, attribute string, literal string"
ALIGN = "e1 string, e2 string, split string"


@dataclass(frozen=True)
class KGPair:
    """rel and attr are lists of triples (repeats count); align has an empty e2 for an entity without a partner."""

    name: str
    rel: DataFrame
    attr: DataFrame
    align: DataFrame
    meta: dict = field(default_factory=dict)
    kept: dict = field(default_factory=dict, compare=False, repr=False)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived frame that several operators read: stored as parquet at its first use."""
        if name not in self.kept:
            self.kept[name] = stored(make(), name)
        return self.kept[name]

    def split(self, name: str | None) -> DataFrame:
        return self.align if name in (None, "all") else self.align.where(F.col("split") == name)

    def matched(self, name: str | None = None) -> DataFrame:
        return self.split(name).where("e2 <> ''")

    def unmatched(self, name: str | None = None) -> DataFrame:
        return self.split(name).where("e2 = ''")

    def gold(self, name: str | None = None) -> DataFrame:
        return self.matched(name).select("e1", "e2").distinct()

    def facts(self) -> DataFrame:
        """(kg, entity, out_degree, in_degree, n_attr) of every entity; one aggregation over all ends, stored once."""
        zero, one = F.lit(0), F.lit(1)
        ends = (
            self.rel.select("kg", F.col("head").alias("entity"), one.alias("o"), zero.alias("i"), zero.alias("a"))
            .union(self.rel.select("kg", "tail", zero, one, zero))
            .union(self.attr.select("kg", "head", zero, zero, one))
            .union(self.align.select(F.lit("kg1"), "e1", zero, zero, zero))
            .union(self.align.where("e2 <> ''").select(F.lit("kg2"), "e2", zero, zero, zero))
        )
        return self.once("facts", lambda: ends.where("entity is not null").groupBy("kg", "entity").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("a").alias("n_attr")))

    def entities(self) -> DataFrame:
        """(kg, entity): everything mentioned as head, tail, attribute head or in the alignment."""
        return self.facts().select("kg", "entity")

    def ordinals(self) -> DataFrame:
        """(kg, entity, i): entities of each graph numbered from 0 by name; ranges are sorted apart, and only their sizes meet."""

        def number():
            t = self.entities().repartitionByRange("kg", "entity").sortWithinPartitions("kg", "entity").withColumn("_part", F.spark_partition_id())
            t = t.withColumn("_at", F.monotonically_increasing_id())
            t = stored(t, "ranges")
            first = t.groupBy("kg", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
            before = F.coalesce(F.sum("n").over(W.partitionBy("kg").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            return t.join(F.broadcast(first.withColumn("before", before)), ["kg", "_part"]).select("kg", "entity", (F.col("before") + F.col("_at") - F.col("_first")).alias("i"))

        return self.once("ordinals", number)

    def degrees(self) -> DataFrame:
        """(kg, entity, out_degree, in_degree, total_degree), zeros included."""
        return self.facts().select("kg", "entity", "out_degree", "in_degree", (F.col("out_degree") + F.col("in_degree")).alias("total_degree"))

    def attribute_counts(self) -> DataFrame:
        return self.facts().where("n_attr > 0").select("kg", "entity", "n_attr")

    def side(self, kg: str) -> tuple[DataFrame, DataFrame]:
        return self.rel.where(F.col("kg") == kg).drop("kg"), self.attr.where(F.col("kg") == kg).drop("kg")

    def with_frames(self, **frames) -> KGPair:
        return KGPair(frames.get("name", self.name), frames.get("rel", self.rel), frames.get("attr", self.attr), frames.get("align", self.align), frames.get("meta", self.meta))
