"""Record linkage: token blocking, block cleaning, meta-blocking weights, n-gram cosine, one-to-one mapping.

Parameters follow the published recipe; purging and filtering constants are parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import literals as L
from ..model import KGPair
from .graph import checkpointed
from .matching import Matcher
from .metrics import entity_values


def entity_records(pair: KGPair) -> DataFrame:
    """(kg, entity, text): the sorted distinct values of each entity that has any, joined by spaces."""
    return entity_values(pair).groupBy("kg", "entity").agg(F.concat_ws(" ", F.sort_array(F.collect_list("value"))).alias("text"))


def token_blocks(records: DataFrame) -> DataFrame:
    """(kg, entity, token): tokens that both sides have."""
    t = records.select("kg", "entity", F.explode(F.array_distinct(L.tokens(F.col("text")))).alias("token"))
    both = t.groupBy("token").agg(F.countDistinct("kg").alias("n")).where("n = 2").select("token")
    return t.join(both, "token", "left_semi").select("kg", "entity", "token")


def purging_bound(sizes: DataFrame, smoothing: float = 1.025) -> DataFrame:
    """One row (bound): the most comparisons of a block that purging keeps, from all (size, assigned) of blocks.

    Levels of equal size are dropped from the largest on, as long as that raises assignments per comparison, over all
    blocks left, by the smoothing factor at least; the least level always stays.
    """
    up = W.orderBy("size")
    t = sizes.groupBy("size").agg(F.sum("assigned").alias("a"), F.sum("size").alias("c"))
    t = t.select("size", F.sum("a").over(up).cast("double").alias("a"), F.sum("c").over(up).cast("double").alias("c"))
    t = t.select("size", (F.lag("a").over(up) * F.col("c") < smoothing * F.lag("c").over(up) * F.col("a")).alias("stays"))
    return t.agg(F.coalesce(F.max(F.when(F.col("stays"), F.col("size"))), F.min("size")).alias("bound"))


def clean_blocks(blocks: DataFrame, max_comparisons: int | None = None, keep_ratio: float = 0.8, smoothing: float = 1.025) -> DataFrame:
    """Purges blocks above purging_bound (or a given number of comparisons); each entity then stays in the smallest share of its blocks.

    With a smoothing of 1 blocks go as long as that raises assignments per comparison at all.
    """
    one, two = F.count_if(F.col("kg") == "kg1"), F.count_if(F.col("kg") == "kg2")
    sizes = blocks.groupBy("token").agg((one * two).alias("size"), (one + two).alias("assigned")).where(F.col("size") > 0)
    if max_comparisons is None:
        sizes = sizes.join(F.broadcast(purging_bound(sizes, smoothing)), F.col("size") <= F.col("bound"))
    else:
        sizes = sizes.where(F.col("size") <= max_comparisons)
    t = blocks.join(sizes.select("token", "size"), "token")
    by = W.partitionBy("kg", "entity")
    t = t.withColumns({"_r": F.row_number().over(by.orderBy("size", "token")), "_n": F.count("*").over(by)})
    return t.where(F.col("_r") <= F.ceil(F.col("_n") * keep_ratio)).select("kg", "entity", "token")


def meta_blocking(blocks: DataFrame) -> DataFrame:
    """(e1, e2, weight): Jaccard of block sets times how rare both nodes' edges are (EJS); edges at or above the mean stay."""
    one, two = (blocks.where(F.col("kg") == f"kg{i}").select("token", F.col("entity").alias(f"e{i}")) for i in (1, 2))
    n1, n2 = (b.groupBy(f"e{i}").agg(F.count("*").alias(f"n{i}")) for i, b in ((1, one), (2, two)))
    # the pairs of a block are made once; everything after reads the stored edges
    edges = checkpointed(one.join(two, "token").groupBy("e1", "e2").agg(F.count("*").alias("common")))
    degrees = [edges.groupBy(f"e{i}").agg(F.count("*").alias(f"d{i}")) for i in (1, 2)]
    t = edges.join(n1, "e1").join(n2, "e2").join(degrees[0], "e1").join(degrees[1], "e2")
    total = edges.groupBy().agg(F.count("*").alias("total"))
    w = F.col("common") / (F.col("n1") + F.col("n2") - F.col("common")) * F.log10(F.col("total") / F.col("d1")) * F.log10(F.col("total") / F.col("d2"))
    weighted = checkpointed(t.crossJoin(F.broadcast(total)).select("e1", "e2", F.round(w, 9).alias("weight")))
    mean = weighted.groupBy().agg(F.round(F.avg("weight"), 9).alias("mean"))
    return weighted.crossJoin(F.broadcast(mean)).where("weight >= mean").select("e1", "e2", "weight")


def ngram_cosine(records: DataFrame, edges: DataFrame, n: int = 3) -> DataFrame:
    """(e1, e2, score): cosine of the n-gram sets of both texts, for given edges."""
    grams = records.select("kg", "entity", F.array_distinct(L.char_ngrams(F.col("text"), n)).alias("g"))
    one, two = (grams.where(F.col("kg") == f"kg{i}").select(F.col("entity").alias(f"e{i}"), F.col("g").alias(f"g{i}")) for i in (1, 2))
    common = F.size(F.array_intersect("g1", "g2"))
    return edges.join(one, "e1").join(two, "e2").select("e1", "e2", F.round(common / F.sqrt(F.size("g1").cast("double") * F.size("g2")), 9).alias("score"))


def candidate_graph(pair: KGPair, n: int = 3, max_comparisons: int | None = None, keep_ratio: float = 0.8, smoothing: float = 1.025) -> DataFrame:
    """What a sweep over thresholds computes once."""
    records = checkpointed(entity_records(pair))
    return ngram_cosine(records, meta_blocking(clean_blocks(token_blocks(records), max_comparisons, keep_ratio, smoothing)), n)


def unique_mapping(scores: DataFrame, threshold: float) -> DataFrame:
    """Greedy one-to-one mapping by descending score: rounds of pairs that are the best of both sides.

    With a total order (score, e1, e2) this equals taking pairs one by one. Every round takes a pair at least, so rounds
    end; a chain of falling scores takes as many rounds as half its length.
    """
    left = checkpointed(scores.where(F.col("score") >= threshold).select("e1", "e2", "score"))
    order = [F.desc("score"), "e1", "e2"]
    done = None
    while True:
        t = left.withColumns({"_a": F.row_number().over(W.partitionBy("e1").orderBy(*order)), "_b": F.row_number().over(W.partitionBy("e2").orderBy(*order))})
        best = checkpointed(t.where("_a = 1 and _b = 1").select("e1", "e2", "score"))
        if best.limit(1).count() == 0:
            break
        done = best if done is None else done.union(best)
        left = checkpointed(left.join(best.select("e1"), "e1", "left_anti").join(best.select("e2"), "e2", "left_anti"))
    return left if done is None else done


def unique_class_mapping(scores: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """unique_mapping() of the pairs of members, from (c1, c2, score) and (kg, entity, c, r) with r the place in the class by name.

    Members of a class are taken in order of names, so a class is known by how many are taken. Where two classes are best
    for each other by their next members, all pairs of next members are taken up to the first name at which another class
    of the same score would come before.
    """
    sides = [members.where(F.col("kg") == f"kg{i}").select(F.col("c").alias(f"c{i}"), F.col("entity").alias(f"h{i}"), F.col("r").alias(f"r{i}")) for i in (1, 2)]
    left = checkpointed(scores.where(F.col("score") >= threshold).select("c1", "c2", "score"))
    done = None
    while True:
        t = left
        for i, side in enumerate(sides, 1):
            taken = left.select(f"c{i}").distinct().withColumn(f"o{i}", F.lit(0)) if done is None else done.groupBy(f"c{i}").agg(F.sum("n").alias(f"o{i}"))
            after = side.join(taken, f"c{i}", "left").where(F.col(f"r{i}") == F.coalesce(f"o{i}", F.lit(0)) + 1)
            t = t.join(after.drop(f"o{i}"), f"c{i}")
        t = checkpointed(t)
        order = {i: W.partitionBy(f"c{i}").orderBy(F.desc("score"), f"h{3 - i}") for i in (1, 2)}
        # the next class of the same score, by the name of its next member
        rival = {i: F.when(F.lead("score").over(order[i]) == F.col("score"), F.lead(f"h{3 - i}").over(order[i])) for i in (1, 2)}
        best = t.withColumns({"_a": F.row_number().over(order[1]), "_b": F.row_number().over(order[2]), "x2": rival[1], "x1": rival[2]}).where("_a = 1 and _b = 1").drop("_a", "_b")
        for i, side in enumerate(sides, 1):
            before = side.select(f"c{i}", F.col(f"h{i}").alias("_h"), F.col(f"r{i}").alias("_r")).join(best.select(f"c{i}", f"x{i}"), f"c{i}").where(F.col(f"x{i}").isNull() | (F.col("_h") < F.col(f"x{i}")))
            best = best.join(before.groupBy(f"c{i}").agg(F.max("_r").alias(f"m{i}")), f"c{i}")
        best = checkpointed(best.select("c1", "c2", "score", "r1", "r2", (F.least(F.col("m1") - F.col("r1"), F.col("m2") - F.col("r2")) + 1).alias("n")))
        if best.limit(1).count() == 0:
            break
        done = best if done is None else done.union(best)
        left = t.select("c1", "c2", "score")
    if done is None:
        done = best
    one = sides[0].join(done.withColumnRenamed("r1", "_o"), "c1").where("r1 >= _o and r1 < _o + n").select(F.col("h1").alias("e1"), "c2", (F.col("r2") + F.col("r1") - F.col("_o")).alias("r2"), "score")
    return one.join(sides[1], ["c2", "r2"]).select("e1", F.col("h2").alias("e2"), "score")


def ngram_matcher(similarity_threshold: float = 0.2, **options) -> Matcher:
    return Matcher("ngram_blocking", "value", False, lambda p, s: candidate_graph(p, **options), lambda t: unique_mapping(t, similarity_threshold))
