"""Holistic matching as a fixpoint: equal literals and functional relations raise the probability that entities are equal.

After the published probabilistic alignment of relations, instances and schema (2011): relation functionality, literal
equality as 0 or 1, the noisy-or over shared neighbours, and the estimate of subrelations, alternated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import literals as L
from ..model import KGPair
from ..storage import discard, release
from .graph import checkpointed, node_key
from .matching import Matcher, top_k

#: Statement pairs that are made at once, about: a round goes through entities of the first graph in so many slices.
PRODUCTS = 40_000_000


def dropped(*frames: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for t in frames:
        for place in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            discard(t.sparkSession, place)


def statements(pair: KGPair, hot: int = 50, made: list[DataFrame] | None = None) -> DataFrame:
    """(kg, r, x, y, literal, hot): relations in both directions and attributes (@name); hot: (r, y) has more than `hot` of them.

    Entities are ordinals, relations and values are hashes without collisions, so that no names are moved. The mark chooses
    how equality() joins a statement, not whether it counts. Tables that are stored on the way are added to `made`.
    """
    none = F.lit("").alias("kg")
    back = F.concat("relation", F.lit("^-1"))
    rel = pair.rel.where("relation is not null").withColumns({"none": F.lit(""), "back": back})
    attr = pair.attr.where("attribute is not null").withColumns({"none": F.lit(""), "r": F.concat(F.lit("@"), "attribute")})
    names = rel.select(none, F.col("relation").alias("node")).distinct()
    names = checkpointed(names.union(names.select("kg", F.concat("node", F.lit("^-1")))).union(attr.select(none, "r").distinct()).distinct())
    name = node_key(names)
    entity = node_key(pair.ordinals().select("kg", F.col("entity").alias("node")))
    ids = checkpointed(pair.ordinals().select(entity("kg", "entity").alias("h"), "i"))
    at = lambda t, c: t.join(ids.select(F.col("h").alias(f"h{c}"), F.col("i").alias(c)), f"h{c}", "left").drop(f"h{c}")
    known = checkpointed(pair.attr.select("literal").distinct().withColumn("node", L.normalised(F.col("literal"))).where("node <> ''").withColumn("none", F.lit("")))
    value = node_key(known.select(none, "node").distinct())
    known = known.select(F.col("literal").alias("_l"), value("none", "node").alias("y"))

    rel = rel.select("kg", name("none", "relation").alias("r"), name("none", "back").alias("back"), entity("kg", "head").alias("hx"), entity("kg", "tail").alias("hy")).distinct()
    rel = checkpointed(at(at(rel, "x"), "y"))
    values = attr.select("kg", name("none", "r").alias("r"), entity("kg", "head").alias("hx"), F.col("literal").alias("_l"))
    values = at(values.join(known, "_l").select("kg", "r", "hx", "y").distinct(), "x").select("kg", "r", "x", "y", F.lit(True).alias("literal"))
    out = checkpointed(rel.select("kg", "r", "x", "y", F.lit(False).alias("literal")).union(rel.select("kg", "back", "y", "x", F.lit(False))).union(values))
    if made is not None:
        made += [rel, out]
    common = out.groupBy("kg", "r", "y").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("kg", "r", "y", F.lit(True).alias("hot"))
    return out.join(common, ["kg", "r", "y"], "left").na.fill(False, ["hot"])


def inverse_functionality(facts: DataFrame) -> DataFrame:
    """(kg, r, inv): distinct objects per statement; how well an object tells its subject."""
    return facts.groupBy("kg", "r").agg((F.countDistinct("y") / F.count("*")).alias("inv"))


def mapped(one: DataFrame, equal: DataFrame) -> DataFrame:
    """Statements of the first graph with their object as the second one has it: (..., y2, p); literals stay as they are."""
    nodes = one.where("not literal").join(equal.select(F.col("e1").alias("y"), F.col("e2").alias("y2"), F.col("score").alias("p")), "y")
    cols = [*one.columns, "y2", "p"]
    return one.where("literal").withColumns({"y2": F.col("y"), "p": F.lit(1.0)}).select(*cols).union(nodes.select(*cols))


def sides(one: DataFrame, two: DataFrame, equal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(r1, e1, i1, literal, y2, p) and (r2, e2, i2, literal, y2): statements that meet on literal and y2."""
    return (
        mapped(one, equal).select(F.col("r").alias("r1"), F.col("x").alias("e1"), F.col("inv").alias("i1"), "literal", "y2", "p"),
        two.select(F.col("r").alias("r2"), F.col("x").alias("e2"), F.col("inv").alias("i2"), "literal", F.col("y").alias("y2")),
    )


def misses(met: DataFrame, sub: DataFrame | None, start: float) -> DataFrame:
    """(e1, e2, miss): log of the product of what each statement pair with equal objects leaves open."""
    if sub is None:
        t = met.withColumns({"s12": F.lit(start), "s21": F.lit(start)})
    else:
        t = met.join(sub, ["r1", "r2"])  # without an estimate a pair of relations says nothing
    miss = (1 - F.col("s21") * F.col("i1") * F.col("p")) * (1 - F.col("s12") * F.col("i2") * F.col("p"))
    return t.groupBy("e1", "e2").agg(F.sum(F.log(F.greatest(miss, F.lit(1e-12)))).alias("miss"))


def hot_groups(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kg, x, g) and (kg, r, x = g, y, literal, inv): entities by the set of their hot statements, and those statements.

    A group is named after its least entity.
    """
    said = F.to_json(F.sort_array(F.collect_set(F.struct("r", "literal", "y"))))
    sets = checkpointed(f.where("hot").groupBy("kg", "x").agg(F.sha2(said, 256).alias("set")))
    groups = checkpointed(sets.join(sets.groupBy("kg", "set").agg(F.min("x").alias("g")), ["kg", "set"]).select("kg", "x", "g"))
    dropped(sets)
    of = groups.where("x = g").select("kg", "x")  # one member has all statements of its group
    return groups, checkpointed(f.where("hot").join(of, ["kg", "x"]).select("kg", "r", "x", "y", "literal", "inv").distinct())


def slices(f: DataFrame, shared: DataFrame, equal: DataFrame, products: int) -> int:
    """How many slices of at most about `products` statement pairs a round of equality() takes."""
    total = 0
    for t, both_hot in ((f, 0), (shared.withColumn("hot", F.lit(True)), 1)):
        one, two = (t.where(F.col("kg") == f"kg{i}") for i in (1, 2))
        count = lambda s, i: s.groupBy("literal", "y2").agg(F.count("*").alias(f"n{i}"), F.sum(F.col("hot").cast("long")).alias(f"h{i}"))
        met = count(mapped(one, equal), 1).join(count(two.withColumnRenamed("y", "y2"), 2), ["literal", "y2"])
        pairs = F.col("n1") * F.col("n2") - (0 if both_hot else F.col("h1") * F.col("h2"))
        total += met.agg(F.sum(pairs)).first()[0] or 0
    return 1 + int(total) // products


def equality(f: DataFrame, groups: DataFrame, shared: DataFrame, equal: DataFrame, sub: DataFrame | None, start: float, keep: int, part: tuple[int, int], made: list[DataFrame]) -> DataFrame:
    """(e1, e2, score): the noisy-or over statement pairs whose objects are equal; holds the `keep` best of each e1.

    Statements that are not both hot meet entity by entity. What two hot ones add is looked up for the pairs found so. A
    pair of hot statements alone can be among the best only where all that hot statements could add reaches the last of
    the best found so far; for those e1 alone, entities with the same hot statements form a group, groups meet, and of a
    group's partners only the first `keep` count.

    Of the first graph, part = (i, n) takes the i-th of n slices; entities of a group, which is their `slot`, stay
    together. Tables that are stored on the way are added to `made`.
    """
    def kept(t: DataFrame) -> DataFrame:
        made.append(checkpointed(t))
        return made[-1]

    own = lambda t, c: t.where(F.pmod(F.xxhash64(c), F.lit(part[1])) == part[0])
    side = lambda t, i: t.where(F.col("kg") == f"kg{i}")
    score = lambda miss: F.round(1 - F.exp(miss), 9).alias("score")
    meet = lambda one, two: (lambda a, b: a.join(b, ["literal", "y2"]))(*sides(one, two, equal))
    g1, g2 = (side(groups, i).select(F.col("x").alias(f"e{i}"), F.col("g").alias(f"g{i}")) for i in (1, 2))
    g1 = own(g1, "g1")

    one, two, shared1 = own(side(f, 1), "slot"), side(f, 2), own(side(shared, 1), "x")
    cold = misses(meet(one.where("not hot"), two).union(meet(one.where("hot"), two.where("not hot"))), sub, start)
    cold = kept(cold.join(g1, "e1", "left").join(g2, "e2", "left"))
    a, b = sides(shared1, side(shared, 2), equal)
    looked = cold.select("g1", "g2").where("g1 is not null and g2 is not null").distinct()
    looked = looked.join(a.withColumnRenamed("e1", "g1"), "g1").join(b.withColumnRenamed("e2", "g2"), ["g2", "literal", "y2"])
    more = misses(looked.withColumnsRenamed({"g1": "e1", "g2": "e2"}), sub, start).select(F.col("e1").alias("g1"), F.col("e2").alias("g2"), F.col("miss").alias("more"))
    met = cold.join(more, ["g1", "g2"], "left").select("e1", "e2", score(F.col("miss") + F.coalesce("more", F.lit(0.0))))

    statement = F.struct("r", "literal", "y")
    # what each hot statement could add at most, summed over a group; a little more, as sums differ in their last digits
    hot = shared1.union(side(shared, 2)).select("kg", "r", F.when(F.col("kg") == "kg1", statement).alias("x"), "y", "literal", "inv").distinct()
    most = misses(meet(side(hot, 1), side(hot, 2)), sub, start).select(F.col("e1").alias("s"), F.col("miss").alias("most"))
    most = shared1.select(F.col("x").alias("g1"), statement.alias("s")).join(most, "s").groupBy("g1").agg((F.sum("most") * (1 + 1e-9)).alias("most"))
    last = cold.withColumn("_r", F.row_number().over(W.partitionBy("e1").orderBy("miss"))).where(F.col("_r") == keep).select("e1", score(F.col("miss")).alias("last"))
    need = kept(g1.join(most, "g1").join(last, "e1", "left").where(F.col("last").isNull() | (F.col("last") <= score(F.col("most")))).select("e1", "g1"))
    some = shared1.join(need.select(F.col("g1").alias("x")).distinct(), "x", "left_semi")
    common = misses(meet(some, side(shared, 2)), sub, start).select(F.col("e1").alias("g1"), F.col("e2").alias("g2"), score(F.col("miss")))
    first = g2.withColumn("_r", F.row_number().over(W.partitionBy("g2").orderBy("e2"))).where(F.col("_r") <= keep).drop("_r")
    best = F.row_number().over(W.partitionBy("g1").orderBy(F.desc("score"), "e2"))
    # of a group the best by score and name are in its first groups too, so these are cut before their members are named
    lead = F.rank().over(W.partitionBy("g1").orderBy(F.desc("score")))
    only = common.withColumn("_l", lead).where(F.col("_l") <= keep).drop("_l").join(first, "g2").withColumn("_r", best).where(F.col("_r") <= keep)
    t = met.union(only.join(need, "g1").select("e1", "e2", "score"))
    # a pair in both has its whole score in the first
    return t.groupBy("e1", "e2").agg(F.max("score").alias("score")).where("score > 0")


def comparable(facts: DataFrame) -> DataFrame:
    """Statements whose object can have a counterpart: a literal has one if the other graph holds it."""
    held = facts.where("literal").select(F.when(F.col("kg") == "kg1", "kg2").otherwise("kg1").alias("kg"), "y").distinct()
    return facts.where("not literal").union(facts.where("literal").join(held, ["kg", "y"], "left_semi").select(*facts.columns))


def subrelations(facts: DataFrame, equal: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(r1, r2, s12, s21) from comparable statements: the expected share of each relation's statements with a counterpart that the other one holds.

    A statement counts with the noisy-or over its counterparts, pairs of equal subjects and equal objects: in the share's
    numerator those that the other relation holds, in its denominator all. Between rounds an entity of the first graph has
    one match, so a statement there has one counterpart at most; one of the second graph can have several. Tables that are
    stored on the way are added to `made`.
    """
    one, two = (facts.where(F.col("kg") == f"kg{i}").select("r", "x", "y", "literal") for i in (1, 2))
    subject = equal.select(F.col("e1").alias("x"), F.col("e2").alias("x2"), F.col("score").alias("px"))
    here = checkpointed(mapped(one, equal).join(subject, "x").select(F.col("r").alias("r1"), "literal", "x2", "y2", (F.col("px") * F.col("p")).alias("p")))
    there = two.select(F.col("r").alias("r2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "literal")
    both = checkpointed(here.join(there, ["x2", "y2", "literal"]))
    made += [here, both]
    left = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-12))))
    n12 = both.groupBy("r1", "r2").agg(F.sum("p").alias("n12"))
    n21 = both.groupBy("r1", "r2", "literal", "x2", "y2").agg((1 - F.exp(left)).alias("n")).groupBy("r1", "r2").agg(F.sum("n").alias("n21"))
    d1 = here.groupBy("r1").agg(F.sum("p").alias("d1"))
    d2 = counterparts(there, equal).groupBy("r2").agg(F.sum(1 - F.exp("miss")).alias("d2"))
    return n12.join(n21, ["r1", "r2"]).join(d1, "r1").join(d2, "r2").select("r1", "r2", (F.col("n12") / F.col("d1")).alias("s12"), (F.col("n21") / F.col("d2")).alias("s21"))


def counterparts(there: DataFrame, equal: DataFrame) -> DataFrame:
    """(r2, miss) per statement of the second graph: log of what the pairs of its subject's and object's matches leave open.

    Matches of an entity are folded to (score, how many) first, so that entities with many do not meet match by match.
    """
    def folded(e: str, p: str, n: str) -> DataFrame:
        return equal.groupBy(F.col("e2").alias(e), F.col("score").alias(p)).agg(F.count("*").alias(n))

    objects = there.where("not literal").join(folded("y2", "py", "m"), "y2")
    cols = [*there.columns, "py", "m"]
    objects = objects.select(*cols).union(there.where("literal").withColumns({"py": F.lit(1.0), "m": F.lit(1).cast("long")}).select(*cols))
    t = objects.join(folded("x2", "px", "n"), "x2")
    return t.groupBy("r2", "literal", "x2", "y2").agg(F.sum(F.col("n") * F.col("m") * F.log(F.greatest(1 - F.col("px") * F.col("py"), F.lit(1e-12)))).alias("miss"))


def paris_scores(pair: KGPair, rounds: int = 4, start: float = 0.1, keep: int = 3, hot: int = 50, products: int = PRODUCTS) -> DataFrame:
    """Rounds of equality and subrelation estimates; each entity keeps its few best, and between rounds its best match."""
    spark = pair.rel.sparkSession
    made: list[DataFrame] = []
    facts = checkpointed(statements(pair, hot, made))
    dropped(*made)
    made = [facts]
    # small where there are few relations; stored, so that its size, not a hint, decides whether a join broadcasts it
    facts = checkpointed(facts.join(checkpointed(inverse_functionality(facts)), ["kg", "r"]))
    dropped(*made)
    made = [facts]
    release(spark)
    groups, shared = hot_groups(facts)
    facts = checkpointed(facts.join(groups, ["kg", "x"], "left").withColumn("slot", F.coalesce("g", "x")).drop("g"))
    dropped(*made)
    compared = checkpointed(comparable(facts.select("kg", "r", "x", "y", "literal")))
    equal = spark.createDataFrame([], "e1 long, e2 long, score double")
    sub = None
    for i in range(rounds):
        f = facts if i else facts.where("literal")  # no nodes are equal yet
        n = slices(f, shared, equal, products)
        parts = []
        for part in range(n):
            release(spark)
            made = []
            scores = top_k(equality(f, groups, shared, equal, sub, start, keep, (part, n), made), keep)
            best = F.row_number().over(W.partitionBy("e1").orderBy(F.desc("score"), "e2"))
            parts.append(checkpointed(scores.withColumn("_r", best).where("_r = 1").drop("_r")))
            del scores
            dropped(*made)
        equal = parts[0]
        for t in parts[1:]:
            equal = equal.union(t)
        equal = checkpointed(equal)
        dropped(*parts)
        release(spark)
        if i + 1 < rounds:
            made = []
            sub = checkpointed(subrelations(compared, equal, made))
            dropped(*made)
    left, right = (pair.ordinals().where(F.col("kg") == f"kg{k}").select(F.col("i").alias(f"e{k}"), F.col("entity").alias(f"n{k}")) for k in (1, 2))
    return equal.join(left, "e1", "left").join(right, "e2", "left").select(F.col("n1").alias("e1"), F.col("n2").alias("e2"), "score")


def paris_matcher(min_score: float = 0.1, **options) -> Matcher:
    return Matcher("paris", "holistic", False, lambda p, s: paris_scores(p, **options), lambda t: t.where(F.col("score") >= min_score))
