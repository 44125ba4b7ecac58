"""The profile of a pair: metric groups as DataFrames per graph, and as long scalars (metric, key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import literals as L
from ..functions import stats as S
from ..model import KGPair
from . import graph as G

#: Predicates that state a type.
TYPE_PREDICATES = ("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.wikidata.org/entity/P31", "http://www.wikidata.org/prop/direct/P31", "rdf:type", "type")
DEGREES = ("in_degree", "out_degree", "total_degree")
TAIL_LIMITS = (0, 1, 2, 3, 5, 10, 20, 50)


def basic(pair: KGPair) -> DataFrame:
    """Per graph: sizes and ratios."""
    ents = pair.entities().groupBy("kg").agg(F.count("*").alias("n_entities"))
    rel = pair.rel.groupBy("kg").agg(F.count("*").alias("n_rel_triples"), F.countDistinct("relation").alias("n_relations"))
    attr = pair.attr.groupBy("kg").agg(F.count("*").alias("n_attr_triples"), F.countDistinct("attribute").alias("n_attributes"), F.countDistinct("literal").alias("n_literals"))
    t = ents.join(rel, "kg", "left").join(attr, "kg", "left").na.fill(0)
    return t.select(
        "kg", "n_entities", "n_relations", "n_attributes", "n_literals", "n_rel_triples", "n_attr_triples",
        S.ratio("n_attr_triples", "n_rel_triples").alias("attr_to_rel_ratio"), S.ratio("n_rel_triples", "n_entities").alias("rel_triples_per_entity"), S.ratio("n_attr_triples", "n_entities").alias("attr_triples_per_entity"),
    )


def basic_pair(pair: KGPair) -> DataFrame:
    """One row: alignment size and ratio, totals, and the asymmetry of triples per entity."""
    sides = basic(pair).groupBy().agg(
        F.sum("n_entities").alias("n_entities_total"),
        F.sum(F.col("n_rel_triples") + F.col("n_attr_triples")).alias("n_triples_total"),
        F.min("n_entities").alias("least"),
        S.ratio(F.max("n_rel_triples") - F.min("n_rel_triples"), F.greatest(F.max("n_rel_triples"), F.lit(1))).alias("size_asymmetry"),
    )
    n = pair.gold().agg(F.count("*").alias("n_alignments"))
    return n.crossJoin(sides).select("n_alignments", S.ratio("n_alignments", "least").alias("alignment_ratio"), "n_entities_total", "n_triples_total", "size_asymmetry")


def degree_kinds(pair: KGPair) -> DataFrame:
    """(kg, kind, degree) for in, out and total."""
    return pair.degrees().selectExpr("kg", "stack(3, 'in', in_degree, 'out', out_degree, 'total', total_degree) as (kind, degree)")


def degree_shares(pair: KGPair) -> DataFrame:
    d = F.col("total_degree")
    return pair.degrees().groupBy("kg").agg(*(F.avg((d <= k).cast("double")).alias(a) for k, a in ((0, "share_isolated"), (2, "share_deg_le_2"), (5, "share_deg_le_5"))))


def property_counts(pair: KGPair) -> DataFrame:
    """(kg, kind, property, n, share)."""
    both = pair.rel.select("kg", F.lit("rel").alias("kind"), F.col("relation").alias("property")).union(pair.attr.select("kg", F.lit("attr"), "attribute"))
    counts = both.groupBy("kg", "kind", "property").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("kg", "kind")))


def property_distribution(pair: KGPair) -> DataFrame:
    """Per graph and kind: number of properties, top-10 share, long-tail share, normalised entropy."""
    counts = property_counts(pair)
    keys = ["kg", "kind"]
    n = counts.groupBy(*keys).agg(F.count("*").alias("n_properties"))
    return n.join(S.concentration(counts, keys), keys).join(S.long_tail_share(counts, keys), keys).join(S.entropies(counts, keys), keys)


def long_tail(pair: KGPair) -> DataFrame:
    """(kg, k, share_le_k) of total degrees."""
    shares = pair.degrees().groupBy("kg").agg(*(F.avg((F.col("total_degree") <= k).cast("double")).alias(f"k{k}") for k in TAIL_LIMITS))
    return shares.selectExpr("kg", f"stack({len(TAIL_LIMITS)}, {', '.join(f'{k}, k{k}' for k in TAIL_LIMITS)}) as (k, share_le_k)")


def facts_per_entity(pair: KGPair) -> DataFrame:
    facts = pair.degrees().join(pair.attribute_counts(), ["kg", "entity"], "left").withColumn("facts", F.col("total_degree") + F.coalesce("n_attr", F.lit(0)))
    return facts.groupBy("kg").agg(F.avg("facts").alias("mean_facts_per_entity"), F.avg((F.col("facts") == 0).cast("double")).alias("share_no_information"))


def property_coverage(pair: KGPair) -> DataFrame:
    """(kg, attribute, coverage): share of entities with the attribute."""
    n = pair.entities().groupBy("kg").agg(F.count("*").alias("n_entities"))
    heads = pair.attr.groupBy("kg", "attribute").agg(F.countDistinct("head").alias("heads"))
    return heads.join(F.broadcast(n), "kg").select("kg", "attribute", S.ratio("heads", "n_entities").alias("coverage"))


def attribute_completeness(pair: KGPair) -> DataFrame:
    n = pair.entities().groupBy("kg").agg(F.count("*").alias("n_entities"))
    pairs = pair.attr.groupBy("kg", "head", "attribute").agg(F.count("*").alias("n"))
    heads = pairs.groupBy("kg", "head").agg(F.count("*").alias("attributes"), F.sum("n").alias("triples"))
    per = heads.groupBy("kg").agg(F.count("*").alias("with_attr"), F.sum("attributes").alias("attributes"), F.sum("triples").alias("triples"))
    cover = property_coverage(pair).groupBy("kg").agg(F.avg("coverage").alias("mean_coverage"), F.percentile("coverage", 0.5).alias("median_coverage"), F.max("coverage").alias("max_coverage"), F.count_if(F.col("coverage") > 0.1).alias("n_covering_10pct"))
    t = n.join(per, "kg", "left").join(cover, "kg", "left").na.fill(0)
    return t.select("kg", S.ratio("with_attr", "n_entities").alias("share_entities_with_attribute"), S.ratio("triples", "n_entities").alias("mean_attr_per_entity"), S.ratio("attributes", "n_entities").alias("mean_distinct_attr_per_entity"), "mean_coverage", "median_coverage", "max_coverage", "n_covering_10pct")


def datatype_mix(pair: KGPair) -> DataFrame:
    kind = F.col("datatype")
    share = lambda c, a: F.avg(c.cast("double")).alias(a)
    numeric = kind.isin("numeric", "integer", "double", "float") | kind.contains("nonNegativeInteger")
    return pair.attr.withColumn("datatype", L.datatype(F.col("literal"))).groupBy("kg").agg(
        share(kind.isin("string", "langString"), "share_text"), share(numeric, "share_numeric"), share(F.lower(kind).contains("date"), "share_date"), F.avg(F.length("literal")).alias("mean_literal_length")
    )


def type_counts(pair: KGPair, top: int = 50) -> DataFrame:
    """(kg, type, n), the `top` most frequent of each graph."""
    counts = pair.rel.where(F.col("relation").isin(*TYPE_PREDICATES)).groupBy("kg", F.col("tail").alias("type")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("kg").orderBy(F.desc("n"), "type"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def type_distribution(pair: KGPair) -> DataFrame:
    typed = pair.rel.where(F.col("relation").isin(*TYPE_PREDICATES))
    n = pair.entities().groupBy("kg").agg(F.count("*").alias("n_entities"))
    per = typed.groupBy("kg").agg(F.count("*").alias("n_type_triples"), F.countDistinct("tail").alias("n_distinct_types"), F.countDistinct("head").alias("typed"))
    counts = typed.groupBy("kg", "tail").agg(F.count("*").alias("n"))
    t = n.join(per, "kg", "left").join(S.entropies(counts, ["kg"]), "kg", "left").na.fill(0)
    return t.select("kg", "n_type_triples", "n_distinct_types", S.ratio("typed", "n_entities").alias("share_entities_typed"), F.col("entropy_norm").alias("type_entropy_norm"))


def overlap(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys of (kg, keys, item): sizes, intersection and Jaccard of the distinct items of the two graphs."""
    sides = items.groupBy(*keys, "item").agg(F.max((F.col("kg") == "kg1").cast("int")).alias("a"), F.max((F.col("kg") == "kg2").cast("int")).alias("b"))
    return sides.groupBy(*keys).agg(F.sum("a").alias("n_kg1"), F.sum("b").alias("n_kg2"), F.sum(F.col("a") * F.col("b")).alias("n_shared"), S.ratio(F.sum(F.col("a") * F.col("b")), F.count("*")).alias("jaccard"))


def vocabularies(pair: KGPair) -> DataFrame:
    """(kg, kind, item): relations, attributes, both together, their namespaces, entity namespaces, types."""
    rel, attr = pair.rel.select("kg", F.lit("relation").alias("kind"), F.col("relation").alias("item")).distinct(), pair.attr.select("kg", F.lit("attribute"), F.col("attribute").alias("item")).distinct()
    types = pair.rel.where(F.col("relation").isin(*TYPE_PREDICATES)).select("kg", F.lit("type"), "tail").distinct()
    properties = rel.union(attr).select("kg", F.lit("property").alias("kind"), "item").distinct()
    spaces = properties.select("kg", F.lit("property_namespace"), L.namespace(F.col("item"))).distinct()
    entity = pair.entities().select("kg", F.lit("entity_namespace"), L.namespace(F.col("entity"))).distinct()
    return rel.union(attr).union(properties).union(spaces).union(entity).union(types)


def schema_heterogeneity(pair: KGPair) -> DataFrame:
    """Per kind of name: sizes, shared, Jaccard, and the ratio of the smaller to the larger vocabulary."""
    return overlap(vocabularies(pair), ["kind"]).withColumn("size_ratio", S.ratio(F.least("n_kg1", "n_kg2"), F.greatest("n_kg1", "n_kg2")))


def shared_properties(pair: KGPair, top: int = 50) -> DataFrame:
    """(kind, property): at most `top` shared relations and attributes, by name."""
    v = vocabularies(pair).where("kind in ('relation', 'attribute')").groupBy("kind", F.col("item").alias("property")).agg(F.countDistinct("kg").alias("n")).where("n = 2")
    return v.withColumn("_r", F.row_number().over(W.partitionBy("kind").orderBy("property"))).where(F.col("_r") <= top).select("kind", "property")


# ---------------------------------------------------------------- the alignment


def with_degrees(pair: KGPair, pairs: DataFrame) -> DataFrame:
    """Adds d1, d2 (total degrees) and a1, a2 (attribute counts) to (e1, e2)."""
    facts = pair.degrees().join(pair.attribute_counts(), ["kg", "entity"], "left").select("kg", "entity", F.col("total_degree").alias("d"), F.coalesce("n_attr", F.lit(0)).alias("a"))
    one, two = (facts.where(F.col("kg") == f"kg{i}").select(F.col("entity").alias(f"e{i}"), F.col("d").alias(f"d{i}"), F.col("a").alias(f"a{i}")) for i in (1, 2))
    return pairs.join(one, "e1", "left").join(two, "e2", "left").na.fill(0, ["d1", "d2", "a1", "a2"])


def alignment_metrics(pair: KGPair) -> DataFrame:
    """One row on the gold pairs: coverage, fan-out, bijective share, candidate space, bias of aligned degrees."""
    gold = pair.gold()
    fan = gold.withColumns({"f1": F.count("*").over(W.partitionBy("e1")), "f2": F.count("*").over(W.partitionBy("e2"))})
    n = fan.agg(
        F.count("*").alias("n_alignments"),
        F.countDistinct("e1").alias("aligned_kg1"),
        F.countDistinct("e2").alias("aligned_kg2"),
        F.max("f1").alias("max_fanout_kg1"),
        F.max("f2").alias("max_fanout_kg2"),
        F.avg(((F.col("f1") == 1) & (F.col("f2") == 1)).cast("double")).alias("bijective_share"),
    )
    sizes = pair.degrees().groupBy().agg(
        *(F.count_if(F.col("kg") == f"kg{i}").alias(f"n{i}") for i in (1, 2)), *(F.avg(F.when(F.col("kg") == f"kg{i}", F.col("total_degree"))).alias(f"mean{i}") for i in (1, 2))
    )
    aligned = with_degrees(pair, gold).agg(*(F.avg(f"d{i}").alias(f"aligned_mean_degree_kg{i}") for i in (1, 2)))
    unmatched = pair.unmatched().agg(F.count("*").alias("n_unmatched"))
    t = n.crossJoin(sizes).crossJoin(aligned).crossJoin(unmatched)
    out = ["n_alignments", "n_unmatched", "max_fanout_kg1", "max_fanout_kg2", "bijective_share"]
    more = [S.ratio(f"aligned_kg{i}", f"n{i}").alias(f"coverage_kg{i}") for i in (1, 2)]
    more += [F.log10(F.col("n1").cast("double") * F.col("n2")).alias("candidate_space_log10")]
    more += [F.col(f"aligned_mean_degree_kg{i}") for i in (1, 2)] + [S.ratio(f"aligned_mean_degree_kg{i}", f"mean{i}").alias(f"degree_bias_kg{i}") for i in (1, 2)]
    return t.select(*out, *more)


def alignment_fanout(pair: KGPair) -> DataFrame:
    """(side, fanout, n): how many entities have how many partners."""
    gold = pair.gold()
    one, two = (gold.groupBy(e).agg(F.count("*").alias("fanout")).groupBy("fanout").agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "fanout", "n") for s, e in (("kg1", "e1"), ("kg2", "e2")))
    return one.union(two)


def alignment_splits(pair: KGPair) -> DataFrame:
    return pair.align.groupBy("split").agg(F.count_if(F.col("e2") != "").alias("n_matched"), F.count_if(F.col("e2") == "").alias("n_unmatched"))


def degree_correlation(pair: KGPair) -> DataFrame:
    """One row: Pearson and Spearman of degrees and of attribute counts over gold pairs, mean absolute difference, isolated shares."""
    t = with_degrees(pair, pair.gold())
    for c in ("d1", "d2", "a1", "a2"):
        t = S.mid_ranks(t, [], c, f"r_{c}")
    share = lambda c, a: F.avg(c.cast("double")).alias(a)
    return t.agg(
        S.correlation("d1", "d2").alias("degree_pearson"),
        S.correlation("r_d1", "r_d2").alias("degree_spearman"),
        S.correlation("r_a1", "r_a2").alias("attr_count_spearman"),
        F.avg(F.abs(F.col("d1") - F.col("d2")).cast("double")).alias("mean_abs_degree_diff"),
        share(F.col("d1") == 0, "share_isolated_kg1"),
        share(F.col("d2") == 0, "share_isolated_kg2"),
        share((F.col("a1") == 0) & (F.col("a2") == 0), "share_no_attr_both"),
    )


def alignment_shares(pair: KGPair) -> DataFrame:
    """One row on the gold pairs: shares of ambiguous entities on both sides, of unaligned and of partnerless ones."""
    gold, sizes = pair.gold(), pair.entities().groupBy().agg(*(F.count_if(F.col("kg") == f"kg{i}").alias(f"n{i}") for i in (1, 2)))
    fan = [gold.groupBy(e).agg(F.count("*").alias("f")).agg(F.count("*").alias(f"a{i}"), F.avg((F.col("f") > 1).cast("double")).alias(k)) for i, e, k in ((1, "e1", "ambiguity_1_to_n"), (2, "e2", "ambiguity_n_to_1"))]
    t = sizes.crossJoin(fan[0]).crossJoin(fan[1]).crossJoin(pair.unmatched().agg(F.count("*").alias("lone")))
    return t.select("ambiguity_1_to_n", "ambiguity_n_to_1", *((1 - S.ratio(f"a{i}", f"n{i}")).alias(f"unaligned_share_kg{i}") for i in (1, 2)), S.ratio("lone", "n1").alias("non_match_share_kg1"))


def split_sizes(pair: KGPair) -> DataFrame:
    """(split, n): rows with a partner, repeats included."""
    return pair.matched().groupBy("split").agg(F.count("*").alias("n"))


def aligned_shares(pair: KGPair) -> DataFrame:
    """One row on the gold pairs: how many, and shares with an isolated side, two of them, and a side without attributes."""
    share = lambda c, a: F.avg(c.cast("double")).alias(a)
    d1, d2, a1, a2 = (F.col(c) == 0 for c in ("d1", "d2", "a1", "a2"))
    return with_degrees(pair, pair.gold()).agg(F.count("*").alias("n_pairs_evaluated"), share(d1 | d2, "share_pairs_one_side_isolated"), share(d1 & d2, "share_pairs_both_isolated"), share(a1 | a2, "share_pairs_one_side_no_attr"))


def degree_differences(pair: KGPair) -> DataFrame:
    """The description of absolute degree differences over the gold pairs, one row with a key column."""
    t = with_degrees(pair, pair.gold()).select(F.lit("abs_degree_diff").alias("of"), F.abs(F.col("d1") - F.col("d2")).alias("d"))
    return S.describe(t, ["of"], "d")


def literal_means(pair: KGPair) -> DataFrame:
    """One row: mean Jaccard and containment of the values of all gold pairs, and the share of pairs without a common one."""
    return literal_overlap(pair).agg(F.coalesce(F.avg("literal_jaccard"), F.lit(0.0)).alias("literal_value_jaccard.mean"), F.coalesce(F.avg("literal_containment"), F.lit(0.0)).alias("literal_value_containment.mean"), F.coalesce(F.avg((F.col("literal_jaccard") == 0).cast("double")), F.lit(1.0)).alias("share_pairs_no_shared_literal"))


def property_frequencies(pair: KGPair) -> DataFrame:
    """(kg, kind, statistics): the description of how often properties occur."""
    return S.describe(property_counts(pair), ["kg", "kind"], "n")


def type_overlap(pair: KGPair) -> DataFrame:
    """One row (type_jaccard): of the types that both graphs state; 0 without types."""
    types = pair.rel.where(F.col("relation").isin(*TYPE_PREDICATES)).select("kg", F.lit("type").alias("kind"), F.col("tail").alias("item")).distinct()
    return overlap(types, ["kind"]).agg(F.coalesce(F.max("jaccard"), F.lit(0.0)).alias("type_jaccard"))


def literal_values(pair: KGPair, ascii_only: bool = False) -> DataFrame:
    """(kg, entity, value) of every attribute triple; only literals beyond ASCII are normalised in Python."""
    t = pair.attr.select("kg", F.col("head").alias("entity"), "literal")
    ascii_ = F.coalesce(F.octet_length("literal") == F.length("literal"), F.lit(True))
    folded = lambda t, fold: t.select("kg", "entity", fold(F.col("literal")).alias("value"))
    if ascii_only:
        return folded(t, L.normalised_ascii)
    return folded(t.where(ascii_), L.folded_ascii).union(folded(t.where(~ascii_), L.normalised))


def entity_values(pair: KGPair, ascii_only: bool = False) -> DataFrame:
    """(kg, entity, value): distinct normalised values."""
    return literal_values(pair, ascii_only).where("value <> ''").distinct()


def shared_values(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(e1, e2, n1, n2, shared) for given pairs: a join on (pair, value), never on value alone."""
    one = values.where("kg = 'kg1'").select(F.col("entity").alias("e1"), F.col("value").alias("v"))
    two = values.where("kg = 'kg2'").select(F.col("entity").alias("e2"), F.col("value").alias("v"))
    both = pairs.join(one, "e1").select("e1", "e2", "v", F.lit(1).alias("a"), F.lit(0).alias("b")).union(pairs.join(two, "e2").select("e1", "e2", "v", F.lit(0), F.lit(1)))
    per = both.groupBy("e1", "e2", "v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    per = per.groupBy("e1", "e2").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("b")).alias("shared"))
    return pairs.join(per, ["e1", "e2"], "left").na.fill(0, ["n1", "n2", "shared"])


def literal_overlap(pair: KGPair, ascii_only: bool = False) -> DataFrame:
    """Per gold pair: Jaccard and containment of the value sets (0 where a side has none)."""
    t = shared_values(entity_values(pair, ascii_only), pair.gold())
    some = (F.col("n1") > 0) & (F.col("n2") > 0)
    return t.select("e1", "e2", "shared", F.when(some, F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).otherwise(0.0).alias("literal_jaccard"), F.when(some, F.col("shared") / F.least("n1", "n2")).otherwise(0.0).alias("literal_containment"))


def reachability(pair: KGPair, largest: DataFrame | None = None) -> DataFrame:
    """(criterion, share) over gold pairs: with an edge, in the largest component, and both sides so."""
    largest = G.largest_component(pair) if largest is None else largest
    t = with_degrees(pair, pair.gold())
    for i in (1, 2):
        side = largest.where(F.col("kg") == f"kg{i}").select(F.col("entity").alias(f"e{i}"), F.lit(True).alias(f"l{i}"))
        t = t.join(side, f"e{i}", "left")
    t = t.na.fill(False, ["l1", "l2"])
    edge = [F.col(f"d{i}") > 0 for i in (1, 2)]
    criteria = {"edge_kg1": edge[0], "edge_kg2": edge[1], "lcc_kg1": F.col("l1"), "lcc_kg2": F.col("l2"), "both_with_edge": edge[0] & edge[1], "both_in_lcc": F.col("l1") & F.col("l2")}
    one = t.agg(*(F.avg(c.cast("double")).alias(k) for k, c in criteria.items()))
    return one.selectExpr(f"stack({len(criteria)}, {', '.join(f"'{k}', {k}" for k in criteria)}) as (criterion, share)")


# ---------------------------------------------------------------- as long scalars

METRICS = {
    "basic_stats": [(basic, ["kg"]), (basic_pair, [])],
    "degree_distribution": [(lambda p: S.describe(degree_kinds(p), ["kg", "kind"], "degree"), ["kg", "kind"]), (degree_shares, ["kg"]), (lambda p: S.powerlaw(p.degrees(), ["kg"], "total_degree"), ["kg"])],
    "property_distribution": [(property_distribution, ["kg", "kind"]), (lambda p: property_frequencies(p).withColumn("of", F.lit("freq")), ["kg", "kind", "of"])],
    "connectivity": [(lambda p: G.connectivity(p), ["kg"])],
    "long_tail": [(long_tail, ["kg", "k"]), (facts_per_entity, ["kg"])],
    "attribute_completeness": [(attribute_completeness, ["kg"]), (datatype_mix, ["kg"])],
    "type_distribution": [(type_distribution, ["kg"]), (lambda p: type_overlap(p).withColumn("of", F.lit("pair")), ["of"])],
    "schema_heterogeneity": [(schema_heterogeneity, ["kind"])],
    "aligned_consistency": [(degree_correlation, []), (aligned_shares, []), (degree_differences, ["of"]), (literal_means, [])],
    "alignment_metrics": [(alignment_metrics, []), (alignment_shares, []), (lambda p: split_sizes(p).select(F.concat(F.lit("split."), "split").alias("split"), F.col("n").alias("n_pairs")), ["split"])],
    "alignment_reachability": [(reachability, ["criterion"])],
}
#: Keys over both graphs: the key, how the two values join, and the key of each graph.
PAIRED = {
    "degree_distribution": [("pair.min_median_total_degree", F.min, "total.median"), ("pair.max_share_isolated", F.max, "share_isolated"), ("pair.mean_total_degree", F.avg, "total.mean"), ("pair.mean_degree_gini", F.avg, "total.gini")],
    "property_distribution": [("pair.mean_rel_entropy_norm", F.avg, "rel.entropy_norm")],
    "connectivity": [("pair.min_share_largest_cc", F.min, "share_largest_cc")],
    "attribute_completeness": [("pair.min_share_entities_with_attribute", F.min, "share_entities_with_attribute"), ("pair.mean_attr_per_entity", F.avg, "mean_attr_per_entity"), ("pair.mean_share_literals_text", F.avg, "share_text")],
}


def get_metric(name: str):
    if name not in METRICS:
        raise ValueError(f"Unknown metric {name!r}; known: {sorted(METRICS)}")
    return lambda pair: scalars(pair, name)


def scalars(pair: KGPair, name: str) -> DataFrame:
    """(dataset, metric, key, value): every number of a metric group, keyed by graph, kind and column."""
    out = None
    for make, keys in METRICS[name]:
        df = make(pair)
        columns = [c for c in df.columns if c not in keys]
        long = df.select(*(F.col(k).cast("string") for k in keys), F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns))).alias("x"))
        long = long.select(F.lit(pair.name).alias("dataset"), F.lit(name).alias("metric"), F.concat_ws(".", *keys, "x.c").alias("key"), F.col("x.v").alias("value"))
        out = long if out is None else out.union(long)
    return out.union(pair_scalars(out, name)) if name in PAIRED else out


def pair_scalars(scalars: DataFrame, name: str) -> DataFrame:
    """The keys of a metric group over both graphs, from those of each graph."""
    of = {f"kg{i}.{own}": key for key, _, own in PAIRED[name] for i in (1, 2)}
    known = F.create_map(*(F.lit(x) for k in of.items() for x in k))
    t = scalars.where(F.col("key").isin(*of)).groupBy("dataset", "metric", known[F.col("key")].alias("key")).agg(*(f("value").alias(f"_{n}") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))))
    how = {F.min: "_min", F.max: "_max", F.avg: "_avg"}
    value = F.coalesce(*(F.when(F.col("key") == key, F.col(how[f])) for key, f, _ in PAIRED[name]))
    return t.select("dataset", "metric", "key", value.alias("value"))
