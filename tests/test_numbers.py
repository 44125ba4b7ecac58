"""Components and degrees by number, sets of values, and what is made from them, beside the frames by name."""

import random

import pytest

from alignscope.functions import literals as L
from alignscope.model import ALIGN, ATTR, REL, KGPair
from alignscope.operators import errors, graph, keys, matching, metrics, numbered
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def made(spark, seed=1, loops=True):
    rng = random.Random(seed)
    rel = [(kg, f"{kg[-1]}{rng.randrange(120)}", "r", f"{kg[-1]}{rng.randrange(120)}") for kg in ("kg1", "kg2") for _ in range(90)]
    rel += [("kg1", "1x", "r", "1x"), ("kg1", None, "r", "1y"), ("kg2", "2z", "r", None), ("kg2", None, "r", None)] if loops else []
    attr = [(kg, f"{kg[-1]}{rng.randrange(150)}", "p", f'"v{rng.randrange(30)}"') for kg in ("kg1", "kg2") for _ in range(200)]
    attr += [("kg1", "1n", "p", '""'), ("kg2", "2n", "p", '"Ünï  Côde"@en'), ("kg1", "1n", "p", '"uni code"'), ("kg1", "1m", "p", '"uni code"')]
    align = [(f"1{i}", f"2{i}" if i % 7 else "", ("train", "test")[i % 2]) for i in range(160)] + [("1n", "2n", "test"), ("1only", "2only", "test")]
    return KGPair("made", spark.createDataFrame(rel, REL).repartition(3), spark.createDataFrame(attr, ATTR), spark.createDataFrame(align, ALIGN))


def test_numbers_are_those_of_names(spark):
    pair = made(spark)
    table, seed = numbered.numbers(pair)
    named = pair.entities().withColumn("id", numbered.number(seed, F.col("kg"), F.col("entity")))
    got = {(r.kg, r.entity): (r.root, r.degree) for r in named.join(table, "id").collect()}
    assert table.count() == len(got)
    assert {k: v[1] for k, v in got.items()} == {(r.kg, r.entity): r.total_degree for r in pair.degrees().collect()}
    want = {(r.kg, r.node): r.component for r in graph.pair_components(pair).collect()}
    assert len({(got[k][0], want[k]) for k in got}) == len({v[0] for v in got.values()}) == len(set(want.values())) and set(got) == set(want)


def test_roots_in_rounds(spark):
    pair = made(spark, 2)
    zero = F.lit(0).cast("long")
    e = pair.rel.where("head <> tail").select(F.xxhash64("kg", "head").alias("a"), F.xxhash64("kg", "tail").alias("b"), zero.alias("ca"), zero.alias("cb"), F.lit(1).cast("long").alias("w"))
    one, many = ({(r.a, r.b, r.n) for r in graph.component_roots(e.repartition(40), one_task=k).collect()} for k in (10**6, -1))
    assert one == many and len(one) > 80
    with pytest.raises(RuntimeError):
        graph.component_roots(e.repartition(40), max_rounds=1, one_task=-1)


def test_two_nodes_of_one_number_are_seen(spark):
    rows = [(1, 2, 10, 20, 1), (3, 1, 30, 11, 1)]  # 1 comes as 10 and as 11
    for parts in (1, 2):
        with pytest.raises(graph.NodesRepeat):
            graph.component_roots(spark.createDataFrame(rows, "a long, b long, ca long, cb long, w long").repartition(parts))


def test_ascii_is_folded_as_in_python(spark):
    texts = ['" A\x1c\x1d b\t\n"', '"  "', '"x"@en', "plain  Text ", '"a\x0b\x0cB\x1f"', '"q\\"\\n r"', ""]
    t = spark.createDataFrame([(x,) for x in texts], "raw string").select(L.normalised(F.col("raw")), L.folded_ascii(F.col("raw")))
    assert all(a == b for a, b in t.collect())


@pytest.mark.parametrize("ratio", [0.01, 0.2])
def test_matches_of_some_are_those_of_all(spark, ratio):
    pair = made(spark, 3)
    every = {r[:2]: r[2] for r in map(tuple, matching.value_overlap(0.4, ratio).match(pair).collect())}
    some = {r.e1 for r in pair.split("test").collect()}
    found = errors.features(pair)
    got = {r[:2]: r[2] for r in map(tuple, matching.value_matches(pair, found.select("e1", "set"), 0.4, ratio).collect())}
    assert got == {k: v for k, v in every.items() if k[0] in some} and (ratio < 0.1 or len(got) > 10)


def test_features_without_names_of_all_entities(spark):
    pair = made(spark, 4)
    largest = graph.largest_component(pair)
    want = {tuple(r) for r in errors.features(made(spark, 4), largest=largest).collect()}
    assert {tuple(r) for r in errors.features(pair).collect()} == want and len(want) > 50


def test_error_queries_make_no_frame_of_all_names(spark, monkeypatch):
    from alignscope.queries import base, registry  # noqa: F401

    def never(*_, **__):
        raise AssertionError("all names are moved")

    monkeypatch.setattr(base, "_loaded", {})
    for owner, name in ((KGPair, "facts"), (graph, "connected_components"), (graph, "triangles"), (metrics, "entity_values")):
        monkeypatch.setattr(owner, name, never)
    for name in ("error_examples", "error_classes", "error_summary", "solvability", "error_families", "mean_shares", "headline", "pair_scalars"):
        assert base.QUERIES[name](spark, SF).count() > 0
    assert not any(set(t.columns) >= {"head", "tail"} for p in base._loaded.values() for t in p.kept.values())


def test_keys_are_those_of_all_scalars(spark):
    pair = made(spark, 5)
    got = {(r.metric, r.key): r.value for r in keys.headline_scalars(pair).collect()} | {(r.metric, r.key): r.value for r in keys.paired_scalars(pair, metrics.PAIRED).collect()}
    every = {}
    for name in {m for m, _ in got}:
        every |= {(r.metric, r.key): r.value for r in metrics.scalars(pair, name).collect()}
    assert {k: pytest.approx(every[k]) for k in got} == got and len(got) > 25
