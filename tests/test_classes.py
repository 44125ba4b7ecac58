"""Scores between classes of entities with equal values, against all pairs in Python."""

import math
import random
from collections import defaultdict

import pytest

from alignscope.model import ALIGN, ATTR, REL, KGPair
from alignscope.operators import linkage, matching

RATIO = 0.2


def make(spark, name, attr):
    return KGPair(name, spark.createDataFrame([], REL), spark.createDataFrame([(kg, e, "p", f'"{v}"') for kg, e, v in attr], ATTR), spark.createDataFrame([], ALIGN))


def brute(attr):
    """{(e1, e2): score} of all pairs."""
    has, df = defaultdict(set), defaultdict(int)
    for kg, e, v in attr:
        has[kg, e].add(v)
    for vs in has.values():
        for v in vs:
            df[v] += 1
    idf = {v: math.log(len(has) / n) + 1 for v, n in df.items() if 2 <= n <= max(int(RATIO * len(has)), 2)}
    rows = {k: {v: idf[v] for v in vs if v in idf} for k, vs in has.items()}
    unit = {k: {v: x / math.sqrt(sum(y * y for y in r.values())) for v, x in r.items()} for k, r in rows.items()}
    pairs = ((a, b, sum(x * unit[b].get(v, 0) for v, x in unit[a].items())) for a in unit for b in unit if a[0] == "kg1" and b[0] == "kg2" and unit[a].keys() & unit[b].keys())
    return {(a[1], b[1]): round(s, 9) for a, b, s in pairs}


@pytest.fixture(scope="module")
def some(spark):
    """Entities of one to three values of a few, so that many are equal and scores tie; names of classes interleave."""
    rng = random.Random(5)
    attr = [(kg, f"{kg}e{rng.randrange(10**6):06}", {f"v{min(int(rng.expovariate(0.15)), 14)}" for _ in range(rng.randrange(1, 4))}) for kg in ("kg1", "kg2") for _ in range(120)]
    attr = [(kg, e, v) for kg, e, vs in attr for v in sorted(vs)]
    return make(spark, "some", attr), brute(attr)


def rows(df):
    return {(r.e1, r.e2): r.score for r in df.collect()}


def ordered(scores):
    by = defaultdict(list)
    for (a, b), s in scores.items():
        by[a].append((-s, b))
    return {a: sorted(x) for a, x in by.items()}


def test_best_of_classes_are_best_of_all_pairs(some):
    pair, every = some
    assert len({s for s in every.values()}) < len(every) / 5  # ties
    for k, least in ((1, 0.4), (2, 0.0), (5, 0.0)):
        want = {(a, b): -s for a, x in ordered(every).items() for s, b in x[:k] if -s >= least}
        got = matching.best_value_scores(pair, k, least, RATIO)
        assert rows(got) == pytest.approx(want, abs=1e-8) and got.count() == len(want)


def test_copies_are_one_class(spark):
    n = 3000  # nine million pairs
    attr = [(kg, f"{kg}e{i:04}", "twice" if i < 2 else "common") for kg in ("kg1", "kg2") for i in range(n)]
    pair = make(spark, "copies", attr)
    scores = matching.class_scores(pair, 1.0)
    assert scores.count() == 2
    best = rows(matching.value_overlap(max_df_ratio=1.0).match(pair))
    assert len(best) == n and best["kg1e2999", "kg2e0002"] == 1 and best["kg1e0001", "kg2e0000"] == 1


def test_normalised_scores_of_all_pairs(some):
    pair, every = some
    top = {a: -x[0][0] for a, x in ordered(every).items()}
    got = matching.normalised_value_scores(pair, RATIO)
    # nothing is exchanged once pairs of members are made
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.lstrip().startswith("Project") and "Window" not in plan.split("Generate")[0]
    assert rows(got) == pytest.approx({(a, b): s / top[a] for (a, b), s in every.items()}, abs=1e-7) and got.count() == len(every)


def greedy(scores, threshold):
    used, out = set(), {}
    for (a, b), s in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        if s >= threshold and (1, a) not in used and (2, b) not in used:
            used |= {(1, a), (2, b)}
            out[a, b] = s
    return out


def test_mapping_of_classes_is_that_of_all_pairs(spark, some):
    pair, every = some
    got = linkage.unique_class_mapping(matching.class_scores(pair, RATIO), matching.value_classes(pair, RATIO)[0], 0.2)
    assert rows(got) == pytest.approx(greedy(every, 0.2), abs=1e-8)
    # scores of few levels, names of all classes mixed
    rng = random.Random(9)
    members = [(f"kg{i}", f"x{n:04}", f"{i}c{rng.randrange(12)}") for i in (1, 2) for n in rng.sample(range(9000), 150)]
    place = defaultdict(int)
    for k, m in enumerate(sorted(members)):
        place[m[0], m[2]] += 1
        members[k] = (*m, place[m[0], m[2]])
    scores = {(f"1c{i}", f"2c{j}"): rng.randrange(4) / 3 for i in range(12) for j in range(12) if rng.random() < 0.6}
    pairs = {(a[1], b[1]): scores[a[2], b[2]] for a in members for b in members if a[0] == "kg1" and b[0] == "kg2" and (a[2], b[2]) in scores}
    got = linkage.unique_class_mapping(spark.createDataFrame([(*k, s) for k, s in scores.items()], "c1 string, c2 string, score double"), spark.createDataFrame(members, "kg string, entity string, c string, r int"), 0.3)
    assert rows(got) == greedy(pairs, 0.3)
    assert linkage.unique_class_mapping(matching.class_scores(pair, RATIO), matching.value_classes(pair, RATIO)[0], 2.0).count() == 0
