"""Products whose best entries are made in the tasks, against all products; and what they are made for."""

import numpy as np
import pytest

from alignscope.model import KGPair
from alignscope.operators import matching, product


def _long(matrix):
    return [(int(i), [int(j) for j in np.flatnonzero(row)], [float(v) for v in row[np.flatnonzero(row)]]) for i, row in enumerate(matrix) if row.any()]


@pytest.mark.parametrize("products, entries, most", [(10**9, 10**9, 10**9), (3000, 60, 400)])
def test_best_products_of_tiles(spark, monkeypatch, products, entries, most):
    """Some ids are met often, so that totals are dense, and scores repeat, so that ties go by id."""
    rng = np.random.default_rng(5)
    a = rng.integers(1, 3, (60, 40)) * (rng.random((60, 40)) < np.linspace(0.02, 0.9, 60)[:, None]) / 4
    b = rng.integers(1, 3, (40, 900)) * (rng.random((40, 900)) < np.linspace(0.01, 0.6, 40)[:, None]) / 4
    left = spark.createDataFrame(_long(a), "x long, keys array<long>, vals array<double>")
    rows = [(k, p, [j for j in ids if j // 300 == p], [v for j, v in zip(ids, vals, strict=True) if j // 300 == p]) for k, ids, vals in _long(b) for p in range(3)]
    right = spark.createDataFrame([r for r in rows if r[2]], "key long, part long, ids array<long>, vals array<double>")
    monkeypatch.setattr(product, "_AT_ONCE", 2000)
    got = {(r.e1, r.e2): r.score for r in product.best_products(left, right, 3, products, entries, most).collect()}
    total, want = a @ b, {}
    for i, row in enumerate(total):
        want |= {(i, int(j)): row[j] for j in np.lexsort((np.arange(900), -np.round(row, 9)))[:3] if row[j] > 0}
    assert got == pytest.approx(want, abs=1e-9) and len(want) > 150


def _hub(spark, n):
    """n children at one hub in each graph, and a friend of each child; the hub and the first 20 friends are seeded."""
    rel = [(kg, f"{kg}/{i:05d}", r, t) for kg in ("kg1", "kg2") for i in range(n) for r, t in (("in", f"{kg}/hub"), ("knows", f"{kg}/friend{i:05d}"))]
    seeds = [("kg1/hub", "kg2/hub")] + [(f"kg1/friend{i:05d}", f"kg2/friend{i:05d}") for i in range(20)]
    align = spark.createDataFrame([(a, b, "train") for a, b in seeds], "e1 string, e2 string, split string")
    pair = KGPair("hub", spark.createDataFrame(rel, "kg string, head string, relation string, tail string"), spark.createDataFrame([], "kg string, head string, attribute string, literal string"), align)
    return pair, align.select("e1", "e2")


def test_pairs_at_a_hub_are_not_moved(spark):
    """4,000 x 4,000 pairs meet at the hub: 16 million, of which no stage may write more than the best."""
    pair, seeds = _hub(spark, 4000)
    rows = matching.structural_round(pair, seeds, keep=3).collect()
    best = {}
    for r in rows:
        best.setdefault(r.e1, []).append((-r.score, r.e2))
    children = [e for e in best if e[4:].isdigit()]
    assert len(children) == 4000 and all(len(best[e]) == 3 for e in children)
    for i in (0, 7, 19):
        assert sorted(best[f"kg1/{i:05d}"])[0][1] == f"kg2/{i:05d}"
    assert [e2 for _, e2 in sorted(best["kg1/03999"])] == ["kg2/00000", "kg2/00001", "kg2/00002"]


def test_later_rounds_score_only_neighbours_of_new_seeds(spark):
    pair, seeds = _hub(spark, 30)
    numbers, named = matching._as_ordinals(pair, seeds)
    aligned = matching.align_relations(matching.numbered(pair), numbers)
    new = numbers.orderBy("e1").limit(1)  # the first friend in the order of names
    some = {r.e1 for r in named(matching.propagate(pair, numbers, aligned, new=new)).collect()}
    every = {r.e1: r.score for r in named(matching.propagate(pair, numbers, aligned)).collect()}
    assert some == {"kg1/00000"} and some < set(every)
