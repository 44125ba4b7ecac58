"""The fixpoint matcher moves numbers, goes through a graph in slices, and keeps no table that it has read."""

import os

from alignscope.model import ALIGN, ATTR, REL, KGPair
from alignscope.operators import paris


def test_fixpoint_in_slices_leaves_no_tables(spark, monkeypatch):
    rel, attr = [], []
    for kg, e in (("kg1", "a"), ("kg2", "b")):
        rel += [(kg, f"{e}{i:02}", "by", f"{e}{(i * 5 + 1) % 12:02}") for i in range(12)] + [(kg, f"{e}{i:02}", "in", f"{e}n{i % 2}") for i in range(12)]
        attr += [(kg, f"{e}{i:02}", "is", f'"kind {i % 2}"') for i in range(12)] + [(kg, f"{e}{i:02}", "name", f'"x{i % 7}"') for i in range(12)] + [(kg, f"{e}n{i}", "name", f'"place {i}"') for i in (0, 1)]
    pair = KGPair("slices", spark.createDataFrame(rel, REL), spark.createDataFrame(attr, ATTR), spark.createDataFrame([], ALIGN))
    assert [t for c, t in paris.statements(pair).dtypes if c in "rxy"] == ["bigint"] * 3

    shared = spark.conf.get("spark.checkpoint.dir")
    parts, real = [], paris.equality
    monkeypatch.setattr(paris, "equality", lambda *a: parts.append(a[7]) or real(*a))

    def left(**options):
        before = set(os.listdir(shared))
        rows = sorted(map(tuple, paris.paris_scores(pair, hot=3, **options).collect()))
        return rows, len(set(os.listdir(shared)) - before)

    _, once = left(rounds=1)
    whole, twice = left(rounds=2)
    assert twice - once <= 2  # the matches of the first round and the subrelations
    assert parts == [(0, 1)] * 3
    sliced, many = left(rounds=2, products=60)
    assert max(n for _, n in parts) > 1
    assert sliced == whole and len(whole) == 14 and many == twice
