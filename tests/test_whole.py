"""The queries of the whole graph on a small pair with orders, parts, types and seeded vendors, against brute force."""

import math
import re
from collections import Counter, defaultdict
from itertools import product

import pytest

from alignscope.model import ALIGN, ATTR, REL, KGPair
from alignscope.operators import graph, linkage, matching, paris
from alignscope.queries import base, registry

L, R = "http://left.example/", "http://right.example/resource/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def tables():
    """(rel, attr, align) as rows: 8 customers (one without a partner or an order), 4 suppliers, 6 parts, 7 orders."""
    iri = lambda kg, kind, i: f"{L}{kind}/{i}" if kg == "kg1" else f"{R}{kind.upper()}_{i}"
    rel, attr, align = [], [], []
    for kg, names in (("kg1", ("inNation", "placedBy", "contains", "availableFrom")), ("kg2", ("country", "hasOrder", "item", "vendor"))):
        nation, order, item, vendor = (f"{L}p/{n}" if kg == "kg1" else f"{R}ontology#{n}" for n in names)
        name, date = (f"{L}p/name", f"{L}p/date") if kg == "kg1" else (f"{R}ontology#label", f"{R}ontology#datum")
        e = lambda kind, i, kg=kg: iri(kg, kind, i)
        for c in range(8 if kg == "kg1" else 7):
            rel += [(kg, e("c", c), TYPE, e("t", c % 2)), (kg, e("c", c), nation, e("n", c % 3))] if c < 7 else []
            attr.append((kg, e("c", c), name, f'"customer {c} of row {c % 4}"'))
        for s in range(4):
            rel.append((kg, e("s", s), nation, e("n", s % 2 + 3)))
            attr.append((kg, e("s", s), name, f'"supplier {s}"'))
        for p in range(6):
            rel += [(kg, e("p", p), TYPE, f"http://types.example/{p % 2}")] + [(kg, e("p", p), vendor, e("s", s)) for s in {p % 4, p // 2}]
            attr.append((kg, e("p", p), name, f'"{("red", "blue", "hot")[p % 3]} {("bolt", "gear")[p // 3]}"'))
        for o in range(7):
            rel += [(kg, e("o", o), order, e("c", o % 5)) if kg == "kg1" else (kg, e("c", o % 5), order, e("o", o)), (kg, e("o", o), item, e("p", o % 6))]
            attr.append((kg, e("o", o), date, f'"1995-0{o % 3 + 1}-1{o}"'))
    for kind, n in (("c", 8), ("s", 4), ("p", 6)):
        align += [(iri("kg1", kind, i), "" if kind == "c" and i == 7 else iri("kg2", kind, i), "train" if kind != "c" or i < 2 else "test") for i in range(n)]
    return rel, attr, align


@pytest.fixture(scope="module")
def run(spark):
    rel, attr, align = tables()
    key = (spark.sparkContext.applicationId, "whole")
    base._loaded[key] = KGPair("whole", spark.createDataFrame(rel, REL), spark.createDataFrame(attr, ATTR), spark.createDataFrame(align, ALIGN))
    yield lambda name: [tuple(r) for r in registry.QUERIES[name](spark, "whole").collect()]
    del base._loaded[key]


def kinds(rows, column=0):
    return {re.search(r"/([a-z])/", r[column])[1] for r in rows if re.search(r"/([a-z])/", r[column])}


# ---------------------------------------------------------------- linkage


def records():
    values = defaultdict(set)
    for kg, head, _, literal in tables()[1]:
        values[kg, head].add(literal.strip('"'))
    return {k: " ".join(sorted(v)) for k, v in values.items()}


def purge_bound(smoothing):
    """sizes by token -> the most comparisons of a block that stays."""

    def bound(sides):
        levels = sorted({a * b for a, b in sides.values()})
        total = lambda m: (sum(a + b for a, b in sides.values() if a * b <= m), sum(a * b for a, b in sides.values() if a * b <= m))
        for less, most in reversed(list(zip(levels, levels[1:]))):
            (a1, c1), (a2, c2) = total(less), total(most)
            if a1 * c2 < smoothing * c1 * a2:
                return most
        return levels[0]

    return bound


def clean(bound):
    """{(kg, entity): tokens} after purging above bound(sizes by token) and filtering."""
    blocks = defaultdict(set)
    for k, text in records().items():
        for t in re.findall("[0-9a-z]+", text):
            blocks[t].add(k)
    sides = {t: [sum(k[0] == kg for k in b) for kg in ("kg1", "kg2")] for t, b in blocks.items()}
    sides = {t: s for t, s in sides.items() if min(s) > 0}
    most = bound(sides)
    size = {t: a * b for t, (a, b) in sides.items() if a * b <= most}
    mine = defaultdict(list)
    for t in sorted(size, key=lambda t: (size[t], t)):
        for k in blocks[t]:
            mine[k].append(t)
    return {k: set(ts[: math.ceil(len(ts) * 0.8)]) for k, ts in mine.items()}


def weights(kept):
    edges = {(a[1], b[1]): (len(x & y), len(x), len(y)) for (a, x), (b, y) in product(kept.items(), kept.items()) if a[0] == "kg1" and b[0] == "kg2" and x & y}
    d1, d2 = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    w = {(a, b): round(c / (m + n - c) * math.log10(len(edges) / d1[a]) * math.log10(len(edges) / d2[b]), 9) for (a, b), (c, m, n) in edges.items()}
    mean = round(sum(w.values()) / len(w), 9)
    return {k: v for k, v in w.items() if v >= mean}


def test_purging_follows_the_sizes(spark):
    # 60 tokens of 70 x 70 entities: more than any fixed 2,500 comparisons, yet not larger than the rest
    rows = [(kg, f"{kg}{i}", f"t{t}") for kg in ("kg1", "kg2") for t in range(60) for i in range(70)]
    rows += [(kg, f"{kg}{i}", "the") for kg in ("kg1", "kg2") for i in range(1000)]
    kept = linkage.clean_blocks(spark.createDataFrame(rows, "kg string, entity string, token string"), keep_ratio=1.0)
    assert {r.token for r in kept.select("token").distinct().collect()} == {f"t{t}" for t in range(60)}


def test_linkage_reads_the_whole_graph(run):
    got = run("entity_records")
    assert {(kg, e): t for kg, e, t in got} == records() and kinds(got, 1) == {"c", "s", "p", "o"}
    kept = clean(purge_bound(1.025))
    assert sorted(run("token_blocks")) == sorted((*k, t) for k, ts in kept.items() for t in ts)
    want = weights(clean(purge_bound(1.0)))
    assert {r[:2]: r[2] for r in run("meta_blocking_weights")} == pytest.approx(want, abs=2e-6)
    sim = {r[:2]: r[2] for r in run("ngram_similarity")}
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    text = {e: grams(t) for (_, e), t in records().items()}
    assert sim == pytest.approx({(a, b): len(text[a] & text[b]) / math.sqrt(len(text[a]) * len(text[b])) for a, b in want}, abs=2e-6)
    used, mapped = set(), set()
    for (a, b), s in sorted(sim.items(), key=lambda x: (-x[1], x[0])):
        if s >= 0.2 and a not in used and b not in used:
            used |= {a, b}
            mapped.add((a, b))
    # so few blocks are purged down to the smallest: parts and suppliers have none left here, as brute force says too
    assert {r[:2] for r in run("ngram_match")} == mapped and "o" in kinds(mapped)


def test_mapping_and_fixpoint_reach_parts_and_orders(run):
    assert kinds(run("unique_mapping")) == {"c", "s", "p", "o"}
    assert kinds(run("paris_fixpoint")) >= {"c", "s", "p", "o"}


# ---------------------------------------------------------------- components


def test_components_of_the_whole_graph(run):
    rel, attr, align = tables()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for kg, h, _, t in rel:
        a, b = sorted((find((kg, h)), find((kg, t))))
        parent[b] = a
    for k in [(kg, h) for kg, h, _, _ in attr] + [("kg1", a) for a, _, _ in align] + [("kg2", b) for _, b, _ in align if b]:
        find(k)
    want = {(kg, e, find((kg, e))[1]) for kg, e in parent}
    assert set(run("components")) == want and len(want) > 50
    sizes = Counter((kg, c) for kg, _, c in want)
    got = run("component_sizes")
    assert sorted((kg, n) for kg, _, n in got) == sorted((kg, n) for (kg, _), n in sizes.items())
    assert (L + "c/7") in {e for _, e, c in want if e == c} and max(sizes.values()) > 20


# ---------------------------------------------------------------- structure


def aligned(seeds):
    rel = tables()[0]
    two, to = {r for r in rel if r[0] == "kg2"}, dict(seeds)
    co, c1, c2 = Counter(), Counter(), Counter()
    for kg, h, r, t in rel:
        if kg == "kg1" and h in to and t in to:
            c1[r] += 1
            for _, a, r2, b in two:
                co[r, r2, False] += (a, b) == (to[h], to[t])
                co[r, r2, True] += (b, a) == (to[h], to[t])
    for (_, r2, _), n in co.items():
        c2[r2] += n
    best = {}
    for (r1, r2, inv), n in sorted(co.items()):
        if n >= 3 and (w := round(2 * n / (c1[r1] + c2[r2]), 9)) > best.get(r1, (0,))[0]:
            best[r1] = (w, r2, inv)
    return best


def propagated(seeds, al):
    rel, score = tables()[0], Counter()
    blocks = [({r1}, {r2}, w, inv) for r1, (w, r2, inv) in al.items()] + [(None, None, 0.3 if al else 1.0, False)]

    def rows(kg, names, turn):
        out = defaultdict(Counter)
        for g, h, r, t in rel:
            if g == kg and (names is None or r in names):
                out[t if turn else h][h if turn else t] += 1
        return out

    unit = lambda c: {k: v / math.sqrt(sum(x * x for x in c.values())) for k, v in c.items()}
    for (r1, r2, w, inv), turn in product(blocks, (False, True)):
        two = {x: unit(c) for x, c in rows("kg2", r2, turn != inv).items()}
        for e1, c in rows("kg1", r1, turn).items():
            m = Counter()
            for y, n in c.items():
                for a, z in seeds:
                    if a == y:
                        m[z] += n
            for e2, u in two.items() if m else ():
                if common := sum(v * u.get(z, 0) for z, v in unit(m).items()):
                    score[e1, e2] += w * common
    by = defaultdict(list)
    for (e1, e2), s in score.items():
        by[e1].append((-round(s, 9), e2))
    return {e1: [(-s, e2) for s, e2 in sorted(x)[:10]] for e1, x in by.items()}


def test_structure_uses_every_relation_and_five_rounds(run):
    seeds = {(a, b) for a, b, s in tables()[2] if s == "train" and b}
    al = aligned(seeds)
    assert f"{L}p/availableFrom" in al
    one = propagated(seeds, al)
    assert {r[:2]: r[2] for r in run("structural_round1")} == pytest.approx({(a, b): s for a, x in one.items() for s, b in x}, abs=2e-6)
    for _ in range(5):
        last = {a: [(s / x[0][0], b) for s, b in x] for a, x in propagated(seeds, al).items()}
        lead = {a: (x[0][1], round(x[0][0] - (x[1][0] if len(x) > 1 else 0), 9)) for a, x in last.items()}
        seeds |= {(a, b) for a, (b, m) in lead.items() if m >= 0.1}
    want = {(a, b): m for a, (b, m) in lead.items() if m >= 0.1}
    assert {r[:2]: r[2] for r in run("structural_full")} == pytest.approx(want, abs=2e-6) and kinds(want) >= {"p", "s", "o"}


def test_runs_with_every_seed_fraction(run):
    _, _, align = tables()
    rows = {r[0]: r[1:] for r in run("seed_size_runs")}
    assert {f: r[-1] for f, r in rows.items()} == {0.05: 1, 0.1: 1, 0.25: 3, 0.5: 6, 0.75: 9, 1.0: 12}
    seeds = {(a, b) for a, b, s in align if s == "train" and b}
    one = propagated(seeds, aligned(seeds))
    lead = {a: (x[0][1], 1 - (x[1][0] / x[0][0] if len(x) > 1 else 0)) for a, x in one.items()}
    test = {a: b for a, b, s in align if s == "test"}
    found = {a: b for a, (b, m) in lead.items() if m >= 0.1 and a in test}
    gold = {a: b for a, b in test.items() if b}
    right = sum(gold.get(a) == b for a, b in found.items())
    n_gold, n_unmatched, n_predicted, n_correct = rows[1.0][:4]
    assert (n_gold, n_unmatched, n_predicted, n_correct) == (len(gold), len(test) - len(gold), len(found), right) and n_gold > 0


def test_strong_scores_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(8)
    attr = [(kg, f"{kg}e{i}", "p", f'"v{min(int(rng.expovariate(0.08)), 60)}"') for kg in ("kg1", "kg2") for i in range(150) for _ in range(rng.randrange(1, 7))]
    pair = KGPair("strong", spark.createDataFrame([], REL), spark.createDataFrame(attr, ATTR), spark.createDataFrame([], ALIGN))
    every = {r[:2]: r[2] for r in map(tuple, matching.value_scores(pair, 0.2).collect())}
    for least in (0.2, 0.4, 0.9):
        got = {r[:2]: r[2] for r in map(tuple, matching.strong_value_scores(pair, least, 0.2).collect())}
        assert got == {k: v for k, v in every.items() if v >= least}
    assert len(got) > 20 and len(every) > 3 * len(got)


def test_components_in_rounds(spark):
    import random

    rng = random.Random(4)
    edges = [(f"a{rng.randrange(300):03}", f"a{rng.randrange(300):03}") for _ in range(200)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(120)] + [("hub", f"s{i:03}") for i in range(200)] + [("q0", "q1"), ("q1", "q2"), ("q2", "q0")]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    e = spark.createDataFrame([(kg, a, b) for kg in ("kg1", "kg2") for a, b in edges], "kg string, a string, b string").repartition(5)
    nodes = spark.createDataFrame([(kg, x) for kg in ("kg1", "kg2") for x in [*parent, "alone"]], "kg string, node string")
    want = {(kg, x, find(x) if x != "alone" else x) for kg in ("kg1", "kg2") for x in [*parent, "alone"]}
    for one_task in (-1, 10**6):
        assert {tuple(r) for r in graph.connected_components(nodes, e, one_task=one_task).collect()} == want
    assert graph.connected_components(nodes.limit(0), e.limit(0), one_task=-1).count() == 0


# ---------------------------------------------------------------- the fixpoint


def test_fixpoint_counts_hub_statements(spark):
    n = 54  # more than the 50 that make a statement hot
    rel, attr = [], []
    for kg, e in (("kg1", "a"), ("kg2", "b")):
        rel += [(kg, f"{e}{i:02}", "in", f"{e}n{i % 7 == 0:d}") for i in range(n)] + [(kg, f"{e}{i:02}", "by", f"{e}{(i * 5 + 1) % n:02}") for i in range(20)]
        attr += [(kg, f"{e}{i:02}", "is", '"common"') for i in range(n)] + [(kg, f"{e}{i:02}", "name", f'"x{i % 9}"' if i % 9 else f'"{e} alone"') for i in range(0, n, 2)] + [(kg, f"{e}n{i}", "name", f'"place {i}"') for i in (0, 1)]
    pair = KGPair("hubs", spark.createDataFrame(rel, REL), spark.createDataFrame(attr, ATTR), spark.createDataFrame([], ALIGN))
    facts = {(kg, r, h, t, False) for kg, h, r, t in rel} | {(kg, f"{r}^-1", t, h, False) for kg, h, r, t in rel} | {(kg, f"@{a}", h, v.strip('"'), True) for kg, h, a, v in attr}
    of = defaultdict(list)
    for f in facts:
        of[f[:2]].append(f)
    inv = {k: len({f[3] for f in fs}) / len(fs) for k, fs in of.items()}
    one, two = ([f for f in facts if f[0] == kg] for kg in ("kg1", "kg2"))
    equal, sub = {}, None
    for _ in range(2):
        miss = defaultdict(float)
        for (_, r1, x1, y1, l1), (_, r2, x2, y2, l2) in product(one, two):
            p = float(y1 == y2) if l1 and l2 else equal.get(y1, ("", 0))[1] * (equal.get(y1, ("",))[0] == y2) if not l1 and not l2 else 0
            if p:
                s12, s21 = (0.1, 0.1) if sub is None else sub.get((r1, r2), (0, 0))
                miss[x1, x2] += math.log(max((1 - s21 * inv["kg1", r1] * p) * (1 - s12 * inv["kg2", r2] * p), 1e-12))
        equal = {}
        for (a, b), m in sorted(miss.items()):
            if (s := round(1 - math.exp(m), 9)) > equal.get(a, ("", 0))[1]:
                equal[a] = (b, s)
        # each statement's counterparts in the other graph with their probabilities, from all pairs of statements
        back = defaultdict(dict)
        for e, (b, s) in equal.items():
            back[b][e] = s
        match = lambda e, lit, there: ({e: 1.0 for v in values[there] if v == e} if lit else dict([equal[e]]) if there and e in equal else {} if there else back[e])
        known = {(r, x, y) for _, r, x, y, _ in facts}
        names = [sorted({f[1] for f in side}) for side in (one, two)]
        values = [{f[3] for f in side if f[4]} for side in (one, two)]

        def share(mine, to, r, other):
            up = down = 0.0
            for _, q, x, y, lit in mine:
                if q == r:
                    pairs = [(a, b, p * o) for a, p in match(x, False, to).items() for b, o in match(y, lit, to).items()]
                    up += 1 - math.prod(1 - p for a, b, p in pairs if (other, a, b) in known)
                    down += 1 - math.prod(1 - p for *_, p in pairs)
            return up / down if down else 0

        sub = {(r, q): (share(one, True, r, q), share(two, False, q, r)) for r, q in product(*names)}
    assert len(equal) == n + 2
    for hot in (50, 3):
        got = {r.e1: (r.e2, r.score) for r in paris.paris_scores(pair, rounds=2, hot=hot).collect()}
        assert {a: b for a, (b, _) in got.items()} == {a: b for a, (b, _) in equal.items()}
        assert {a: s for a, (_, s) in got.items()} == pytest.approx({a: s for a, (_, s) in equal.items()}, abs=1e-7)


def test_stars_of_a_task():
    import numpy as np
    import pyarrow as pa

    n = 3_000_000  # two paths and a cycle, in mixed order, over several contractions
    rng = np.random.default_rng(1)
    ids = rng.permutation(10 * n)[:n].astype("int64")
    a, b = ids[:-1].copy(), ids[1:].copy()
    b[1_000_000] = a[1_000_000]
    mixed = rng.permutation(n - 1)
    parts = np.array_split(mixed, 50) + np.array_split(mixed, 50)
    batches = (pa.RecordBatch.from_arrays([pa.array(a[p]), pa.array(b[p])], ["a", "b"]) for p in parts)
    out = pa.Table.from_batches(list(graph._contract_all(batches)))
    got = dict(zip(out["a"].to_pylist(), out["b"].to_pylist()))
    first, second = ids[:1_000_001], ids[1_000_001:]
    want = {x: least for part in (first, second) for least in (int(part.min()),) for x in part.tolist() if x != least}
    assert got == want


def test_edges_between_numbers_and_triangles(spark):
    """Edges carry numbers, loops and nulls are none, and triangles are those of all triples of nodes."""
    from itertools import combinations
    from random import Random

    dealt = Random(3)
    names = [f"n{i}" for i in range(30)]
    pairs = [(dealt.choice(names), dealt.choice(names)) for _ in range(150)] + [("n0", n) for n in names] + [("n1", None), (None, None)]
    pair = KGPair("dealt", *(spark.createDataFrame(rows, schema) for rows, schema in (
        ([("kg1", a, "r", b) for a, b in pairs], "kg string, head string, relation string, tail string"),
        ([], "kg string, head string, attribute string, literal string"),
        ([], "e1 string, e2 string, split string"),
    )))
    near = {frozenset(p) for p in pairs if None not in p and p[0] != p[1]}
    edges = graph.pair_edges(pair)
    assert dict(edges.dtypes) == {"kg": "string", "a": "bigint", "b": "bigint"} and edges.count() == len(near)
    found = [t for t in combinations(names, 3) if all(frozenset(p) in near for p in combinations(t, 2))]
    degree = Counter(n for e in near for n in e)
    own = Counter(n for t in found for n in t)
    want = sum(2 * own[n] / (d * (d - 1)) for n, d in degree.items() if d > 1) / len({n for p in pairs for n in p if n})
    row = graph.clustering(pair).first()
    assert row.n_triangles == len(found) > 50 and row.avg_clustering == pytest.approx(want)
