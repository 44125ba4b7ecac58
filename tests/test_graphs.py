"""Loaders, metrics, matchers, evaluation and errors on a small pair with hand-derived values."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from alignscope.functions import literals as L
from alignscope.functions import stats as S
from alignscope.operators import errors, evaluate, graph, linkage, matching, metrics, paris, reports
from alignscope.plans import config, datasets, folds, runner, session, sinks
from alignscope.sources import get_loader, ntriples, store
from alignscope.sources import paris as paris_files

from . import harbour


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    return store.save(get_loader("openea").load(spark, harbour.write(tmp_path_factory.mktemp("harbour"))), str(tmp_path_factory.mktemp("pair")))


def only(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    (row,) = df.collect()
    return row


def values(spark, items, fn, column="x"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, {column} string").orderBy("i").select(fn(F.col(column))).collect()]


# ---------------------------------------------------------------- loading


def test_loading(pair):
    assert {(r.kg, r.n_entities, r.n_rel_triples, r.n_attr_triples) for r in metrics.basic(pair).collect()} == {("kg1", 7, 5, 5), ("kg2", 6, 5, 4)}
    assert {r.split: r.n_matched for r in metrics.alignment_splits(pair).collect()} == {"train": 2, "valid": 1, "test": 3}


def test_missing_parts(spark, tmp_path):
    root = tmp_path / "kg"
    root.mkdir()
    (root / "rel_triples_1").write_text("a\tr\tb\n\nc\tr\n")
    (root / "rel_triples_2").write_text("")
    (root / "ent_links").write_text("a\tA\textra\n")
    p = get_loader("openea").load(spark, str(root))
    assert sorted(map(tuple, p.rel.collect())) == [("kg1", "a", "r", "b"), ("kg1", "c", "r", "")]
    assert p.attr.count() == 0 and [tuple(r) for r in p.align.collect()] == [("a", "A\textra", "all")]
    with pytest.raises(FileNotFoundError):
        get_loader("openea").load(spark, str(tmp_path / "none"))
    for make in (get_loader, metrics.get_metric, matching.get_matcher):
        with pytest.raises(ValueError, match="Unknown"):
            make("none")


def test_degrees(pair):
    d = {r.entity: (r.out_degree, r.in_degree, r.total_degree) for r in pair.degrees().where("kg = 'kg1'").collect()}
    assert d["l/oslo"] == (1, 2, 3) and d["l/norway"] == (0, 1, 1) and d["l/ghost"] == (0, 0, 0) and sum(x[2] for x in d.values()) == 10
    assert [r.entity for r in pair.ordinals().where("kg = 'kg2'").orderBy("i").collect()] == [f"r/{x}" for x in ("Anna", "Bert", "Norway", "Oslo", "Phantom", "Riga")]


# ---------------------------------------------------------------- literals


def test_literals(spark):
    raw = ['"Alice"', '"31"', f'"1990-01-01"^^{harbour.DATE}', '"1990-01-01"^^xsd:date', '"Dan"@fra', "", '"12"^^<http://dbpedia.org/datatype/usDollar>', "plain", '"open', "-3.5", '"a \\"b\\" \\\\ \\n"', '""']
    assert values(spark, raw, L.value) == ["Alice", "31", "1990-01-01", "1990-01-01", "Dan", "", "12", "plain", '"open', "-3.5", 'a "b" \\ \n', ""]
    assert values(spark, raw, L.datatype) == ["string", "numeric", "date", "date", "langString", "empty", "usDollar", "string", "string", "numeric", "string", "string"]
    assert values(spark, ['"Café  Münster"@de', None, '"ﬁ\t Ⅷ"'], L.normalised) == ["cafe munster", None, "fi viii"]
    assert values(spark, ["star wars: episode iv"], L.tokens) == [["star", "wars", "episode", "iv"]]
    assert values(spark, ["http://dbpedia.org/resource/X", "YAGO/y", "a#b/c", "plain"], L.namespace) == ["http://dbpedia.org/resource/", "YAGO/", "a#", "plain"]
    assert values(spark, ["http://x/y#z", "a#b/c", "a/b", "plain"], L.local_name) == ["z", "c", "b", "plain"]
    assert values(spark, ["abcd", "ab", ""], L.char_ngrams) == [["abc", "bcd"], ["ab"], []]
    assert values(spark, ['"x"^^xsd:integer', '"1"^^xsd:integer', '"2020-13-01"^^xsd:date', '"-1"^^xsd:nonNegativeInteger', '"maybe"^^xsd:boolean', '"t"'], L.is_ill_typed) == [True, False, True, True, True, False]
    terms = ["a b~*é/+%", "http://x/y?z", ""]
    assert values(spark, terms, lambda c: L.from_iri(L.to_iri(c, "e"))) == terms
    assert values(spark, ["a b~*"], lambda c: L.to_iri(c, "e")) == ["http://openea.local/e/a%20b~%2A"]


def test_ntriples_round_trip(spark, pair, tmp_path):
    path = str(tmp_path / "nt")
    assert ntriples.write(*pair.side("kg1"), path) == 10
    back = ntriples.read(spark, path)
    assert {r.subject for r in back.collect()} == {f"l/{x}" for x in ("anna", "bert", "oslo", "carl", "riga")}
    assert {(r.subject, r.object) for r in back.where("is_literal and predicate = 'name'").collect()} == {("l/anna", "Anna of Bergen"), ("l/bert", "Bert"), ("l/riga", "Rīga")}


# ---------------------------------------------------------------- statistics


def test_describe(spark):
    x = [1.0, 2.0, 2.0, 3.0, 10.0, 0.0, 7.0]
    n, m = len(x), sum(x) / len(x)
    mk = [sum((v - m) ** k for v in x) / n for k in range(5)]
    row = S.describe(spark.createDataFrame([("k", v) for v in x], "k string, v double"), ["k"], "v").first()
    assert (row.n, row.median, row.min, row.max) == (7, 2, 0, 10) and row["mean"] == pytest.approx(m) and row.std == pytest.approx(math.sqrt(mk[2]))
    assert row["skew"] == pytest.approx(mk[3] / mk[2] ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2))
    assert row["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (mk[4] / mk[2] ** 2 - 3) + 6))
    assert row.gini == pytest.approx(2 * sum((i + 1) * v for i, v in enumerate(sorted(x))) / (n * sum(x)) - (n + 1) / n)


def test_shares_of_counts(spark):
    t = spark.createDataFrame([("a", c) for c in (90, 5, 3, 1, 1)] + [("b", 5)] * 4 + [("c", 7)], "k string, n long")
    get = lambda df, c: {r.k: r[c] for r in df.collect()}
    assert get(S.concentration(t, ["k"], k=1), "top_share")["a"] == 0.9
    assert get(S.long_tail_share(t, ["k"]), "long_tail_share")["a"] == 0 and get(S.long_tail_share(t, ["k"], percent=5), "long_tail_share")["a"] == 0.6
    e = get(S.entropies(t, ["k"]), "entropy_norm")
    assert e["b"] == pytest.approx(1) and e["c"] == 0
    g = get(S.describe(t, ["k"], "n"), "gini")
    assert g["b"] == pytest.approx(0) and g["a"] > 0.6


def test_histogram_covers_everything(spark):
    x = [0, 0, 1, 1, 2, 5, 9, 50, 50, 1000]
    rows = S.log_histogram(spark.createDataFrame([("k", v) for v in x], "k string, v long"), ["k"], "v").collect()
    assert sum(r["count"] for r in rows) == len(x) and {r["count"] for r in rows if r.bin_lower == 0} == {2}
    assert S.powerlaw(spark.createDataFrame([("k", v) for v in x], "k string, v long"), ["k"], "v").first().alpha is None


def test_correlation_p():
    assert S.correlation_p(0.5, 10) == pytest.approx(0.14111328125, abs=1e-9)
    assert S.correlation_p(1.0, 5) == 0 and S.correlation_p(0.0, 8) == pytest.approx(1) and S.correlation_p(0.5, 2) is None


# ---------------------------------------------------------------- metrics


def test_metric_values(pair):
    d = only(S.describe(metrics.degree_kinds(pair), ["kg", "kind"], "degree"), kg="kg1", kind="total")
    assert (d["mean"], d["max"], d["median"]) == (pytest.approx(10 / 7), 3, 1)
    s = only(metrics.degree_shares(pair), kg="kg1")
    assert (s.share_isolated, s.share_deg_le_2) == (pytest.approx(1 / 7), pytest.approx(6 / 7))
    c = only(graph.connectivity(pair), kg="kg1")
    assert (c.n_components, c.size_largest_cc, c.share_largest_cc) == (3, 4, pytest.approx(4 / 7))
    assert c.avg_clustering == pytest.approx((1 + 1 + 1 / 3) / 7) and c.density == pytest.approx(10 / 42)
    a = only(metrics.attribute_completeness(pair), kg="kg1")
    assert (a.share_entities_with_attribute, a.mean_attr_per_entity) == (pytest.approx(4 / 7), pytest.approx(5 / 7))
    assert only(metrics.basic(pair), kg="kg2").attr_to_rel_ratio == 0.8
    assert only(metrics.schema_heterogeneity(pair), kind="property").jaccard == 0
    m = metrics.alignment_metrics(pair).first()
    assert (m.n_alignments, m.coverage_kg1, m.bijective_share) == (6, pytest.approx(6 / 7), 1.0)
    r = {x.criterion: x.share for x in metrics.reachability(pair).collect()}
    assert r == {k: pytest.approx(v / 6) for k, v in {"edge_kg1": 5, "edge_kg2": 5, "lcc_kg1": 4, "lcc_kg2": 5, "both_with_edge": 5, "both_in_lcc": 4}.items()}
    t = only(metrics.type_distribution(pair), kg="kg1")
    assert (t.n_type_triples, t.share_entities_typed, t.type_entropy_norm) == (0, 0, 0)
    o = {x.e1: x for x in metrics.literal_overlap(pair).collect()}
    assert o["l/anna"].literal_jaccard == o["l/riga"].literal_jaccard == 1 and o["l/bert"].shared == 0


def test_keys_over_both_graphs(pair):
    got = {(r.metric, r.key): r.value for n in metrics.METRICS for r in metrics.get_metric(n)(pair).collect()}
    assert got["degree_distribution", "pair.min_median_total_degree"] == 1 and got["connectivity", "pair.min_share_largest_cc"] == pytest.approx(4 / 7)
    assert got["attribute_completeness", "pair.mean_attr_per_entity"] == pytest.approx((5 / 7 + 4 / 6) / 2) and got["degree_distribution", "pair.max_share_isolated"] == pytest.approx(1 / 6)
    assert got["type_distribution", "pair.type_jaccard"] == 0 and got["property_distribution", "kg1.rel.freq.max"] == 3
    assert [got["alignment_metrics", f"split.{s}.n_pairs"] for s in ("train", "valid", "test")] == [2, 1, 3]
    assert got["alignment_metrics", "ambiguity_1_to_n"] == 0 and got["alignment_metrics", "unaligned_share_kg1"] == pytest.approx(1 / 7)
    assert got["aligned_consistency", "literal_value_jaccard.mean"] == 0.5 and got["aligned_consistency", "share_pairs_no_shared_literal"] == 0.5
    assert got["aligned_consistency", "share_pairs_both_isolated"] == pytest.approx(1 / 6) and got["aligned_consistency", "abs_degree_diff.max"] == 1


@pytest.mark.parametrize("name", sorted(metrics.METRICS))
def test_every_metric_gives_scalars(pair, name):
    rows = metrics.get_metric(name)(pair).collect()
    assert rows and len({r.key for r in rows}) == len(rows) and {r.metric for r in rows} == {name}
    assert all(r.value is None or 0 <= r.value <= 1 for r in rows if "share" in r.key or "jaccard" in r.key)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([("k", f"n{i:03}", f"n{i + 1:03}") for i in range(90)] + [("k", "x", "y")], "kg string, a string, b string")
    nodes = spark.createDataFrame([("k", f"n{i:03}") for i in range(91)] + [("k", n) for n in "xyz"], "kg string, node string")
    got = {r.node: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(91)} | {"x": "x", "y": "x", "z": "z"}


# ---------------------------------------------------------------- matching


def test_value_overlap(pair):
    got = {(r.e1, r.e2) for r in matching.value_overlap(min_score=0.0).match(pair).collect()}
    assert got == {("l/anna", "r/Anna"), ("l/oslo", "r/Oslo"), ("l/riga", "r/Riga")}
    assert {(r.e1, r.e2) for r in matching.value_overlap(min_score=0.9).match(pair).collect()} == got


def test_relations_and_structure(pair):
    seeds = pair.gold()
    found = {r.r1: (r.r2, r.inverted, r.weight) for r in matching.align_relations(pair, seeds, min_evidence=1).collect()}
    assert found == {"sailsTo": ("goesTo", False, 1.0), "sisterOf": ("siblingOf", True, 1.0), "partOf": ("contains", True, 1.0)}
    m = matching.structural(iterations=2)
    one = {tuple(x) for x in m.match(pair, seeds).collect()}
    assert one == {tuple(x) for x in m.match(pair.with_frames(attr=pair.attr.limit(0)), seeds).collect()} and one


def test_reductions(spark):
    s = spark.createDataFrame([("a", "w", 0.1), ("a", "x", 0.9), ("a", "y", 0.5), ("a", "z", 0.3), ("b", "x", 0.4), ("b", "y", 0.4), ("c", "x", 0.0)], "e1 string, e2 string, score double")
    assert {(r.e1, r.e2) for r in matching.top_k(s, 2).where("e1 = 'a'").collect()} == {("a", "x"), ("a", "y")}
    assert {r.e1: r.margin for r in matching.margins(s).collect()} == {"a": 0.4, "b": 0.0}
    assert {r.e1 for r in matching.reduce_scores(s, 0.5).collect()} == {"a"}
    assert {(r.e1, r.e2) for r in matching.bootstrap(spark.createDataFrame([("b", "q")], "e1 string, e2 string"), s, 0.1).collect()} == {("b", "q"), ("a", "x")}


def test_unique_mapping_is_greedy(spark):
    import random

    rng = random.Random(3)
    edges = [(f"a{rng.randrange(25)}", f"b{rng.randrange(25)}", rng.randrange(5) / 4) for _ in range(150)]
    edges = list({e[:2]: e for e in edges}.values())
    used, want = set(), set()
    for e1, e2, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if s >= 0.3 and e1 not in used and e2 not in used:
            used |= {e1, e2}
            want.add((e1, e2))
    assert {(r.e1, r.e2) for r in linkage.unique_mapping(spark.createDataFrame(edges, "e1 string, e2 string, score double"), 0.3).collect()} == want


def test_linkage_and_fixpoint_find_equal_values(pair):
    assert ("l/riga", "r/Riga") in {(r.e1, r.e2) for r in linkage.ngram_matcher().match(pair).collect()}
    assert ("l/anna", "r/Anna") in {(r.e1, r.e2) for r in paris.paris_matcher(rounds=2).match(pair).collect()}


# ---------------------------------------------------------------- evaluation


def predictions(spark, *pairs):
    return spark.createDataFrame([(*p, 1.0) for p in pairs], "e1 string, e2 string, score double")


def test_evaluation(spark, pair):
    right = [("l/norway", "r/Norway"), ("l/riga", "r/Riga"), ("l/ghost", "r/Phantom")]
    perfect = evaluate.evaluate(predictions(spark, *right, ("l/anna", "r/Bert")), pair).first()
    assert (perfect.precision, perfect.recall, perfect.f1, perfect.n_predicted) == (1, 1, 1, 3)
    one = evaluate.evaluate(predictions(spark, right[0], ("l/riga", "r/Oslo")), pair).first()
    assert (one.precision, one.recall, one.coverage) == (0.5, pytest.approx(1 / 3), pytest.approx(2 / 3))
    none = evaluate.evaluate(predictions(spark, ("x", "y")).limit(0), pair).first()
    assert (none.f1, none.abstain_rate) == (0, 1)
    partnerless = pair.with_frames(align=pair.align.withColumn("e2", F.when(F.col("e1") == "l/ghost", "").otherwise(F.col("e2"))))
    row = evaluate.evaluate(predictions(spark, *right), partnerless).first()
    assert (row.precision, row.recall, row.n_false_on_unmatched, row.n_unmatched) == (pytest.approx(2 / 3), 1, 1, 1)


def test_sweep_falls(spark, pair):
    c = spark.createDataFrame([("l/bert", "r/Bert", 0.35)], "e1 string, e2 string, score double")
    sweep = evaluate.threshold_sweep(c, pair)
    assert [r.n_correct for r in sweep.orderBy("threshold").collect()] == [1] * 4 + [0] * 6
    assert evaluate.threshold_choice(sweep, []).first().threshold == 0
    assert {r.fraction: r.n_seeds for r in evaluate.seed_sizes(pair).collect()} == {0.05: 1, 0.1: 1, 0.25: 1, 0.5: 1, 0.75: 2, 1.0: 2}


def test_non_matches(pair):
    v = evaluate.inject_non_matches(pair, 0.5)
    assert (v.matched().count(), v.unmatched().count()) == (3, 2) and v.rel.count() < pair.rel.count() + 1
    gone = {r.e1 for r in pair.align.collect()} - {r.e1 for r in v.align.collect()}
    assert len(gone) == 1 and not gone & {r.entity for r in v.entities().collect()}
    assert sorted(map(tuple, v.align.collect())) == sorted(map(tuple, evaluate.inject_non_matches(pair, 0.5).align.collect()))
    assert evaluate.inject_non_matches(pair, 1.0).matched().count() == 6 and pair.matched().count() == 6
    for bad in (0, -0.5, 1.5):
        with pytest.raises(ValueError):
            evaluate.inject_non_matches(pair, bad)


# ---------------------------------------------------------------- errors and reports


def test_error_classes(spark, pair):
    facts = errors.features(pair)
    nothing = predictions(spark, ("x", "y")).limit(0)
    got = {f: {r.e1[2:]: r.error_class for r in errors.classify(facts, nothing, f).collect()} for f in ("value", "structural", "holistic")}
    assert got["value"] == {"ghost": "no_signal", "norway": "no_shared_literal", "riga": "abstained"}
    assert got["structural"] == {"ghost": "no_signal", "norway": "abstained", "riga": "structurally_unreachable"}
    assert got["holistic"] == {"ghost": "no_signal", "norway": "abstained", "riga": "abstained"}
    wrong = errors.classify(facts, predictions(spark, ("l/norway", "r/Oslo")), "structural")
    assert {r.e1: r.error_class for r in wrong.collect()}["l/norway"] == "wrong_candidate"
    summary = errors.summarize(wrong, "harbour", "m")
    assert summary.count() == 8 and sum(r.share for r in summary.collect()) == pytest.approx(1)
    s = errors.solvability(summary).first()
    assert (s.n_errors, s.n_unsolvable, s.unsolvable_share, s.method_share) == (3, 2, 0.6667, 0.3333)


def test_corrections(spark):
    def adjusted(ps):
        rows = reports.adjust_p_values(spark.createDataFrame([("m", f"k{i}", p) for i, p in enumerate(ps)], "matcher string, metric string, p_value double")).orderBy("metric").collect()
        return [r.p_fdr for r in rows], [r.survives_bonferroni for r in rows]

    assert adjusted([0.03, 0.05, 0.06])[0] == pytest.approx([0.06] * 3)
    fdr, kept = adjusted([0.8, 0.001, 0.5, 0.2, 0.21])
    assert fdr == pytest.approx([0.8, 0.005, 0.625, 0.35, 0.35]) and kept == [False, True, False, False, False]
    few = spark.createDataFrame([(f"d{i}", "m", i / 7, float(i)) for i in range(3)], "dataset string, matcher string, f1 double, x double")
    assert reports.correlate(few, ["x"]).count() == 0


def test_a_whole_run(spark, tmp_path):
    raw = {"datasets": [{"name": "harbour", "path": harbour.write(tmp_path / "in")}, {"name": "gone", "path": str(tmp_path / "none")}], "metrics": ["basic_stats", "alignment_metrics"], "matchers": ["value_overlap", {"name": "structural_propagation", "params": {"iterations": 1}}], "output": str(tmp_path / "out")}
    run = runner.Pipeline(spark, config.from_dict(raw))
    run.run()
    assert {s[:3] for s in run.scores} == {("harbour", m, s) for m in ("value_overlap", "structural_propagation") for s in ("test", "all")}
    assert spark.read.parquet(str(tmp_path / "out/reports/comparison")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out/reports/f1_matrix")).count() == 1
    assert len({(r.e1, r.e2) for r in sinks.read_predictions(spark, str(tmp_path / "out/predictions/harbour/value_overlap")).collect()}) == 3
    assert sinks.read_scores(spark, str(tmp_path / "out/reports/matching_results")).where("split = 'test'").count() == 2
    (line,) = spark.read.text(str(tmp_path / "out/reports/summary")).collect()
    assert set(json.loads(line.value)["f1"]) == {"harbour/value_overlap", "harbour/structural_propagation"}


def test_folds(spark, tmp_path):
    path = harbour.write(tmp_path / "in")
    t = folds.run_folds(spark, {"harbour": path, "harbour_100K": path}, [("value_overlap", {}), ("structural_propagation", {"iterations": 1})], folds=(1, 2))
    got = {(r.fold, r.matcher): (r.n_gold, r.n_predicted, r.n_correct) for r in t.collect()}
    assert set(got) == {(f, m) for f in (1, 2) for m in ("value_overlap", "structural_propagation")} and {r.dataset for r in t.collect()} == {"harbour"}
    assert got[1, "value_overlap"] == (3, 1, 1) and got[2, "value_overlap"] == (2, 2, 2)
    v = only(evaluate.fold_variance(t), matcher="value_overlap")
    assert v.n_folds == 2 and v.f1_mean == pytest.approx((0.5 + 1) / 2)
    lone = folds.run_folds(spark, {"harbour": path}, [("value_overlap", {})], folds=(1,), match_ratio=0.5, split="all").first()
    assert (lone.n_gold, lone.n_unmatched) == (3, 2)
    with pytest.raises(ValueError):
        folds.run_folds(spark, {"a_100K": path}, [])


def test_session_and_core_run(spark, tmp_path):
    assert session.get_session().sparkContext is spark.sparkContext
    values, seconds = session.timed_core(spark, harbour.write(tmp_path / "in"))
    assert values["basic_stats.kg1.n_entities"] == 7 and values["degree_distribution.pair.min_median_total_degree"] == 1 and seconds > 0


def test_output_of_an_external_aligner(spark, pair, tmp_path):
    (tmp_path / "3_eqv.tsv").write_text("")
    (tmp_path / "1_eqv.tsv").write_text("old\told\t1\n")
    (tmp_path / "2_eqv.tsv").write_text("<http://openea.local/e/l%2Fanna>\thttp://openea.local/e/r%2FAnna\t0.75\nl/anna\tr/Bert\t0.5\nl/bert\tr/Bert\tnone\nl/bert\tr/Anna\nx\tr/Oslo\t1\nl/oslo\ty\t1\nalone\n")
    assert sorted(map(tuple, paris_files.read_equivalences(spark, str(tmp_path)).collect())) == [("l/anna", "r/Anna", 0.75), ("l/bert", "r/Anna", 0.0), ("l/oslo", "y", 1.0), ("x", "r/Oslo", 1.0)]
    assert sorted(map(tuple, paris_files.read_equivalences(spark, str(tmp_path), pair).collect())) == [("l/anna", "r/Anna", 0.75), ("l/bert", "r/Anna", 0.0)]
    (tmp_path / "none").mkdir()
    assert paris_files.read_equivalences(spark, str(tmp_path / "none")).count() == 0


def test_dataset_folders(spark, tmp_path):
    harbour.write(tmp_path / "harbour")
    (tmp_path / "other").mkdir()
    (tmp_path / "part").mkdir()
    (tmp_path / "part/ent_links").write_text("a\tb\n")
    raw = datasets.extended_config(spark, str(tmp_path), {"metrics": ["basic_stats"]})
    datasets.write_config(raw, str(tmp_path / "run.yaml"))
    got = config.load_config(str(tmp_path / "run.yaml"))
    assert [d.name for d in got.datasets] == ["harbour", "part"] and got.metrics == ["basic_stats"]
    assert datasets.missing_files(spark, str(tmp_path / "harbour")) == [] and datasets.missing_files(spark, str(tmp_path / "part")) == list(datasets.REQUIRED[:4])
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for name in ("top/one/ent_links", "top/two/ent_links"):
            z.writestr(name, "a\tb\n")
    assert datasets.fetch("http://nowhere.invalid/all.zip", str(tmp_path / "all.zip"), {"two"}) == ["two"]
    assert (tmp_path / "top/two/ent_links").exists() and not (tmp_path / "top/one").exists()


def test_probe_and_store_comparison(spark, pair, tmp_path):
    path = str(tmp_path / "nt")
    ntriples.write(*pair.side("kg1"), path)
    (tmp_path / "bad.nt").write_text("# comment\n<a> <b> <c> .\nl/anna\tsailsTo\tl/oslo\n<a> <b> \"x\"@en-GB .\n_:x <b> \"1\"^^<t> . # y\n")
    got = {r.path: (r.n_lines, r.n_statements, r.parses) for r in ntriples.probe(spark, [path, str(tmp_path / "bad.nt")]).collect()}
    assert got == {path: (10, 10, True), str(tmp_path / "bad.nt"): (4, 3, False)}
    assert tuple(ntriples.store_comparison(ntriples.read(spark, path), pair.side("kg1")).first()) == (10, 5, 10, 5)


def test_long_literal(spark, tmp_path):
    """A literal of many characters and escapes takes no stack."""
    path, long = str(tmp_path / "long"), 'a "quoted"\tpart\\' * 60_000
    attr = spark.createDataFrame([("h", "name", f'"{long}"')], "head string, attribute string, literal string")
    none = spark.createDataFrame([], "head string, relation string, tail string")
    assert ntriples.write(none, attr, path) == 1
    expected = attr.select(L.value(F.col("literal")).alias("v")).first().v
    assert [(r.object, r.is_literal) for r in ntriples.read(spark, path).collect()] == [(expected, True)]
    assert [(r.n_statements, r.parses) for r in ntriples.probe(spark, [path]).collect()] == [(1, True)]
