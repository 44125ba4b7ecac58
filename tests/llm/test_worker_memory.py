"""What stays in the Python workers of an executor, which outlive their tasks."""

import pyarrow as pa

from alignscope.llm import common, near_dup
from alignscope.llm import sentencepiece_trie as sp


def passes(df) -> int:
    """The most Python passes that one task of df takes, each with a worker of its own."""
    most = 0

    def walk(node):
        nonlocal most
        below = [walk(node.children().apply(i)) for i in range(node.children().size())]
        n = 0 if "Exchange" in node.nodeName() else max(below, default=0) + node.nodeName().startswith(("MapInArrow", "PythonMapInArrow"))
        most = max(most, n)
        return n

    walk(df._jdf.queryExecution().sparkPlan())
    return most


def test_one_pass_a_task(spark, monkeypatch):
    seen = {}

    def stored(df, label, run=common.stored):
        # exchanges that repartition() asks for are in the plan already, those of joins and aggregates are below no pass here
        seen[label] = max(seen.get(label, 0), passes(df))
        return run(df, label)

    for module in (common, near_dup):
        monkeypatch.setattr(module, "stored", stored)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} x{i % 3}") for i in range(12)] + [(100 + i, f"{i} alone {i * i}") for i in range(5)], "doc_id long, text string")
    found = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.jaccard_join(docs).collect()}
    assert found == {i: (0, 11) for i in range(12)} | {100 + i: (100 + i, 0) for i in range(5)}
    assert seen["edges"] == seen["forest"] == seen["signed"] == 1
    assert max(seen.values()) == 1, seen


def test_contracted_in_the_pass_that_makes_them(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (200, 101), (300, 301)]
    rows = spark.createDataFrame(edges, "a long, b long").repartition(3)
    # rows (key, node): a run of equal keys is an edge from its first node to each other one
    runs = spark.createDataFrame([(k, n) for k, (a, b) in enumerate(edges) for n in (a, b)], "key long, node long").repartition(3, "key").sortWithinPartitions("key", "node")
    want = {r.node: r.root for r in common.components(rows).collect()}
    assert {r.node: r.root for r in common.settled(common.contracted(runs, near_dup._runs)).collect()} == want
    assert want[40] == 0 and want[200] == 100 and want[301] == 300


def test_pieces_go_with_the_next_run_of_another_kind():
    texts = pa.RecordBatch.from_arrays([pa.array(["some words of a text", None])], ["text"])
    content = sp.model_content(sp.MODEL_FILE)

    def coded(batches):
        for batch in batches:
            yield sp.piece_model(content).encode_texts(batch.column(0))

    encode = common.lean(coded, "piece_model")
    first = [x.to_pylist() for x in encode([texts])]
    model = sp.piece_model(content)
    assert [x.to_pylist() for x in encode([texts])] == first and sp.piece_model(content) is model  # kept for the next task
    assert list(common.lean(lambda batches: iter(batches))([texts])) == [texts]
    assert sp.piece_model.cache_info().currsize == 0
    assert [x.to_pylist() for x in encode([texts])] == first
