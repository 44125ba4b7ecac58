"""Each stage of the pipeline against a brute-force version on its own input."""

import corpus_pipeline
from alignscope.llm import decontaminate, near_dup, sentencepiece_trie

from . import cases


def test_stages(spark, tmp_path):
    import sentencepiece

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS).limit(90)
    extra = [(10_000 + i, t, None, None, None) for i, t in enumerate(cases.texts())]
    docs = base.union(spark.createDataFrame(extra, base.schema))
    items = [("b1", cases.texts()[-19]), ("b2", None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.collect()}
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language_id":
            letters = {d for d, t in before.items() if t and any(c.isalpha() for c in t)}
            assert kept[name] <= letters and len(kept[name]) > 0.9 * len(letters)
        elif name == "exact_dedup":
            best = {}
            for d, t in before.items():
                t = (t or "").translate(decontaminate._FOLD)
                best[t] = max(d, best.get(t, d))
            assert kept[name] == set(best.values())
        elif name == "near_dup":
            assert kept[name] == {c for c, _ in near_dup.brute_force(list(before.items())).values()}
        elif name == "decontaminate":
            assert kept[name] == {r[0] for r in decontaminate.brute_force(list(before.items()), items) if not r[5]}
            assert len(kept[name]) < len(before)
        else:
            library = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_trie.model_content())
            for r in docs.collect():
                assert r.ids == library.encode(before[r.doc_id] or "") and r.round_trip
            assert kept[name] == set(before)
    assert corpus_pipeline.STAGES[-1][0] == "sentencepiece"
