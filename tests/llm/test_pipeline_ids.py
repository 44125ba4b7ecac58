"""Null and repeated ids in the stages of the pipeline."""

import corpus_pipeline

EN, FR = "the quick brown fox jumps over the lazy dog and runs away", "le renard brun saute par dessus le chien et il court"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    passage = " ".join(f"passage{i} word" for i in range(12))
    spark.createDataFrame([("b", passage)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    learn = [(100 + i, f"{t} {i}", lang, None, None) for i in range(6) for t, lang in ((EN, "en"), (FR, "fr"))]

    def run(name, rows):
        stage = dict(corpus_pipeline.STAGES)[name]
        out = stage(spark, spark.createDataFrame([(*r, "en", None, None) for r in rows] + (learn if name == "language_id" else []), SCHEMA).repartition(3), str(tmp_path))
        return sorted(((r.doc_id, r.text) for r in out.collect() if (r.doc_id or 0) < 100), key=repr)

    same = lambda rows: sorted(rows, key=repr)
    assert run("language_id", [(None, EN), (1, EN), (1, "123 ..."), (1, EN), (None, "")]) == same([(None, EN), (1, EN), (1, EN)])
    assert run("exact_dedup", [(None, EN), (None, EN), (2, FR), (2, FR), (None, FR), (2, "x y"), (3, "X y")]) == same([(None, EN), (2, FR), (3, "X y")])
    assert run("near_dup", [(None, EN), (None, EN), (2, FR), (2, FR), (1, FR), (None, FR), (1, "a b c")]) == same([(None, EN), (1, FR), (1, "a b c")])
    assert run("decontaminate", [(None, EN), (1, EN), (1, f"x {passage}"), (None, passage)]) == same([(None, EN), (1, EN)])
    assert len(run("sentencepiece", [])) == 0


def test_stages_with_empty_tables_and_extra_columns(spark, tmp_path):
    spark.createDataFrame([("b", "x")], "item_id string, text string").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    more = SCHEMA + ", _row long, score double, contaminated boolean, ids array<int>, class_id long, keep_id long, _group string"
    rows = [(i, t, None, None, None, 1, 0.0, True, [1], 1, 1, "g") for i, t in enumerate([EN, FR, EN, None, ""])]
    for name, stage in corpus_pipeline.STAGES:
        learn = [(100 + i, f"{t} {i}", lang, None, None, 1, 0.0, True, [1], 1, 1, "g") for i in range(6) for t, lang in ((EN, "en"), (FR, "fr"))]
        out = stage(spark, spark.createDataFrame(rows + learn, more), str(tmp_path))
        assert out.columns == (corpus_pipeline.COLUMNS if name != "sentencepiece" else ["doc_id", "ids", "n_ids", "round_trip"])
        kept = sorted(r.doc_id for r in out.collect() if r.doc_id < 100)
        assert kept == {"language_id": [0, 1, 2], "exact_dedup": [1, 2, 4], "near_dup": [0, 1, 3, 4], "decontaminate": [0, 1, 2, 3, 4], "sentencepiece": [0, 1, 2, 3, 4]}[name]
        assert stage(spark, spark.createDataFrame([], more), str(tmp_path)).count() == 0
