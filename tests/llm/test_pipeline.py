"""The stages of the pipeline, each on all that the one before kept."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, medium, docs, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    rows, kept = docs, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontaminate", "pack"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.materialize(stage(spark, rows, medium), name)
        assert rows.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in rows.collect()}
    ids = set(texts)
    for name in kept:
        assert set(kept[name]) <= ids
        ids = set(kept[name])
    good = {i for i, q in labels.items() if q == 1}
    assert len(good & set(kept["quality"])) >= 0.97 * len(good)
    assert set(kept["quality"].values()) <= set(texts.values())
    items = [r["text"] for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    assert not [i for i, t in kept["decontaminate"].items() if any(x in t for x in items)]
    from tests.llm.brute import jaccard_components

    near = jaccard_components(kept["line_dedup"].items(), corpus_pipeline.SHINGLE_WORDS, *corpus_pipeline.SIMILAR)
    assert set(kept["near_duplicates"]) == {i for i, (n, c) in near.items() if i == c}
    packed = corpus_pipeline.pack_stage(spark, rows, medium).collect()
    assert {r["doc_id"] for r in packed} == set(kept["decontaminate"])


def test_odd_rows(spark, odd, empty, medium):
    for rows in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, medium)
            assert out.columns == rows.columns
            assert out.count() <= rows.count()
        corpus_pipeline.pack_stage(spark, rows, medium).collect()
