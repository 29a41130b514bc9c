"""The pipeline on a small table against its stages by brute force."""

import pytest
from test_operators import brute_components, leaks

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from wayfold.llm import queries, toxicity  # noqa: E402


def test_pipeline(spark, small):
    docs = queries.table(spark, small, "documents")
    model = queries.toxicity_model(docs, queries.table(spark, small, "labels"))
    kept = [r for r in toxicity.score_toxicity(docs, model, keep=["doc_id", "text"]).collect() if r.score < 0.3]
    components, _ = brute_components([r.text for r in kept], [r.doc_id for r in kept])
    items = [(r.item_id, r.text) for r in queries.table(spark, small, "benchmark").collect()]
    left = {r.doc_id for r in kept if components[r.doc_id] == r.doc_id and not leaks(r.text, items)[1]}
    got = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == left
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(50), small).columns == docs.columns
