import corpus_pipeline
from barflow.llm import decontaminate, line_dedup, ngram_join, quality, registry
from barflow.llm.common import load, written

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_is_left(spark):
    docs = load(spark, SF, "documents")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, SF), "t")
        if k < 4:
            assert out.columns == names and out.count() <= docs.count()
            assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        else:
            assert out.count() == docs.count() and out.where("not decoded_ok").count() == 0
        docs = out


def test_decisions_take_effect(spark):
    docs = load(spark, SF, "documents")
    scores = quality.score(docs, quality.fit(docs, load(spark, SF, "labels")))
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    groups = ngram_join.join(docs)
    assert corpus_pipeline.near_duplicates(spark, docs, SF).count() == groups.where("kept").count()
    bad = decontaminate.findings(docs, load(spark, SF, "benchmark"))
    left = corpus_pipeline.decontamination(spark, docs, SF)
    assert bad.count() > 0 and left.count() == docs.count() - bad.count()
    assert {tuple(r) for r in line_dedup.dedup(docs).collect()} == {tuple(r) for r in corpus_pipeline.line_deduplication(spark, docs, SF).collect()}


def test_every_operator_has_one_query():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and names[-1] == "pipeline"
