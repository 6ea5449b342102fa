import corpus_pipeline
from veraframe.llm.quality_classifier import op6_quality_classifier

from .helpers import SMALL, WORD, empty_documents, odd_documents, rows
from .test_lines import brute
from .test_near import linked


def test_stages_against_brute_force(spark):
    docs = rows(spark, "documents")
    (_, quality), (_, lines), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = quality(spark, docs, SMALL)
    rejected = {r.doc_id for r in op6_quality_classifier(spark, SMALL).collect() if not r.predicted}
    assert kept.columns == docs.columns and rejected
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected
    got = lines(spark, kept, SMALL)
    before = sorted((r.doc_id, r.text) for r in kept.collect())
    want = {d: t for d, t in brute(before, 1).items() if WORD.search(t) or not WORD.search(dict(before)[d])}
    assert {r.doc_id: r.text for r in got.collect()} == want
    once = near(spark, docs, SMALL)
    _, component = linked([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert {r.doc_id for r in once.collect()} == set(component.values())
    assert once.count() == len(set(component.values()))
    assert mix(spark, once, SMALL).columns == docs.columns
    assert sum(p.length for p in pack(spark, once, SMALL).collect()) > once.count()


def test_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 0 and {"doc_id", "ids", "sequence_id"} <= set(got.columns)


def test_odd_documents_pass_every_stage(spark):
    for docs in (odd_documents(spark), empty_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SMALL)
            assert got.columns == docs.columns
            got.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count()
