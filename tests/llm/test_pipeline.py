"""The pipeline against its stages by brute force on a small fixture."""

import collections

import corpus_pipeline
from panelcast.llm import decontaminate, mixing, near_dup, quality_cnn, queries
from test_operators import SCHEMA, benchmark, fixture_rows


def test_stages(spark, monkeypatch):
    docs = spark.createDataFrame(fixture_rows(), SCHEMA)
    bench, _ = benchmark(spark)
    labels = docs.selectExpr("doc_id", "CASE WHEN length(text) > 20 THEN 1 ELSE 0 END AS quality")
    tables = {"documents": docs, "benchmark": bench, "labels": labels}
    for m in (queries, corpus_pipeline):
        monkeypatch.setattr(m, "table", lambda s, d, t: tables[t])
    net = quality_cnn.train(docs, labels)
    good = {r.doc_id for r in quality_cnn.score(docs, net).where("predicted = 1").collect()}
    one = docs.where(docs.doc_id.isin(sorted(good)))
    keep = {r.doc_id for r in near_dup.near_duplicates(one).where("kept").collect()}
    two = one.where(one.doc_id.isin(sorted(keep)))
    gone = {r.doc_id for r in decontaminate.find_leaks(two, bench).collect()}
    three = two.where(~two.doc_id.isin(sorted(gone)))
    copies = {r.doc_id: r["__copies"] for r in mixing.plan_copies(three, keep=("doc_id",)).collect()}
    got = corpus_pipeline.run(spark, "").collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter({d: c for d, c in copies.items() if c})
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in got)
    assert good and gone and len(keep) < len(good)
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, "").columns == docs.columns
        assert step(spark, docs.limit(0), "").count() == 0
    assert len(corpus_pipeline.STAGES) == 5
