"""The pipeline's stages against their operators' decisions."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.test_llm_operators import DOCS, ODD, brute_components, texts_of
from wovenlake.llm import lang_id, quality_rules, secret_scan


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality rules"](spark, docs, data).cache()
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in quality_rules.judge(docs).filter("kept").collect()}
    two = stage["language ID"](spark, one, data).cache()
    kept = lang_id.identify(one).filter(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_LANGUAGE_SCORE}")
    assert {r["doc_id"] for r in two.collect()} == {r["doc_id"] for r in kept.collect()}
    three = stage["n-gram Jaccard join"](spark, two, data).cache()
    want = {i for i, _, c in brute_components(texts_of(two), corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT) if i == c}
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(want)
    four = stage["secret scans"](spark, three, data).cache()
    assert four.columns == docs.columns and four.count() == three.count()
    assert secret_scan.report(four).filter("n_access > 0").count() == 0
    five = stage["best-fit packing"](spark, four, data)
    assert {r["doc_id"] for r in five.select("doc_id").distinct().collect()} == {r["doc_id"] for r in four.collect()}


def test_stages_on_odd_rows(spark, data):
    docs = spark.createDataFrame(ODD, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        docs.collect()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.createDataFrame([], DOCS), data).count() == 0
