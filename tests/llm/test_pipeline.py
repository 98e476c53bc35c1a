"""The pipeline: each stage's output follows from its input by a plain version of the stage."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from tests.llm.test_operators import brute_components, words
from tidemark.llm import decontamination, quality_classifier
from tidemark.llm.scratch import written


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "substring_dedup", "decontamination", "packing"]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], data)))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:-1]]

    scores = {r.doc_id: r.predicted for r in quality_classifier.classify(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    assert rows[1] == {i: r for i, r in rows[0].items() if scores[i]}

    kept = {i for i, _, _, k in brute_components([(i, r.text) for i, r in rows[1].items()], 80, 5) if k}
    assert rows[2] == {i: r for i, r in rows[1].items() if i in kept}

    count = Counter()
    for r in rows[2].values():
        w = words(r.text)
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    for i, r in rows[2].items():
        w, gone = words(r.text), set()
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                gone.update(range(p, p + 35))
        want = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else r.text
        assert rows[3][i].text == want and rows[3][i].n_chars == (len(want) if gone else r.n_chars)

    items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    dirty = {i for i, r in rows[3].items() if any(t in decontamination.normal(r.text) for t in items)}
    assert dirty and not dirty & set(rows[4]) and len(rows[4]) >= len(rows[3]) - len(dirty) - 2

    by = defaultdict(list)
    for p in tables[-1].collect():
        by[p.doc_id].append(p)
    assert set(by) == set(rows[4])
    for own in by.values():
        own.sort(key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in own])
        assert len(ids) == own[0].doc_tokens and ids[-1] == 0
        assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in own)


def test_run_gives_the_last_stage(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_empty_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data))
    assert docs.count() == 0


def test_rows_without_or_with_the_same_id(spark, data):
    """Nulls in every column, empty texts, repeated rows and columns of other names pass through all stages."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    good = docs.orderBy("doc_id").first()
    odd = spark.createDataFrame([(None, good.text, None, None, None), (None, None, None, None, None), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (good.doc_id, good.text, good.lang, good.source, good.n_chars)], docs.schema)
    out = docs.unionByName(odd).selectExpr("*", "'x' as part", "1 as id", "'y' as chunk")
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, out, data))
        if name != "packing":
            assert out.columns == docs.columns
            assert out.filter("doc_id is null").count() == 2, name
    assert out.count() > 0 and out.filter("doc_id is null").select("doc_tokens").distinct().count() >= 1
