"""The pipeline: each stage against what it must do with its own input."""

import brute
import numpy as np
from test_packing import expected, whole
from test_corpus_tables import odd_docs

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import packing


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, inputs, outputs = docs.columns, [], []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = stage(spark, docs, folder).cache()
        outputs.append(docs)
    assert all(o.columns == columns for o in outputs[:-1])
    before, after = [[{r.doc_id: r for r in d.collect()} for d in side[:3]] for side in (inputs, outputs)]
    for r in before[0].values():
        n, _, _, _, repeat = brute.quality_counts(r.text)
        failed = n < 50 or 100 * repeat > 50 * n
        assert (r.doc_id not in after[0]) >= failed
    assert after[1].keys() == before[1].keys() and all(after[1][i].n_chars == len(after[1][i].text) for i in after[1])
    assert 0 < len(after[2]) < len(before[2]) and all(after[2][i] == before[2][i] for i in after[2])
    mixed = outputs[3].collect()
    assert {r.doc_id for r in mixed} <= after[2].keys()
    size, got = {}, {}
    for r in after[2].values():
        size[r.source] = size.get(r.source, 0) + len(brute.words(r.text))
    for r in mixed:
        got[r.source] = got.get(r.source, 0) + len(brute.words(r.text))
    for s, want in brute.targets(size).items():
        # A handful of documents per source: a sum need not exist nearer than half of one.
        assert abs(got.get(s, 0) - want) <= max(len(brute.words(r.text)) for r in after[2].values() if r.source == s) / 2
    rows = outputs[4].collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == expected([(r.doc_id, r.text) for r in mixed])
    assert whole(rows) <= packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1
    assert entry.queries()["pipeline"](spark, folder).count() == len(rows)


def test_odd(spark):
    docs = odd_docs(spark)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, "")
            assert out.columns == docs.columns
            out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
