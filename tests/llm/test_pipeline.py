"""The pipeline's stages and its whole run."""

from __future__ import annotations

import hashlib

import pytest

import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_odd_input(spark, odd_docs, odd_labels, tmp_path):
    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such words"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path))
            if name != "byte_bpe":
                assert got.columns == docs.columns, name
            got.collect()


def test_run_keeps_what_the_stages_decide(spark, data):
    before = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tables = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        tables.append({r["doc_id"]: r for r in docs.collect()})
    good, lines, single, clean, last = tables
    assert len(before) > len(good) >= len(single) > len(clean) == len(last)
    assert set(lines) == set(good)
    named = brute.components({k: r["text"] for k, r in lines.items()})
    assert set(single) == {c for _, c in named.values()}
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert not [k for k, r in clean.items() if any(i in r["text"] for i in items)]
    assert all(last[k]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for k, r in clean.items())
    run = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, data).collect()}
    assert run == {k: r["ids_sha256"] for k, r in last.items()}
