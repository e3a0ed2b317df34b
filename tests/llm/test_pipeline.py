"""The pipeline over the given tables and over hard rows, stage by stage."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_columns_and_take_effect(spark, hard_docs, tmp_path):
    hard_docs.select("doc_id", F.lit(1).alias("quality")).filter("doc_id is not null").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no id here at all"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = hard_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, str(tmp_path))
        assert after.columns == rows.columns, name
        assert after.count() <= rows.count()
        rows = after
    kept = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert {1, 9, 11}.issubset(kept) and not {2, 4, 5, 6, 14} & set(kept)
    assert "[SECRET]" in kept[11]
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()}
    assert all(last[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for d, t in kept.items())


def test_stages_over_an_empty_table(spark, empty_docs, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs, folder).count() == 0


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    assert 0 < rows.count() < documents.count()
    assert rows.filter("size(ids) != n_tokens").count() == 0
