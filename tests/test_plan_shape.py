"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from tabloom.catalog.queries import QUERIES
from tabloom.catalog import fixtures
from tabloom.operators import vocabulary
from tabloom.operators.batching import training_schedule


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"experiment_run", "experiment_failures", "score_stream"}))
def test_no_cross_joins_and_no_row_at_a_time_python(spark, folder, name):
    shown = plan(entry.queries()[name](spark, folder))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown and "BatchEvalPython" not in shown


@pytest.mark.parametrize(
    "name, columns",
    [
        ("run_status", "event_id:bigint,user_id:bigint"), ("latency_by_engine", "event_type:string,value:double"),
        ("dataset_shape", ""), ("stop_cut", "doc_id:bigint,text:string"),
    ],
)
def test_only_needed_columns_are_read(spark, folder, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(entry.queries()[name](spark, folder))


def test_tokens_are_counted_from_texts_alone(spark, folder):
    assert "ReadSchema: struct<text:string>" in plan(vocabulary.token_counts(fixtures.texts(spark, folder)))


def test_role_filters_reach_the_scan(spark, folder):
    assert "EqualTo(role,user)" in plan(fixtures.pairs(spark, folder))


def test_only_bucket_counts_meet_in_one_task(spark, folder):
    lengths = fixtures.texts(spark, folder).select("example_id")
    shown = plan(training_schedule(lengths, ["example_id"]))
    assert "SinglePartition" not in shown
    assert re.search(r"BroadcastExchange.*\n.*Project \[epoch#\d+, _bucket#\d+, .*_start", shown)


def test_encoding_moves_texts_once(spark, folder):
    known = fixtures.vocabulary(spark, folder)
    texts = fixtures.table(spark, folder, "documents").selectExpr("doc_id AS example_id", "text")
    shown = plan(vocabulary.encode(texts, known, ["example_id"], broadcast=True))
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", shown)) == 1


def test_only_frequent_entries_of_a_large_vocabulary_are_broadcast(spark, folder):
    known, texts = fixtures.vocabulary(spark, folder), fixtures.texts(spark, folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(vocabulary.encode(texts, known, ["example_id"], broadcast=False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in shown
    assert all("limit=50000" in part[:600] for part in re.split(r"BroadcastExchange", shown)[1:])
