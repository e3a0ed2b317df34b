"""One conversation, one user, one text and one response holding a third of the rows or more."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, connect, difference
from tabloom.catalog import fixtures

QUERIES = (
    "render_conversation", "render_instruction_training", "render_chat_training", "render_judge_prompt", "zip_columns",
    "head_split", "instruction_scan_split", "encode", "encode_whole", "decode", "vocab", "vocab_whole", "vocab_frequent", "encode_marked", "training_steps_capped", "batched_map", "pad_longest_in_batch", "training_batches",
    "collated_batches", "generate_stub", "pair_outputs", "judge_stub", "evaluate_engine", "experiment_run", "score_by_engine",
    "engines_side_by_side", "run_status", "latency_by_engine", "experiment_log_history", "score_stream", "calibration_sample",
    "csv_problems_split", "json_array_split", "experiment_log_split", "decode_exact", "subword_encode", "subword_decode", "subword_vocab",
    "subword_training_rows", "subword_batches", "render_compiled", "calls_resumed", "first_token_latency", "log_concurrent", "score_stream_replaced",
)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory, folder):
    out = str(tmp_path_factory.mktemp("skewed"))
    db = duckdb.connect()
    for name in TABLES:
        rows = f"SELECT * FROM '{folder}/{name}.parquet'"
        if name == "conversations":
            # More than a thousand turns, so that keys built by packing conversation and turn would collide.
            rows += """ UNION ALL SELECT 3, 100 + i, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END,
                CASE WHEN i % 2 = 0 THEN 'What is ' || (i % 50) || chr(10) || 'and more' ELSE 'It is ' || i END FROM range(1500) t(i)"""
        elif name == "events":
            rows = f"SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 8 ELSE user_id END AS user_id) FROM ({rows})"
        elif name == "documents":
            rows += f""" UNION ALL SELECT 1000000 + i, d.text, d.lang, d.source, d.n_chars
                FROM (SELECT * FROM '{folder}/documents.parquet' WHERE doc_id = 5) d, range(300) t(i)
                UNION ALL SELECT 2000000, repeat('hot ', 5000), 'en', 's', 20000 UNION ALL SELECT 2000001, '', 'en', 's', 0"""
        db.execute(f"COPY ({rows}) TO '{out}/{name}.parquet'")
    return out


@pytest.fixture(scope="module")
def connection(skewed):
    return connect(skewed)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, skewed, connection, name):
    assert difference(entry.queries()[name](spark, skewed), connection.sql(entry.oracle_sql()[name])) is None


def test_a_long_conversation_is_rendered_in_segments_and_whole(spark, skewed):
    counts = fixtures.chats(spark, skewed).groupBy("conv_id", "segment").count().collect()
    assert max(r["count"] for r in counts) <= fixtures.SEGMENT_TURNS
    assert sum(1 for r in counts if r["conv_id"] == 3) > 20
    assert entry.queries()["render_conversation"](spark, skewed).filter("conv_id = 3").count() == 1
