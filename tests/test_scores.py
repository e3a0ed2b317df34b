"""Judge responses as they come, broken ones included."""

import json

import pytest
from pyspark.sql import functions as F

from tabloom.functions.scores import problem_text
from tabloom.operators.summaries import latency_summary, run_status, score_summary, shape, with_scores

CASES = {
    '{"first_score": 7, "second_score": 5}': (7.0, 5.0),
    '{"Problem": "p", "first_score": 4.5, "second_score": 5}': (4.5, 5.0),
    ' \n{"second_score": 1, "first_score": 2}\n': (2.0, 1.0),
    '{"first_score": 1, "second_score": 5, "first_score": 3}': (3.0, 5.0),
    '{"first_score": 4}': None,
    "not json": None,
    "": None,
    "[1]": None,
    '[{"first_score": 1, "second_score": 2}]': None,
    "7": None,
    None: None,
    '{"first_score": "4", "second_score": 5}': None,
    '{"first_score": "NaN", "second_score": 5}': None,
    '{"first_score": NaN, "second_score": 5}': None,
    '{"first_score": 1e999, "second_score": 5}': None,
    '{"first_score": true, "second_score": 5}': None,
    '{"first_score": null, "second_score": 5}': None,
    '{"first_score": {"a": 1}, "second_score": 5}': None,
    '{"first_score": 4, "second_score": 5, "problem": "cut': None,
    '{"first_score": 4, "second_score": 5': None,
}
TRAILING = '{"first_score": 4, "second_score": 6} thanks'


def read(spark, raws, **options):
    rows = spark.createDataFrame([(r,) for r in raws], "raw string")
    return {r["raw"]: (r["first_score"], r["second_score"]) if r["valid"] else None
            for r in with_scores(rows, **options).collect()}


@pytest.mark.parametrize("strict", [False, True])
def test_responses(spark, strict):
    found = read(spark, CASES, strict=strict)
    assert {k: v for k, v in found.items() if v != CASES[k]} == {}


def test_trailing_text_passes_only_when_asked(spark):
    assert read(spark, [TRAILING], strict=False) == {TRAILING: (4.0, 6.0)}
    assert read(spark, [TRAILING]) == {TRAILING: None}


SOUND = '{"first_score": 4, "second_score": 5}'


@pytest.mark.parametrize(
    "raw", [SOUND.replace('"', "'"), SOUND + SOUND, SOUND + ", 1", SOUND + "}", SOUND + "]", SOUND + ', "x": 1', SOUND + " ] [ {}", SOUND[:-1], "// c\n" + SOUND]
)
def test_what_a_strict_reader_refuses(spark, raw):
    with pytest.raises(ValueError):
        json.loads(raw)
    assert read(spark, [raw, SOUND]) == {raw: None, SOUND: (4.0, 5.0)}


def test_invalid_rows_carry_no_scores(spark):
    row = with_scores(spark.createDataFrame([('{"first_score": 4}',)], "raw string")).first()
    assert (row["first_score"], row["second_score"], row["valid"]) == (None, None, False)


def test_summary(spark):
    rows = spark.createDataFrame([(r, "a") for r in CASES] + [("x", "b")], "raw string, engine string")
    whole = score_summary(with_scores(rows)).first()
    assert tuple(whole) == ((7 + 4.5 + 2 + 3) / 4, (5 + 5 + 1 + 5) / 4, 4, len(CASES) + 1)
    per = {r["engine"]: tuple(r)[1:] for r in score_summary(with_scores(rows), ["engine"]).collect()}
    assert per["b"] == (0.0, 0.0, 0, 1)


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "raw string")
    assert tuple(score_summary(with_scores(empty)).first()) == (0.0, 0.0, 0, 0)


def test_problem_under_either_key(spark):
    rows = spark.createDataFrame([('{"problem": "a"}',), ('{"Problem": "b"}',), ("{}",)], "raw string")
    assert [r[0] for r in rows.select(problem_text(F.col("raw"))).collect()] == ["a", "b", None]


def test_run_status(spark):
    rows = [
        (1, "training", True), (1, "vllm_evaluation", True), (2, "standard_evaluation", True), (2, "vllm_evaluation", False),
        (3, "inference", False), (3, "vllm_evaluation", False), (4, "vllm_evaluation", None),
    ]
    found = run_status(spark.createDataFrame(rows, "run_id int, step string, ok boolean")).collect()
    assert {r["run_id"]: r["status"] for r in found} == {1: "success", 2: "partial_success", 3: "failed", 4: "success"}


def test_latency(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 4), ("b", None)], "engine string, latency_us long")
    found = {r["engine"]: tuple(r)[1:] for r in latency_summary(rows).collect()}
    assert found == {"a": (5, 2.5, 1, 4, 2), "b": (None, None, None, None, 0)}


def test_shape(spark):
    assert tuple(shape(spark.range(3).withColumn("x", F.lit(1))).first()) == (3, 2)
