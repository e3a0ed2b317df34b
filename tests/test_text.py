import datetime

import pytest
from pyspark.sql import functions as F

from tabloom.functions import text


@pytest.mark.parametrize(
    "given, stops, kept",
    [
        ("a</s>b<|end_of_text|>c", ["<|end_of_text|>", "</s>"], "a"),
        ("a<|end_of_text|>b</s>c", ["<|end_of_text|>", "</s>"], "a"),
        ("plain", ["<|end_of_text|>", "</s>"], "plain"),
        ("</s>all", ["</s>"], ""),
        ("xabc", ["bc", "ab"], "x"),
        ("é</s>x", ["</s>"], "é"),
        ("kept", [], "kept"),
        (None, ["</s>"], None),
    ],
)
def test_cut_at_stop(one, given, stops, kept):
    assert one(text.cut_at_stop(F.col("s"), stops), "s string", s=given) == kept


@pytest.mark.parametrize("given, kept", [("ask answer", " answer"), ("answer", "answer"), ("ask", ""), (None, None)])
def test_without_echo(one, given, kept):
    assert one(text.without_echo(F.col("s"), F.lit("ask")), "s string", s=given) == kept


def test_marks_names_json(one):
    assert one(text.without_marks(F.lit("<s>a.b</s><s>"), ["<s>", "</s>", "."])) == "ab"
    assert one(text.same_name(F.lit("MATH"), "Math"))
    assert one(text.json_text(F.lit(1).alias("a"))) == '{"a":1}'
    assert "\n" in one(text.json_text(F.lit(1).alias("a"), pretty=True))


def test_times(one):
    moment = datetime.datetime(2024, 3, 1, 4, 5, 6, 700)
    assert one(text.timestamp_text(F.col("t")), "t timestamp", t=moment) == "2024-03-01 04:05:06"
    later = moment + datetime.timedelta(seconds=1, microseconds=5)
    assert one(text.elapsed_us(F.lit(moment), F.lit(later))) == 1_000_005


def test_numbers(one):
    assert one(text.scaled(F.lit(float((1 << 30) * 0.0625)), 1 << 30, 3)) == 0.062
    assert one(text.at_most(F.lit(25), 20)) == 20
    assert one(text.whole(F.lit((1 << 62) + 7), 8)) == (1 << 62) // 8
    assert [one(text.whole_up(F.lit(n), 8)) for n in (0, 1, 8, 9)] == [0, 1, 1, 2]


def test_mean_or_zero(spark):
    rows = spark.createDataFrame([(None,), (None,)], "v double")
    assert rows.agg(text.mean_or_zero(F.col("v")).alias("m")).first()["m"] == 0.0
