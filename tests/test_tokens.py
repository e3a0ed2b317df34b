import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.functions import tokens
from tabloom.functions.tokens import SpecialIds


@pytest.mark.parametrize(
    "ids, padded, mask", [([1, 2, 3], [1, 2, 3, 0], [1, 1, 1, 0]), ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4], [1] * 4), ([], [0] * 4, [0] * 4)]
)
def test_pad_and_mask(one, ids, padded, mask):
    assert one(tokens.padded(F.col("ids"), 4, 0), "ids array<int>", ids=ids) == padded
    assert one(tokens.mask(F.col("ids"), 4), "ids array<int>", ids=ids) == mask


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.lists(st.integers(0, 9), max_size=12), min_size=1, max_size=20), length=st.integers(0, 10))
def test_padding_properties(spark, rows, length):
    frame = spark.createDataFrame([(r,) for r in rows], "ids array<int>")
    ids = tokens.padded(F.col("ids"), length, 2)
    made = frame.select("ids", ids.alias("p"), tokens.mask(F.col("ids"), length).alias("m"), tokens.labels(ids, 2).alias("l"))
    for r in made.collect():
        assert len(r["p"]) == len(r["m"]) == len(r["l"]) == length
        assert sum(r["m"]) == min(len(r["ids"]), length)
        assert all((label == -100) == (i == 2) for i, label in zip(r["p"], r["l"]))
        assert r["p"][: len(r["ids"])] == r["ids"][:length]


def test_split(one):
    assert one(tokens.split_tokens(F.lit("Où est l'x_1, 42?\n\tça"))) == ["Où", "est", "l", "'", "x_1", ",", "42", "?", "ça"]
    assert one(tokens.split_tokens(F.lit(" \n"))) == []


def test_special_ids(one):
    assert SpecialIds().padding == 2 and SpecialIds(pad=7).padding == 7
    assert SpecialIds().first_free == 3 and SpecialIds(pad=7).first_free == 8
    assert one(tokens.framed(F.array(F.lit(5)), SpecialIds())) == [1, 5, 2]
    assert one(tokens.without_ids(F.array(F.lit(1), F.lit(5), F.lit(2)), [1, 2])) == [5]
    assert [one(tokens.rounded_up(F.lit(n))) for n in (0, 1, 8, 9)] == [0, 8, 8, 16]
