import hashlib

import pytest
from pyspark.sql import functions as F

from tabloom.operators import ordering, selection
from tabloom.operators.batching import collate, micro_batches, pad_in_batches, training_schedule


def test_shuffled_position_is_the_rank_of_the_hash(spark):
    made = ordering.shuffled_position(spark.range(500).withColumnRenamed("id", "k"), ["k"], seed=7, digits=2, total="n")
    order = sorted(range(500), key=lambda k: hashlib.md5(f"7:0:{k}".encode()).hexdigest())
    found = {r["position"]: r["k"] for r in made.collect()}
    assert [found[i] for i in range(500)] == order
    assert {r["n"] for r in made.collect()} == {500}


@pytest.mark.parametrize("partitions", [1, 2, 7, None])
def test_key_position_over_a_hot_leading_key(spark, partitions):
    rows = [(1 if i % 3 else i, f"é{i:05d}") for i in range(900)]
    made = ordering.key_position(spark.createDataFrame(rows, "a long, b string"), ["a", "b"], partitions=partitions, total="n")
    found = [(r["a"], r["b"]) for r in made.orderBy("position").collect()]
    assert found == sorted(rows)
    assert sorted(r["position"] for r in made.collect()) == list(range(900)) and {r["n"] for r in made.collect()} == {900}


def test_a_hot_leading_key_is_cut(spark):
    rows = spark.range(8000).select(F.lit(5).alias("a"), F.col("id").alias("b"))
    made = ordering.key_position(rows, ["a", "b"], partitions=8)
    stored = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in made.inputFiles()})
    sizes = [r["count"] for r in stored.groupBy(F.shiftright("_place", ordering.ROW_BITS)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1600


def test_key_position_of_nothing(spark):
    assert ordering.key_position(spark.range(0), ["id"]).count() == 0


def test_micro_batches(spark):
    made = micro_batches(spark.range(10), ["id"], 4)
    assert {r["id"]: r["batch_id"] for r in made.collect()} == {i: i // 4 for i in range(10)}


def test_schedule_keeps_partial_batches(spark):
    made = training_schedule(spark.range(10), ["id"], batch_size=4, accumulation=2, epochs=2).collect()
    sizes = {}
    for r in made:
        sizes.setdefault((r["epoch"], r["micro_batch"]), set()).add(r["id"])
    assert {k: len(v) for k, v in sizes.items()} == {(e, m): n for e in (0, 1) for m, n in ((0, 4), (1, 4), (2, 2))}
    for epoch in (0, 1):
        assert set().union(*(v for k, v in sizes.items() if k[0] == epoch)) == set(range(10))
    steps = {(r["epoch"], r["micro_batch"]): r["step"] for r in made}
    assert steps == {(0, 0): 0, (0, 1): 0, (0, 2): 1, (1, 0): 2, (1, 1): 2, (1, 2): 3}
    assert [r["id"] for r in sorted(made, key=lambda r: r["position"]) if r["epoch"] == 0] != [
        r["id"] for r in sorted(made, key=lambda r: r["position"]) if r["epoch"] == 1
    ]


def test_schedule_stops_and_repeats(spark):
    def run():
        made = training_schedule(spark.range(100), ["id"], epochs=3, max_steps=20, seed=3)
        return sorted(tuple(r) for r in made.collect())

    first = run()
    assert first == run() and max(r[-1] for r in first) == 19


def encoded(spark):
    rows = [(i, list(range(10, 10 + i % 11))) for i in range(30)]
    return rows, spark.createDataFrame(rows, "id long, input_ids array<int>")


def test_pad_in_batches(spark):
    rows, frame = encoded(spark)
    for r in pad_in_batches(frame, ["id"], 4).collect():
        longest = max(len(ids) for i, ids in rows if i // 4 == r["id"] // 4)
        assert r["batch_id"] == r["id"] // 4 and len(r["input_ids"]) == len(r["attention_mask"]) == longest


def test_collate(spark):
    rows, frame = encoded(spark)
    ids = dict(rows)
    made = collate(frame, ["id"], batch_size=4).collect()
    widths = {}
    for r in made:
        widths.setdefault(r["micro_batch"], set()).add(len(r["input_ids"]))
        assert r["input_ids"][: len(ids[r["id"]])] == ids[r["id"]] and len(r["input_ids"]) % 8 == 0
        assert sum(r["attention_mask"]) == len(ids[r["id"]])
        assert r["labels"] == [i if i != 2 else -100 for i in r["input_ids"]]
    assert all(len(w) == 1 for w in widths.values()) and len(made) == 30


@pytest.mark.parametrize("n", [0, 1, 37, 900, 5000])
def test_head(spark, n):
    rows = spark.createDataFrame([(i % 7, i, "wide") for i in range(900)], "a long, b long, t string")
    expected = sorted((i % 7, i) for i in range(900))[:n]
    assert sorted((r["a"], r["b"]) for r in selection.head(rows, n, ["a", "b"]).collect()) == expected


@pytest.mark.parametrize("n", [1, 2_999, 3_000, 3_001, 5_500, 8_999, 9_000])
def test_head_by_selection(spark, monkeypatch, n):
    """A third of the keys share their leading column, some of them have none, and ranges are cut several times."""
    monkeypatch.setattr(selection, "SORTED_ROWS", 50)
    monkeypatch.setattr(selection, "SAMPLED", 200)
    monkeypatch.setattr(selection, "SPLITTERS", 8)
    data = [(5 if i % 3 == 0 else None if i % 50 == 1 else i % 40, f"é{i * 7919 % 9000:05}", i) for i in range(9_000)]
    rows = spark.createDataFrame(data, "a int, b string, wide int").repartition(5)
    expected = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert selection.nth_key(rows.select("a", "b"), n) == expected[n - 1][:2]
    assert sorted(r["wide"] for r in selection.head(rows, n, ["a", "b"]).collect()) == sorted(r[2] for r in expected[:n])


def test_head_of_equal_keys_ends(spark, monkeypatch):
    monkeypatch.setattr(selection, "SORTED_ROWS", 10)
    rows = spark.range(500).selectExpr("1 AS a", "id")
    assert selection.nth_key(rows.select("a"), 20) == (1,) and selection.nth_key(rows.select("a"), 501) is None
    assert selection.nth_key(rows.limit(0).select("a"), 1) is None


def test_split_names():
    assert selection.parse_split("train[:10000]") == ("train", 10000)
    assert selection.parse_split("test") == ("test", None)
    for wrong in ("train[5:10]", "train[:10%]", "train[-5:]", "a+b"):
        with pytest.raises(ValueError):
            selection.parse_split(wrong)


def test_split_too_long(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b c d"), (3, "abcdefgh"), (4, None), (5, "")], "id int, text string")
    fit, long = selection.split_too_long(rows, "text", 3)
    assert sorted(r["id"] for r in fit.collect()) == [1, 3, 4, 5]
    assert [(r["id"], r["tokens"]) for r in long.collect()] == [(2, 4)]
